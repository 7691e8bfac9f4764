import pytest

from foliant.llm import mojibake as m

WORDS = "la panadería de la esquina está cerrada desde la inundación de otoño según la oficina también el depósito perdió páginas más allá después lección razón".split()
RUSSIAN = "старый читальный зал около реки открывает двери для сорока посетителей потому что дорога мокрая и ночной сторож ждёт новых окон".split()


def sentences(words, n):
    return [" ".join(words[(i * 7 + j * 3) % len(words)] for j in range(8)).capitalize() + f" (Tismar {i})." for i in range(n)]


def tables(spark, texts, headers=()):
    p = spark.createDataFrame([("a", i, t, "x") for i, t in enumerate(texts)], "archive_id string, part_no int, data string, header string")
    a = spark.createDataFrame(list(headers), "archive_id string, headers map<string,string>")
    return p, a


def test_found_and_restored(spark):
    clean = sentences(WORDS, 120) + sentences(RUSSIAN, 120)
    bad = []
    for i, (written, read) in enumerate([("utf-8", "cp1252"), ("utf-8", "cp1251"), ("cp1252", "mac-roman")]):
        bad += [(s, "".join(m._TABLES[read][b] for b in s.encode(written))) for s in sentences(WORDS, 12)[i::2]]
    bad += [(s, "".join(m._TABLES["cp1252"][b] for b in s.encode("cp1251"))) for s in sentences(RUSSIAN, 12)]
    bad = [(s, b) for s, b in bad if s != b]
    lost = ["La panader�a está"]
    texts = [*clean, *(b for _, b in bad), *lost, "plain ASCII", None, ""]
    p, a = tables(spark, texts, [("h", {"subject": bad[0][1], "from": "x"}), ("i", {"subject": clean[0]}), ("j", {"subject": "=?utf-8?B?w6k=?="}), ("k", None)])
    found = {(r["archive_id"], r["part_no"]) for r in m.garbled_records(p, a).collect()}
    n = len(clean)
    assert found == {("a", i) for i in range(n, n + len(bad) + 1)} | {("h", -1)}
    restored = {r["part_no"]: r for r in m.restored_records(p, a).collect() if r["archive_id"] == "a"}
    right = sum(restored[n + i]["restored"] == s for i, (s, _) in enumerate(bad))
    assert right >= 0.8 * len(bad) and restored[n + len(bad)]["whole"] is False


@pytest.mark.parametrize("text", ["INFORMAÇÃO", "ÂGE", "CHÂTEAU", "É", "à", "Её", "© 2024"])
def test_plain_words_are_no_bytes(text):
    # whatever is learned, a valid reading needs whole sequences or better pairs
    restorer = m.Restorer([("utf-8", "cp1252"), ("utf-8", "cp1251"), ("cp1251", "cp1252")], {}, -14.0)
    assert not restorer.check(text)


def test_reread():
    assert m.reread("Ã©", "utf-8", "cp1252") == "é" and m.reread("é", "utf-8", "cp1252") is None and m.reread("Ð\x9d", "utf-8", "cp1252") == "Н"


def test_empty(spark):
    p, a = tables(spark, [None])
    assert m.garbled_records(p.limit(0), a).count() == m.restored_records(p, a).count() == 0


def test_escaped_text(spark):
    clean = sentences(WORDS, 120) + sentences(WORDS, 120)
    bad = ["".join(m._TABLES["cp1252"][b] for b in s.encode("utf-8")) for s in sentences(WORDS, 12)]
    escaped = ["".join(c if c < "\x80" else f"&#{ord(c)};" for c in b) for b in bad if not b.isascii()]
    fine = ["La panader&iacute;a est&aacute; cerrada &amp; fr&#237;a", "a &lt;b&gt; &nbsp; c", "&bogus; &#9999999;"]
    p, a = tables(spark, [*clean, *bad, *escaped, *fine])
    found = {r["part_no"] for r in m.garbled_records(p, a).collect()}
    first = len(clean) + len(bad)
    assert found == {len(clean) + i for i, b in enumerate(bad) if not b.isascii()} | set(range(first, first + len(escaped)))
    restored = {r["part_no"]: r["restored"] for r in m.restored_records(p, a).collect()}
    assert restored[first] == next(s for s in sentences(WORDS, 12) if not s.isascii())


def test_lines_and_runs_of_any_length(spark):
    # twins of 2,000 characters and runs of 700, whose only common ASCII are names and numbers
    line = " ".join(f"{w} Tismar {i}" for i, w in enumerate(RUSSIAN * 8))
    bad = "".join(m._TABLES["cp1252"][b] for b in line.encode("cp1251"))
    p, a = tables(spark, [line] * 4 + [bad] + sentences(RUSSIAN, 60))
    assert len(line) > 1400 and ("cp1251", "cp1252") in m.fit(m._values(p, a))[0]
    assert {r["part_no"] for r in m.garbled_records(p, a).collect()} == {4}
    run = "".join(RUSSIAN * 9)
    assert len(run) > 700 and ("utf-8", "cp1251") in set(m._explain("".join(m._TABLES["cp1251"][b] for b in run.encode("utf-8")), run))
