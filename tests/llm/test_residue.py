import random

import pytest

from foliant.llm import residue as r
from foliant.llm.blocks import read_blocks

PROSE = "The choir measured the water level each morning and kept a handwritten list of it. "
SCHEMA = "archive_id string, part_no int, host string, content_type string, data string, leaf string"


def table(spark, values):
    """Each value once on each of three hosts, so that what is a message can be told."""
    return spark.createDataFrame([(f"a{h}", i, f"h{h}", "text/html", v, "x") for h in range(3) for i, v in enumerate(values)], SCHEMA)


def cases(spark, values):
    found = {(x["archive_id"], x["part_no"]) for x in r.verdicts(table(spark, values)).collect()}
    per = [{n for a, n in found if a == f"a{h}"} for h in range(3)]
    assert per[0] == per[1] == per[2]
    return per[0]


def prose(n=60):
    """Paragraphs of ordinary prose: some alone, most beside others."""
    rnd = random.Random(1)
    subjects, verbs, rests = ("The choir", "The harbour office", "Nobody in the village", "A retired clockmaker"), ("measured", "kept", "opened", "sold"), ("the water level", "a list of visitors", "the wooden gate", "the best bread")
    lines = [f"{rnd.choice(subjects)} {rnd.choice(verbs)} {rnd.choice(rests)} in {1900 + i} for the {i}th time." for i in range(n)]
    return [*(f"<p>{a}</p><p>{b}</p><p>{c}</p>" for a, b, c in zip(lines, lines[1:], lines[2:])), *(f"<p>{x}</p>" for x in lines[:3])]


def test_cases(spark):
    yes = [
        "<p>Page not found. The address does not exist.</p>", "Zugriff verweigert. Ihnen fehlt die nötige Berechtigung.", "<html><body><h1>Oops</h1><div>java.lang.IllegalStateException: pool closed at a.b(Main.java:3)</div></body></html>",
        "<p>Warning: include(/srv/x.inc): failed to open stream in /srv/y.php on line 7</p>", "bla bla bla bla bla bla", "<p>Lorem ipsum dolor sit amet dolore magna velit massa porta.</p>", f"<p>{PROSE}{{{{ user.name }}}} left.</p>", f"{PROSE}%%CITY%% {PROSE}",
        "<h1>${title}</h1><p>x</p>", "<noscript>Please enable JavaScript to view this page.</noscript>", "Включите JavaScript, чтобы увидеть эту страницу.", f"<p>{PROSE}&lt;%= a.b %&gt;</p>", "<title>[[NAME_X]]</title><p>x</p>", f"<p>{PROSE}{PROSE}</p><p>Lorem ipsum dolor sit amet dolore magna velit massa porta.</p>",
        f"<h1>News</h1><p>Page not found. The address does not exist.</p><p>{PROSE}{PROSE}</p>", "お探しのページは見つかりませんでした。",
    ]
    no = [
        f"<p>The report explains why the server answered “service unavailable” on Monday. {PROSE}</p><p>{PROSE}</p>", f"<p>{PROSE}</p><p>{PROSE}.</p><pre>{{{{ x }}}}</pre><script>`${{a}}`</script>", f"<noscript>Please enable JavaScript to view this page.</noscript><p>{PROSE}</p><p>{PROSE}.</p>",
        f"{PROSE}\n\n{PROSE}!\n\n    echo ${{a}}\n\n```\n{{{{ b }}}}\n```\nand `{{c}}` too.", f"<p>The typesetter says that lorem ipsum was never used in this village.</p><p>{PROSE}</p>", "let a = `item ${b.c}`;", '{"error": "x"}', None, "", f'<p><a href="/{{x}}">{PROSE}</a></p><p>{PROSE}</p>',
        f"    <h1><%= x %></h1>\n\n{PROSE}\n\n{PROSE}?", "<h1>Harbour News</h1>",
    ]
    assert cases(spark, [*yes, *no, *prose()]) == set(range(len(yes)))


def test_templates_are_told_by_standing_alone(spark):
    other = f"<p>{PROSE}</p><p>{PROSE}{PROSE}</p>"
    rows = [(f"a{i}", 0, f"h{i % 5}", "text/plain", f"Something went wrong on our side. Error code {i}.", None) for i in range(50)]
    rows += [(f"b{i}", 0, f"h{i % 5}", "text/html", f"<p>We use cookies to measure visits.</p>{other}", None) for i in range(50)]
    rows += [("c", 0, "h1", "text/html", f"<p>Something went wrong on our side. Error code 9.</p>{other}", None), ("d", 0, "h9", "text/plain", "We use cookies to measure visits.", None)]
    values = spark.createDataFrame(rows, SCHEMA)
    for n in (1, 7):
        found = r.message_templates(r.mined(values.repartition(n))).collect()
        assert [(x["template"], x["n"], x["alone"]) for x in found] == [("something went wrong on our side. error code <*>", 51, 50)]
    assert {x["archive_id"] for x in r.verdicts(values).collect()} == {f"a{i}" for i in range(50)} | {"c"}


def test_one_short_text_is_no_message(spark):
    rows = [("a", 0, "h", "text/plain", "The ferry crew lost the ledger.", None), ("b", 0, None, "text/plain", "Another short line.", None)] * 3
    rows += [("a", -1, "h", "text/html", "<p>The ferry crew lost the ledger.</p>", None)]
    assert r.verdicts(spark.createDataFrame(rows, SCHEMA)).count() == 0


def test_messages_of_any_length(spark):
    # ten times what one screen holds: a dump of 400 tokens and of 3,200 characters
    long = "Unhandled failure in worker pool: " + " ".join(f"frame {i} at unit{i}.call" for i in range(140))
    assert len(long) > 3200 and len(long.split()) > 400
    assert cases(spark, [f"<p>{long}</p>", long + "\n", *prose()]) == {0, 1}


def test_long_values_repeated_rows_and_empty_tables(spark):
    rows = spark.createDataFrame([("a", 0, "h", "text/plain", PROSE * 20_000 + "{{name}}", "x")] * 2, SCHEMA)
    assert r.verdicts(rows).count() == 1 and r.verdicts(rows.limit(0)).count() == 0


@pytest.mark.parametrize("text,expected", [("foo bar foo bar foo bar", True), ("test test test test", False), ("in et sed ut do non ad ex", False), ("The the the the the the the", True), ("", False)])
def test_filler(text, expected):
    assert r.is_filler(text) is expected


@pytest.mark.parametrize("page", ["<html><head><title>[[X]]</title></head><body><p>a b</p></body></html>", f"<html><body><ul><li><a href='/'>Home</a></li></ul><h1>T</h1><p>{PROSE}</p><p>Use <code>{{{{ x }}}}</code> here.</p><pre>${{a}}</pre><noscript>No scripts.</noscript></body></html>"])
def test_pages_and_values_are_read_alike(page):
    assert r.read_page(page, read_blocks(page)) == r.read_value(page)
