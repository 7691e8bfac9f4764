import random

import pytest

from foliant.llm import langid as lid

WORDS = {
    "en": "the choir measured water level each morning and kept a list of all visitors because road was wet".split(), "de": "der chor maß jeden morgen den wasserstand und führte eine liste aller gäste weil die straße nass war".split(),
    "es": "el coro medía cada mañana el nivel del agua y llevaba una lista de todos los visitantes porque camino mojado".split(), "pt": "o coro media todas as manhãs o nível da água e mantinha uma lista de todos os visitantes porque estrada molhada".split(),
    "ru": "хор измеряет уровень воды каждое утро и ведёт список всех гостей потому что дорога мокрая".split(),
}


def text(lang, rnd, n=4):
    return " ".join(" ".join(rnd.choices(WORDS[lang], k=9)).capitalize() + "." for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rnd = random.Random(2)
    rows = []
    for i in range(300):
        lang = list(WORDS)[i % 5]
        label = {0: lang.upper(), 1: {"en": "English", "de": "deu", "es": "es-MX", "pt": "pt_BR", "ru": "rus"}[lang]}.get(i % 7, lang)
        rows.append((i, text(lang, rnd), label, "x"))
    rows += [
        (1000, text("de", rnd), "en", "x"), (1001, text("de", rnd), None, "x"), (1002, text("es", rnd), "und", "x"), (1003, text("en", rnd) + "\n\n" + text("ru", rnd), "en", "x"), (1004, "```\nlet x = 1;\n```", None, "x"),
        (1005, None, None, "x"), (1006, "", "xx", "x"), (1007, text("pt", rnd) + "\n\n> " + text("es", rnd), "mul", "x"), (1008, text("en", rnd) + " http://der.die/das?und=nicht\n\n    der die das und nicht\n", "en", "x"), (1001, None, None, "x"),
    ]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, confidence string")


def test_cases(docs):
    got: dict = {}
    for r in lid.mislabelled_documents(docs).collect():
        got.setdefault(r["doc_id"], set()).add(r["lang"])
    assert got == {1000: {"de"}, 1001: {"de"}, 1002: {"es"}, 1003: {"en", "ru"}, 1007: {"es", "pt"}}


def test_segments_and_documents(docs):
    rows = [r for r in lid.language_segments(docs).collect() if r["doc_id"] == 1003]
    assert [r["lang"] for r in sorted(rows, key=lambda r: r["segment_no"])] == ["en", "ru"] and all(0.3 < r["confidence"] <= 1 for r in rows)
    whole = {r["doc_id"]: r for r in lid.document_languages(docs).collect()}
    assert whole[1000]["lang"] == "de" and sorted(whole[1003]["languages"]) == ["en", "ru"] and 1004 not in whole


def test_held_out_accuracy():
    rnd = random.Random(8)
    train = [(lang, lid.sentences(text(lang, rnd, 1))[0][2]) for lang in WORDS for _ in range(80)]
    noisy = [(rnd.choice(list(WORDS)), w) if rnd.random() < 0.08 else (lang, w) for lang, w in train]
    machines = lid.fit(noisy)
    test = [(lang, lid.sentences(text(lang, rnd, 1))[0][2]) for lang in WORDS for _ in range(60)]
    right = sum(machines.languages[int(machines.margins(w).argmax())] == lang for lang, w in test)
    assert right / len(test) > 0.98


def test_labels():
    same = {"en": "en", "EN": "en", "en-US": "en", "en_GB": "en", "eng": "en", "English": "en", "français": "fr", "pt-BR": "pt", " de ": "de"}
    assert {k: lid.normal_label(k) for k in same} == same
    assert all(lid.normal_label(x) is None for x in (None, "", "und", "mul", "unknown", "zz", "x-klingon"))


def test_sentences_skip_code_and_links():
    found = lid.sentences("One two three. Four http://five.six seven!\n\n    code here\n\n```\nmore code\n```\n<pre><code>x y</code></pre>\n- item one\n> quoted text?")
    assert [w for _, _, w in found] == [["One", "two", "three"], ["Four"], ["seven"], ["item", "one"], ["quoted", "text"]] or [w for _, _, w in found] == [["One", "two", "three"], ["Four", "seven"], ["item", "one"], ["quoted", "text"]]


def test_nothing_to_learn_from(spark):
    rows = spark.createDataFrame([(1, "Some text here.", None)], "doc_id bigint, text string, lang string")
    assert lid.mislabelled_documents(rows).count() == lid.mislabelled_documents(rows.limit(0)).count() == 0


def test_short_texts_of_short_sentences(docs, spark):
    rows = docs.union(spark.createDataFrame([(2000, "Straße nass.\n\nDer chor.\n\nGäste.", "en", "x"), (2001, "Straße nass. Der chor.", "de", "x")], docs.schema))
    got = {(r["doc_id"], r["lang"]) for r in lid.mislabelled_documents(rows).collect() if r["doc_id"] >= 2000}
    assert got == {(2000, "de")}


def test_batches_and_single_sentences_agree():
    rnd = random.Random(5)
    machines = lid.fit([(lang, lid.sentences(text(lang, rnd, 1))[0][2]) for lang in WORDS for _ in range(40)])
    batch = [lid.sentences(text(lang, rnd, 1))[0][2] for lang in WORDS for _ in range(9)]
    best, margins = machines.read(batch)
    lid.VOCABULARY_ROWS, before = 5, lid.VOCABULARY_ROWS  # starts anew at every call
    again = [machines.read([words]) for words in batch]
    lid.VOCABULARY_ROWS = before
    assert [int(b[0]) for b, _ in again] == best.tolist() and abs(sum(float(abs(m[0] - n).max()) for (_, m), n in zip(again, margins))) < 1e-3
    assert all(machines.kin[k] == (machines.sums[[machines.rows[w] for w in words]].sum(0) / machines.sizes[[machines.rows[w] for w in words]].sum() ** 0.5 + machines.bias)[: len(machines.families)].argmax() for k, words in zip(best, batch) if all(w in machines.rows for w in words))
