import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from foliant.llm import mixing, packing
from foliant.llm.tokens import counter, token_counts

WORDS = "the choir measured water level each morning and kept a list of it".split()


def texts(n, seed=1):
    rnd = random.Random(seed)
    return [" ".join(rnd.choices(WORDS, k=rnd.choice([1, 5, 30, 90, 300]))) for _ in range(n)]


@given(st.dictionaries(st.integers(1, 50), st.integers(1, 30), max_size=25))
@settings(max_examples=80, deadline=None)
def test_every_item_is_packed_once(histogram):
    packed = packing.pack(histogram, 50)
    total: dict[int, int] = {}
    for pattern, repeats in packed:
        assert repeats > 0 and sum(s * c for s, c in pattern) <= 50
        for s, c in pattern:
            total[s] = total.get(s, 0) + c * repeats
    assert total == histogram
    bins: list[int] = []  # first fit decreasing, item by item
    for s in sorted((s for s, c in histogram.items() for _ in range(c)), reverse=True):
        k = next((k for k, room in enumerate(bins) if room >= s), None)
        if k is None:
            bins.append(50 - s)
        else:
            bins[k] -= s
    assert sum(r for _, r in packed) <= 1.1 * len(bins) + 2


def test_patterns_fill_nearly_everything():
    rnd = random.Random(3)
    histogram: dict[int, int] = {}
    for _ in range(20_000):
        s = min(1024, int(rnd.lognormvariate(5, 1)) + 1)
        histogram[s] = histogram.get(s, 0) + 1
    packed = packing.pack(histogram, 1024)
    assert sum(s * c for s, c in histogram.items()) / (1024 * sum(r for _, r in packed)) > 0.99


def test_placement(spark):
    rows = list(enumerate(texts(300))) + [(7, texts(300)[7]), (1000, None), (1001, ""), (1002, " ".join(WORDS * 60))]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id bigint, text string, tokens int")
    kinds = spark.createDataFrame([("a", 64), ("b", 512), ("a", 64)], "container_kind string, capacity_tokens int")
    placed = packing.container_placement(docs, kinds).collect()
    size = dict((r["doc_id"], r["tokens"]) for r in token_counts(docs).collect())
    for kind, capacity in (("a", 64), ("b", 512)):
        own = [r for r in placed if r["container_kind"] == kind]
        used: dict = {}
        whole: dict = {}
        for r in own:
            used[r["container_no"]] = used.get(r["container_no"], 0) + r["tokens"]
            whole.setdefault(r["doc_id"], []).append(r["tokens"])
        assert max(used.values()) <= capacity and sorted(used) == list(range(len(used)))
        assert {d: sum(x) for d, x in whole.items()} == {d: n for d, n in size.items() if n}
        assert all(len(x) == 1 for d, x in whole.items() if size[d] <= capacity)
    fill = {r["container_kind"]: r["fill"] for r in packing.container_fill(packing.container_placement(docs, kinds), kinds).collect()}
    assert fill["b"] > 0.8
    assert packing.container_placement(docs.limit(0), kinds).count() == 0


def test_mixture(spark):
    docs = [(i, t, ["big", "small", None, "other"][min(3, i % 40 // 13 if i % 40 else 1)]) for i, t in enumerate(texts(1200, 5))]
    d = spark.createDataFrame([(*x, "q") for x in docs] + [(*docs[3], "q")], "doc_id bigint, text string, source string, repeats string")
    targets = spark.createDataFrame([("big", 0.6, 1), ("small", 0.3, 4), ("absent", 0.1, 2)], "source string, target_share double, max_repeats int")
    mixed = mixing.mixture(d, targets)
    rows = mixed.collect()
    assert len({r["doc_id"] for r in rows}) == len(rows) and {r["source"] for r in rows} == {"big", "small"}
    assert max(r["repeats"] for r in rows if r["source"] == "big") == 1 and max(r["repeats"] for r in rows if r["source"] == "small") <= 4
    share = {r["source"]: r for r in mixing.mixture_shares(mixed, targets).collect()}
    assert abs(share["big"]["share"] - 0.6 / 0.9) < 0.02 and share["absent"]["share"] == 0 and share["absent"]["n_docs"] == 0
    total = sum(r["tokens"] * r["repeats"] for r in rows)
    half = mixing.mixture(d, targets, total_tokens=total // 2).collect()
    assert abs(sum(r["tokens"] * r["repeats"] for r in half) - total / 2) < 0.05 * total
    small = {r["doc_id"]: r["repeats"] for r in half}
    assert all(small.get(r["doc_id"], 0) <= r["repeats"] for r in rows)
    assert mixing.mixture(d.limit(0), targets).count() == 0 and mixing.mixture(d, targets.limit(0)).count() == 0


def test_threshold_is_the_nearest(spark):
    rnd = random.Random(4)
    sizes = [(f"s{i % 3}", i, rnd.randrange(1, 90), rnd.randrange(1 << 60)) for i in range(900)]
    df = spark.createDataFrame(sizes, "source string, doc_id bigint, tokens bigint, hash bigint")
    got = mixing.thresholds(df, {"s0": 500.0, "s1": 5000.0, "s2": 1e9})
    for source, budget in (("s0", 500), ("s1", 5000)):
        own = sorted((h, t) for s, _, t, h in sizes if s == source)
        best = min(abs(sum(t for _, t in own[:k]) - budget) for k in range(len(own) + 1))
        assert abs(sum(t for h, t in own if h < got[source]) - budget) <= best + 1e-9
    assert all(h < got["s2"] for s, _, _, h in sizes if s == "s2")


@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_50k.json", "piece_bpe_32k.model", "word_bpe_49k.json"])
def test_tokenizers(name):
    count = counter(f"/opt/tokenizers/{name}")
    assert 5 <= count("The choir measured the water level.") <= 12 and count("<|endoftext|>") > 1


def test_both_forms_of_one_vocabulary_agree():
    a, b = counter("/opt/tokenizers/byte_bpe_50k.tiktoken"), counter("/opt/tokenizers/byte_bpe_50k.json")
    assert all(a(t) == b(t) for t in texts(20) + ["Ünïcode 日本語 text\n\n  x  "])


def test_one_kind_with_two_capacities(spark):
    docs = spark.createDataFrame(list(enumerate(texts(200))), "doc_id bigint, text string")
    kinds = spark.createDataFrame([("a", 64), ("a", 512)], "container_kind string, capacity_tokens int")
    placed = packing.container_placement(docs, kinds)
    size = {r["doc_id"]: r["tokens"] for r in token_counts(docs).collect()}
    for capacity in (64, 512):
        own = placed.filter(f"capacity_tokens = {capacity}").collect()
        assert sum(r["tokens"] for r in own) == sum(size.values())
    assert {(r["container_kind"], r["capacity_tokens"]) for r in packing.container_fill(placed, kinds).collect()} == {("a", 64), ("a", 512)}


def test_few_texts_share_well(spark):
    docs = [(i, t, "big" if i % 10 else "small") for i, t in enumerate(texts(400, 9))]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([("big", 0.93, 1), ("small", 0.07, 9)], "source string, target_share double, max_repeats int")
    mixed = mixing.mixture(d, targets)
    share = {r["source"]: r for r in mixing.mixture_shares(mixed, targets).collect()}
    assert abs(share["small"]["share"] - 0.07) < 0.02 * 0.07 and abs(share["big"]["share"] - 0.93) < 0.02 * 0.93
    assert mixed.count() == mixed.select("doc_id").distinct().count()


def test_a_total_that_cant_be_met_is_reported(spark):
    d = spark.createDataFrame([(i, t, "big" if i % 10 else "small") for i, t in enumerate(texts(400, 9))], "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.5, 2)], "source string, target_share double, max_repeats int")
    total = 4 * sum(r["tokens"] for r in token_counts(d).collect())
    rows = mixing.mixture(d, targets, total_tokens=total)
    share = {r["source"]: r for r in mixing.mixture_shares(rows, targets, total).collect()}
    assert share["small"]["most_repeats"] == 2 and share["big"]["most_repeats"] == 1 and rows.count() == 400
    assert all(r["missing_tokens"] == total // 2 - r["tokens"] > 0 for r in share.values())
