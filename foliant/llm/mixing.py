"""Problem 7: mixing sources to target shares of the tokens, small sources repeated a capped number of times.

Method: hash-threshold histograms. Tokens are summed by source and hash bucket; the budget of a source falls into one
bucket, which alone is refined by the next digits of the hash, until one text's hash is the threshold. Every text whose
hash lies below it is taken once more than the others: no sort, and a larger budget takes a superset of a smaller one.

The total is the largest at which every source that has texts can give its share within its repeats, unless one is given.
Of a budget that is no given one, what the threshold leaves is filled up behind it with texts that are small enough, by
further thresholds among these, until less than ``FILL_SHARE`` is left or nothing fits: few texts share their source well
too. With a given total the thresholds stay nested, and a source that can't give its budget gives all it may; the report
says what is missing.

Defined results: texts of no target source, or of a null one, are not taken; a target without texts gives nothing and is
reported with share 0, the others share the total in proportion; a null or negative ``max_repeats`` counts as 1; texts of
one and the same hash (60 bits of it) are taken together; repeated rows of one id count once; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.tokens import TOKENIZERS, VOCABULARY, token_counts
from foliant.runtime import materialize

#: Digits of the hash that one pass of refinement looks at.
BITS = 12
#: The part of a source's budget that may be left.
FILL_SHARE = 0.005
#: All bits of the hash that are used.
HASH_BITS = 60


def _hash() -> Column:
    """60 bits of a text's hash, fixed for its id."""
    return F.shiftrightunsigned(F.xxhash64(F.lit("mix"), "doc_id"), 4)


def thresholds(sizes: DataFrame, budgets: dict[str, float], nearest: bool = True) -> dict[str, int]:
    """For each source the hash below which its texts come nearest to the budget of tokens (or don't exceed it)."""
    return {s: low for s, (low, _) in _thresholds(sizes, budgets, nearest).items()}


def _thresholds(sizes: DataFrame, budgets: dict[str, float], nearest: bool) -> dict[str, tuple[int, float]]:
    """The same with the tokens left."""
    low = {s: 0 for s in budgets}
    left = dict(budgets)
    shift = HASH_BITS
    while shift > 0 and low:
        shift = max(0, shift - BITS)
        spark = sizes.sparkSession
        bounds = spark.createDataFrame([(s, low[s]) for s in budgets], "source string, low bigint")
        # only the boundary bucket of each source is read again; it has at most 2**BITS rows here
        inside = sizes.join(F.broadcast(bounds), "source").filter(F.shiftright(F.col("hash"), min(HASH_BITS, shift + BITS)) == F.shiftright(F.col("low"), min(HASH_BITS, shift + BITS)))
        rows = inside.groupBy("source", F.shiftright("hash", shift).alias("bucket")).agg(F.sum("tokens").alias("tokens")).collect()
        per: dict[str, list[tuple[int, int]]] = {}
        for r in rows:
            per.setdefault(r["source"], []).append((r["bucket"], r["tokens"]))
        for source, buckets in per.items():
            for bucket, tokens in sorted(buckets):
                if tokens > left[source]:
                    # the last text is taken too if that comes nearer
                    over = nearest and shift == 0 and tokens - left[source] < left[source]
                    low[source] = (bucket + over) << shift
                    left[source] -= tokens if over else 0
                    break
                left[source] -= tokens
            else:
                low[source] = (max(b for b, _ in buckets) + 1) << shift
                if shift:  # all of them are taken: there is no boundary bucket to refine
                    low[source] = 1 << HASH_BITS
    return {s: (low[s], left[s]) for s in budgets}


def _filled(sizes: DataFrame, budgets: dict[str, float]) -> dict[str, list[tuple[int, int, int]]]:
    """(from, to, most tokens) of the hashes that fill each budget: the threshold, and the intervals behind it."""
    found = _thresholds(sizes, budgets, False)
    rules = {s: [(0, low, 1 << 62)] for s, (low, _) in found.items()}
    open_ = {s: x for s, x in found.items() if x[1] > FILL_SHARE * budgets[s]}
    while open_:  # every round takes a text at least, or closes the source
        bounds = sizes.sparkSession.createDataFrame([(s, low, int(left)) for s, (low, left) in open_.items()], "source string, behind bigint, room bigint")
        fitting = sizes.join(F.broadcast(bounds), "source").filter((F.col("hash") >= F.col("behind")) & (F.col("tokens") <= F.col("room"))).select("source", "hash", "tokens")
        after = _thresholds(fitting, {s: left for s, (_, left) in open_.items()}, False)
        still = {}
        for s, (low, left) in after.items():
            behind, room = open_[s]
            if low > behind and left < room:
                rules[s].append((behind, low, int(room)))
                if left > FILL_SHARE * budgets[s]:
                    still[s] = (low, left)
        open_ = still
    return rules


def mixture(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, vocabulary: str = VOCABULARY, folder: str = TOKENIZERS) -> DataFrame:
    """(doc_id, source, tokens, repeats) of the texts taken."""
    # a row per source of the mixture, a list a person has written
    wanted = {r["source"]: (float(r["target_share"]), max(1, r["max_repeats"] or 1)) for r in targets.collect() if r["source"] is not None and (r["target_share"] or 0) > 0}
    known = documents.filter(F.col("source").isin(list(wanted)))
    counted = token_counts(known, vocabulary, folder, ("doc_id", "source"))
    sizes = materialize(counted.groupBy("doc_id").agg(F.min("source").alias("source"), F.max("tokens").alias("tokens")).filter("tokens > 0").withColumn("hash", _hash()), "mix")
    have = {r["source"]: r["tokens"] for r in sizes.groupBy("source").agg(F.sum("tokens").alias("tokens")).collect()}
    shares = {s: wanted[s][0] for s in have}
    scale = sum(shares.values()) or 1.0
    most = min((have[s] * wanted[s][1] * scale / shares[s] for s in have), default=0.0)
    total = most if total_tokens is None else float(total_tokens)
    budget = {s: min(total * shares[s] / scale, have[s] * wanted[s][1]) for s in have}
    turns = {s: min(wanted[s][1], int(budget[s] // have[s])) for s in have}
    once_more = {s: budget[s] - turns[s] * have[s] for s in have if turns[s] < wanted[s][1]}
    if total_tokens is None:
        rules = _filled(sizes, once_more) if once_more else {}
    else:
        rules = {s: [(0, low, 1 << 62)] for s, low in (thresholds(sizes, once_more) if once_more else {}).items()}
    plan = sizes.sparkSession.createDataFrame([(s, turns[s], rules.get(s, [])) for s in have], "source string, turns int, rules array<struct<low:bigint,high:bigint,most:bigint>>")
    more = F.exists("rules", lambda r: (F.col("hash") >= r["low"]) & (F.col("hash") < r["high"]) & (F.col("tokens") <= r["most"]))
    # a row per source, with a few intervals
    return sizes.join(F.broadcast(plan), "source").select("doc_id", "source", "tokens", (F.col("turns") + more.cast("int")).alias("repeats")).filter("repeats > 0")


def mixture_shares(mixed: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """(source, target_share, max_repeats, n_docs, tokens, share, most_repeats, missing_tokens): what was reached, for every target.

    ``missing_tokens`` are those of a given total that the source couldn't give.
    """
    per = mixed.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"), F.max("repeats").alias("most_repeats"))
    # a row per source by now
    per = per.withColumn("total", F.sum("tokens").over(Window.partitionBy(F.lit(0))))
    joined = targets.select("source", "target_share", "max_repeats").join(per, "source", "left")
    zero = F.lit(0).cast("bigint")
    tokens = F.coalesce("tokens", zero)
    # a text more or less is no shortage
    missing = F.lit(0.0) if total_tokens is None else F.greatest(F.lit(0.0), F.col("target_share") * total_tokens - tokens)
    return joined.select(
        "source", "target_share", "max_repeats", F.coalesce("n_docs", zero).alias("n_docs"), tokens.alias("tokens"), F.coalesce(F.col("tokens") / F.col("total"), F.lit(0.0)).alias("share"),
        F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"), missing.cast("bigint").alias("missing_tokens"),
    )
