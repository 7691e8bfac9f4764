"""Problem 6: filling containers of fixed capacity with texts, none split unless it is larger than a container.

Method: pattern packing by non-negative least squares. The histogram of text lengths (at most ``capacity`` entries) comes
to the driver; patterns of a few lengths that fill a container nearly are enumerated; their repeat counts are fitted to the
histogram by non-negative least squares, rounded down, and what is left is packed best-fit decreasing, on counts as well.
Both give patterns with repeat counts, so a text's container follows from its length and its rank among texts of that
length: the ranks come from per-partition counts, never from one sorted list.

A text of more tokens than the capacity is cut into whole containers and one rest.

Defined results: a text without tokens needs no container and gets none; ties have no effect on the fill; repeated rows of
one id are placed once; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.tokens import TOKENIZERS, VOCABULARY, token_counts
from foliant.runtime import materialize

#: Most lengths in one enumerated pattern, patterns enumerated per leading length, and waste a pattern may leave.
PATTERN_ITEMS, PATTERNS_PER_LENGTH, PATTERN_WASTE = 4, 6, 0.004

#: Ranges of ranks that are broadcast; more are joined by length.
BROADCAST_SLOTS = 500_000
KIND = ("container_kind", "capacity_tokens")

Pattern = tuple[tuple[int, int], ...]  # (length, copies) pairs


def enumerate_patterns(lengths: np.ndarray, capacity: int) -> list[Pattern]:
    """Patterns of at most ``PATTERN_ITEMS`` of the given lengths that leave at most ``PATTERN_WASTE`` of the capacity."""
    have = np.zeros(capacity + 1, dtype=bool)
    have[lengths] = True
    floor = int(capacity * (1 - PATTERN_WASTE))
    desc = lengths[::-1]
    out: set[Pattern] = set()
    best_below = np.maximum.accumulate(np.where(have, np.arange(capacity + 1), 0))  # the largest length up to each size
    for lead in desc:
        found = 0
        rest = capacity - lead
        if rest <= capacity - floor:
            out.add(((int(lead), 1),))
            continue
        seconds = desc[(desc <= rest) & (desc <= lead)]
        picks = seconds[np.unique(np.linspace(0, len(seconds) - 1, min(len(seconds), 24)).astype(int))] if len(seconds) else seconds
        closest = int(best_below[rest]) if best_below[rest] <= lead else 0
        for second in [closest, *picks.tolist()]:
            if not second:
                continue
            items = [int(lead), int(second)]
            left = rest - second
            while left > 0 and len(items) < PATTERN_ITEMS and (nxt := int(best_below[min(left, items[-1])])):
                # the last item closes the gap, the ones before halve it
                pick = nxt if len(items) == PATTERN_ITEMS - 1 or nxt >= left * 0.98 else int(best_below[max(1, min(items[-1], left // 2))]) or nxt
                items.append(pick)
                left -= pick
            if capacity - left >= floor:
                sizes, copies = np.unique(items, return_counts=True)
                out.add(tuple(zip(sizes.tolist(), copies.tolist())))
                found += 1
                if found >= PATTERNS_PER_LENGTH:
                    break
    return sorted(out)


def non_negative_least_squares(patterns: list[Pattern], lengths: np.ndarray, counts: np.ndarray, steps: int = 300) -> np.ndarray:
    """Repeat counts x >= 0 that bring the patterns' lengths nearest to the histogram, by accelerated projected gradient."""
    place = {int(x): i for i, x in enumerate(lengths)}
    rows = np.array([place[size] for p in patterns for size, _ in p])
    cols = np.array([j for j, p in enumerate(patterns) for _ in p])
    vals = np.array([copies for p in patterns for _, copies in p], dtype=float)
    scale = 1.0 / np.sqrt(np.maximum(1.0, counts))  # relative errors, so that rare lengths count too
    vals = vals * scale[rows]
    target = counts * scale
    n, m = len(patterns), len(lengths)
    # a bound of the largest singular value squared
    bound = np.bincount(rows, vals, m).max(initial=1e-9) * np.bincount(cols, vals, n).max(initial=1e-9)
    x = np.zeros(n)
    y, t = x, 1.0
    for _ in range(steps):
        gradient = np.bincount(cols, vals * (np.bincount(rows, vals * y[cols], m) - target)[rows], n)
        nxt = np.maximum(0.0, y - gradient / bound)
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = nxt + (t - 1) / t_next * (nxt - x)
        x, t = nxt, t_next
    return x


def pack(histogram: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """(pattern, repeats) that hold exactly the histogram's lengths (each from 1 to the capacity)."""
    lengths = np.array(sorted(histogram), dtype=np.int64)
    left = np.array([histogram[int(x)] for x in lengths], dtype=np.int64)
    place = {int(x): i for i, x in enumerate(lengths)}
    out: list[tuple[Pattern, int]] = []
    patterns = enumerate_patterns(lengths, capacity) if len(lengths) else []
    if patterns:
        wanted = np.floor(non_negative_least_squares(patterns, lengths, left.astype(float))).astype(np.int64)
        for j in np.argsort(-wanted, kind="stable"):
            repeats = int(min([wanted[j], *(left[place[size]] // copies for size, copies in patterns[j])]))
            if repeats > 0:
                out.append((patterns[j], repeats))
                for size, copies in patterns[j]:
                    left[place[size]] -= copies * repeats
    # the residuals: best fit decreasing on classes of equal containers, as (room, contents, count)
    open_at: dict[int, list[list]] = {}
    rooms = np.zeros(capacity + 1, dtype=np.int64)
    for size, count in zip(lengths[::-1].tolist(), left[::-1].tolist()):
        while count > 0:
            fits = np.flatnonzero(rooms[size:])
            if not len(fits):
                per = capacity // size
                full, rest = divmod(count, per)
                for copies, repeats in ((per, full), (rest, 1)):
                    if copies and repeats:
                        room = capacity - copies * size
                        open_at.setdefault(room, []).append([((size, copies),), repeats])
                        rooms[room] += repeats
                break
            room = size + int(fits[0])
            group = open_at[room].pop()
            rooms[room] -= group[1]
            per = min(room // size, count)
            take = min(group[1], count // per)
            if group[1] > take:
                open_at[room].append([group[0], group[1] - take])
                rooms[room] += group[1] - take
            open_at.setdefault(room - per * size, []).append([(*group[0], (size, per)), take])
            rooms[room - per * size] += take
            count -= per * take
    for groups in open_at.values():
        out += [(tuple(sorted(g[0])), g[1]) for g in groups]
    return out


def length_ranks(sizes: DataFrame) -> DataFrame:
    """``rank``: the number of each row among those of its kind and length, from 0.

    Rows are counted per hash bucket first; only the counts are ordered, and the order inside a bucket is a small window.
    """
    buckets = sizes.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(4096)))
    counts = buckets.groupBy(*KIND, "size", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy(*KIND, "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*KIND, "size", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy(*KIND, "size", "bucket").orderBy("doc_id", "piece")
    return buckets.withColumn("inside", F.row_number().over(inside) - 1).join(offsets, [*KIND, "size", "bucket"]).withColumn("rank", F.col("offset") + F.col("inside")).drop("bucket", "inside", "offset")


_SLOTS = "container_kind string, capacity_tokens int, size int, first_rank bigint, end_rank bigint, copies int, base bigint"


def container_placement(documents: DataFrame, containers: DataFrame, vocabulary: str = VOCABULARY, folder: str = TOKENIZERS) -> DataFrame:
    """(container_kind, capacity_tokens, container_no, doc_id, piece, tokens): where each text goes, for each kind of container.

    A kind that is listed with several capacities is packed for each.

    ``piece`` numbers the parts of a text larger than the container, and is 0 for a whole text.
    """
    spark = documents.sparkSession
    # a handful of kinds, written by a person
    kinds = sorted({(r["container_kind"], r["capacity_tokens"]) for r in containers.filter("capacity_tokens > 0").select("container_kind", "capacity_tokens").distinct().collect()})
    if not kinds:
        return spark.createDataFrame([], "container_kind string, capacity_tokens int, container_no bigint, doc_id bigint, piece int, tokens int")
    counted = materialize(token_counts(documents, vocabulary, folder).groupBy("doc_id").agg(F.max("tokens").alias("tokens")).filter("tokens > 0"), "tokens")
    # each text once for each kind: as many rows as the result has
    each = counted.select("doc_id", "tokens", F.inline(F.array(*(F.struct(F.lit(k).alias("container_kind"), F.lit(c).cast("int").alias("capacity_tokens")) for k, c in kinds))))
    whole = F.floor(F.col("tokens") / F.col("capacity_tokens")).cast("int")
    rest = (F.col("tokens") - whole * F.col("capacity_tokens")).cast("int")
    pieces = F.when(F.col("tokens") <= F.col("capacity_tokens"), F.array(F.col("tokens").cast("int"))).otherwise(F.concat(F.array_repeat("capacity_tokens", whole), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<int>"))))
    items = each.select("container_kind", "capacity_tokens", "doc_id", F.posexplode(pieces).alias("piece", "size"))
    # at most ``capacity`` rows for each kind of container
    rows = items.groupBy("container_kind", "capacity_tokens", "size").agg(F.count("*").alias("n")).collect()
    slots: list[tuple] = []
    for kind, capacity in sorted({(r["container_kind"], r["capacity_tokens"]) for r in rows}):
        histogram = {r["size"]: r["n"] for r in rows if r["container_kind"] == kind and r["capacity_tokens"] == capacity}
        used: dict[int, int] = {}
        base = 0
        for pattern, repeats in pack(histogram, capacity):
            for size, copies in pattern:
                first = used.get(size, 0)
                used[size] = first + copies * repeats
                slots.append((kind, capacity, size, first, used[size], copies, base))
            base += repeats
    table = spark.createDataFrame(pd.DataFrame(slots, columns=["container_kind", "capacity_tokens", "size", "first_rank", "end_rank", "copies", "base"]) if slots else [], _SLOTS)
    ranked = length_ranks(items.select(*KIND, "doc_id", "piece", "size"))
    # a row per kind and length with its ranges of ranks in order: bounded by the patterns (a few per length), not by the
    # texts, and broadcast if its size, known to the driver that made it, allows it; a text finds its range in the array,
    # without being multiplied by the ranges first
    slot = F.struct("end_rank", "first_rank", "copies", "base")
    ranges = table.groupBy(*KIND, "size").agg(F.array_sort(F.collect_list(slot)).alias("slots"))
    joined = ranked.join(F.broadcast(ranges) if len(slots) <= BROADCAST_SLOTS else ranges, [*KIND, "size"]).withColumn("slot", F.filter("slots", lambda s: (F.col("rank") >= s["first_rank"]) & (F.col("rank") < s["end_rank"]))[0])
    number = F.col("slot.base") + F.floor((F.col("rank") - F.col("slot.first_rank")) / F.col("slot.copies"))
    return joined.select(*KIND, number.cast("bigint").alias("container_no"), "doc_id", "piece", F.col("size").alias("tokens"))


def container_fill(placement: DataFrame, containers: DataFrame) -> DataFrame:
    """(container_kind, capacity_tokens, n_containers, n_items, tokens, fill): how full the containers of each kind are."""
    used = placement.groupBy(*KIND, "container_no").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("items"))
    per = used.groupBy(*KIND).agg(F.count("*").alias("n_containers"), F.sum("items").alias("n_items"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("largest"))
    return per.join(F.broadcast(containers.select(*KIND).distinct()), list(KIND)).withColumn("fill", F.col("tokens") / (F.col("n_containers") * F.col("capacity_tokens")))
