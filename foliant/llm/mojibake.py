"""Problem 4: text decoded with the wrong character encoding.

Method: (1) every token and short line with characters outside ASCII is reduced to its ASCII skeleton; texts of one
skeleton are near-twins, of which the most frequent is the clean one. (2) Twins are aligned run by run between their
common ASCII characters; a pair of charsets that turns the clean runs into the garbled ones is a learned transformation,
kept if enough different runs support it. (3) The learned transformations are tried on every remaining token of every
record; a reading is accepted if its characters follow each other as those of the whole corpus do and the given ones don't.

Counts of characters and pairs cover all records. What reaches the driver is bounded: the transformations by the number of
charset pairs, the pairs of characters by ``1 / MIN_SHARE``.

Defined results: null and plain ASCII values are no cases; RFC 2047 words are ASCII and so no cases; correct text under an
untrue label is no case; repeated rows count once; replacement characters and C1 controls inside a text are cases that
can't be restored; extra columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

import codecs
import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.runtime import materialize

#: Charsets a text can have been written in, and read in. Fixed values.
WRITTEN = ("utf-8", "cp1252", "cp1251", "koi8-r", "cp1250", "iso8859-2", "cp866", "mac-roman", "cp437", "shift_jis", "euc_jp")
READ = ("cp1252", "cp1251", "cp1250", "koi8-r", "cp437", "cp850", "cp866", "mac-roman", "mac-cyrillic", "iso8859-2", "iso8859-5", "iso8859-15")
#: Different aligned runs a transformation needs, in which the clean side reads better by so much and is not garbled itself.
MIN_RUNS, MIN_GAIN = 3, 0.3
#: A twin is taken for clean by number alone if it comes so many times more often.
CLEAN_RATIO = 2
#: Pairs of characters of a smaller share than this count as unseen.
MIN_SHARE = 2e-6

_RUN = re.compile(r"[A-Za-z]*[^\x00-\x7f][^\x00-\x40\x5b-\x60\x7b-\x7f]*")
_OUTSIDE = re.compile(r"[^\x00-\x7f]+")
_LINES = re.compile(r"[<>\n\r\"{}]+")
_LOST = re.compile("[\x80-\x9f�]")
#: Characters of the Latin supplement in a row with symbols among them: bytes of an unknown charset, never words.
_BYTES = re.compile("[\xa1-\xff]{6,}")
_SYMBOLS = re.compile("[\xa1-\xbf\xd7\xf7]")
_KANA = re.compile("[\u3040-\u30ff]")
_ALNUM = re.compile(r"[A-Za-z0-9]")
_ENTITY = re.compile(r"&(?:#[0-9]{3,7}|#[xX][0-9a-fA-F]{2,6}|[A-Za-z][A-Za-z0-9]{1,31});")
#: The same for a filter in the plan.
ENTITIES = r"&(#[0-9]{3,7}|#[xX][0-9a-fA-F]{2,6}|[A-Za-z][A-Za-z0-9]{1,31});"


def without_entities(data: str) -> str:
    """The value with the references to characters outside ASCII replaced by these: garbled text may have been escaped."""

    def one(m: re.Match) -> str:
        c = html.unescape(m[0])
        # numbers beyond the last character stand for none
        return m[0] if c.isascii() or (c == "\ufffd" and m[0].lower() not in ("&#65533;", "&#xfffd;")) else c

    return _ENTITY.sub(one, data) if "&" in data else data


def _table(name: str) -> str:
    """The charset's 256 characters; bytes without one stand for the control of their number, as browsers read them."""
    return "".join(bytes([i]).decode(name, "ignore") or chr(i) for i in range(256))


_TABLES = {n: _table(n) for n in {*READ, *WRITTEN} - {"utf-8", "shift_jis", "euc_jp"}}
_MAPS = {n: codecs.charmap_build(t) for n, t in _TABLES.items()}


def reread(text: str, written: str, read: str) -> str | None:
    """``text`` put back into the bytes it was read from as ``read``, and read as ``written``; None where that fails."""
    try:
        raw = codecs.charmap_encode(text, "strict", _MAPS[read])[0]
        return codecs.charmap_decode(raw, "strict", _TABLES[written])[0] if written in _TABLES else raw.decode(written)
    except (UnicodeError, ValueError):
        return None


def _explain(bad: str, good: str) -> Iterator[tuple[str, str]]:
    """The charset pairs that turn ``good`` into ``bad``, applied once or twice."""
    for written in WRITTEN:
        for read in READ:
            if written == read:
                continue
            once = reread(bad, written, read)
            if once is None:
                continue
            if once == good or (written == "utf-8" and once != bad and reread(once, written, read) == good):
                yield written, read


def _pairs(token: str) -> Iterator[str]:
    """Pairs of neighbouring characters of which one is outside ASCII, with the token's edges."""
    last = " "
    for c in token:
        if c > "\x7f" or last > "\x7f":
            yield last + c
        last = c
    if last > "\x7f":
        yield last + " "


_COUNTS = pa.schema([("skeleton", pa.int64()), ("text", pa.string()), ("n", pa.int64())])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per partition: (skeleton, text, n) of tokens and lines, and (null, pair, n) of character pairs."""
    texts: Counter[str] = Counter()
    lines: Counter[str] = Counter()

    def flush() -> pa.RecordBatch:
        pairs: Counter[str] = Counter()
        keys, values, counts = [], [], []
        for token, n in texts.items():
            for p in _pairs(token):
                pairs[p] += n
            skeleton = _OUTSIDE.sub("\x00", token)
            if len(skeleton) - skeleton.count("\x00") >= 3:
                keys.append(skeleton)
                values.append(token)
                counts.append(n)
        for line, n in lines.items():
            keys.append("\x01" + _OUTSIDE.sub("\x00", line))
            values.append(line)
            counts.append(n)
        hashed = [xxhash.xxh64_intdigest(k) - (1 << 63) for k in keys] + [None] * len(pairs)
        out = pa.RecordBatch.from_arrays([pa.array(hashed, pa.int64()), pa.array(values + list(pairs), pa.string()), pa.array(counts + list(pairs.values()), pa.int64())], schema=_COUNTS)
        texts.clear()
        lines.clear()
        return out

    for batch in batches:
        for data in map(without_entities, batch.column(0).to_pylist()):
            found = _RUN.findall(data)
            texts.update(found)
            # lines of other scripts have no ASCII letters in their words: their names and numbers are the skeleton
            joined = "".join(found)
            if len(joined) > 1.5 * len(_OUTSIDE.sub("", joined)) + 8:
                for line in _LINES.split(data):
                    if not line.isascii() and len(_ALNUM.findall(line)) >= 6:
                        lines[line] += 1
        if len(texts) + len(lines) > 200_000:
            yield flush()
    yield flush()


_EXPLAINED = pa.schema([("written", pa.string()), ("read", pa.string()), ("bad", pa.string()), ("good", pa.string()), ("n", pa.int64())])


def _align(model: dict[str, float], floor: float):
    judge = Restorer([], model, floor)

    def mean(text: str) -> float:
        total, n = judge.likelihood(text)
        return total / max(1, n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[tuple[str, str], list[tuple[str, str]]] = {}
        for batch in batches:
            out: list[tuple] = []
            for bad, good, n, n_good in zip(*(batch.column(i).to_pylist() for i in range(4))):
                better = mean(good) - mean(bad)
                if n_good < CLEAN_RATIO * n and better < 0:  # too near to tell by number: the clean one reads better
                    if better <= -MIN_GAIN and n_good <= n:
                        bad, good, better = good, bad, -better
                if better < MIN_GAIN:
                    continue
                for x, y in zip(_OUTSIDE.findall(bad), _OUTSIDE.findall(good)):
                    if x != y:
                        if (x, y) not in cache:
                            cache[x, y] = list(_explain(x, y))
                        out += [(w, r, x, y, n) for w, r in cache[x, y]]
            cols = list(zip(*out)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _EXPLAINED)], schema=_EXPLAINED)

    return run


def outside_ascii(values: DataFrame) -> DataFrame:
    """The values with characters outside ASCII, or with references to characters."""
    data = F.col("data")
    return values.filter((F.length(data) != F.octet_length(data)) | (data.contains("&") & data.rlike(ENTITIES)))


def counts(values: DataFrame) -> DataFrame:
    """The counts of tokens, lines and character pairs of all values with characters outside ASCII, kept as a table."""
    rows = outside_ascii(values).select("data")
    return materialize(rows.mapInArrow(_count, "skeleton bigint, text string, n bigint"), "charsets")


def learn(table: DataFrame, model: dict[str, float], floor: float) -> list[tuple[str, str]]:
    """The learned transformations (written, read), best supported first.

    An aligned run that several transformations explain counts for the one that explains the most runs, so that look-alikes
    of a true transformation don't live on its evidence. Runs whose clean side is the garbled one of other pairs more often are
    no evidence. What is kept has ``MIN_RUNS`` runs of its own, whatever the others have.
    """
    texts = table.filter(F.col("skeleton").isNotNull()).groupBy("skeleton", "text").agg(F.sum("n").alias("n"))
    clean = texts.groupBy("skeleton").agg(F.max_by("text", F.struct("n", "text")).alias("good"), F.max("n").alias("n_good"), F.count("*").alias("twins")).filter(F.col("twins") > 1).drop("twins")
    pairs = texts.join(clean, "skeleton").filter(F.col("text") != F.col("good")).select("text", "good", "n", "n_good")
    found = pairs.mapInArrow(_align(model, floor), "written string, read string, bad string, good string, n bigint")
    every = materialize(found.groupBy("written", "read", "bad", "good").agg(F.sum("n").alias("n")), "runs")
    sides = every.select("n", F.inline(F.array(F.struct(F.col("good").alias("side"), F.lit(1).alias("as_good")), F.struct(F.col("bad").alias("side"), F.lit(-1).alias("as_good")))))
    garbled = sides.groupBy("side").agg(F.sum(F.col("n") * F.col("as_good")).alias("balance")).filter("balance < 0")
    runs = every.join(garbled.select(F.col("side").alias("good")), "good", "left_anti")
    totals = runs.groupBy("written", "read").agg(F.count("*").alias("explained"))
    # a row per pair of charsets at most
    best = runs.join(F.broadcast(totals), ["written", "read"]).groupBy("bad", "good").agg(F.max_by(F.struct("written", "read"), F.struct("explained", "written", "read")).alias("by"))
    own = best.groupBy("by.written", "by.read").agg(F.count("*").alias("runs")).filter(F.col("runs") >= MIN_RUNS).collect()
    return [(r["written"], r["read"]) for r in sorted(own, key=lambda r: (-r["runs"], r["written"], r["read"]))]


def pair_model(table: DataFrame) -> tuple[dict[str, float], float]:
    """Log shares of character pairs, and that of an unseen one. At most 1 / MIN_SHARE pairs reach the driver."""
    pairs = table.filter(F.col("skeleton").isNull()).groupBy("text").agg(F.sum("n").alias("n"))
    total = (pairs.agg(F.sum("n")).first()[0] or 0) + 1
    kept = pairs.filter(F.col("n") >= F.greatest(F.lit(2.0), F.lit(MIN_SHARE * total))).collect()
    return {r["text"]: math.log(r["n"] / total) for r in kept}, math.log(min(0.5, max(1.0, MIN_SHARE * total) / total)) - 1.0


class Restorer:
    """Decides for each token whether it is garbled, and what it was."""

    def __init__(self, transformations: list[tuple[str, str]], model: dict[str, float], floor: float):
        self.transformations, self.model, self.floor = transformations, model, floor
        self.single = [(w, r) for w, r in transformations if w in _TABLES]
        self.multi = [(w, r) for w, r in transformations if w not in _TABLES]
        self.cache: dict[str, str | None] = {}

    def likelihood(self, token: str) -> tuple[float, int]:
        total, n = 0.0, 0
        for p in _pairs(token):
            total += self.model.get(p, self.floor)
            n += 1
        return total, n

    def fix(self, token: str) -> str | None:
        """The token's likely original (itself, if that can't be told), or None if it is in order."""
        if token in self.cache:
            return self.cache[token]
        if len(self.cache) > 400_000:
            self.cache.clear()
        found = self.cache[token] = self._fix(token)
        return found

    def _fix(self, token: str) -> str | None:
        given, n = self.likelihood(token)
        mean = given / max(1, n)
        best, gain = None, 0.0
        for written, read in self.multi:
            text = token
            for _ in range(3):
                text = reread(text, written, read)
                if text is None or text == token:
                    break
                if _LOST.search(text):
                    continue
                total, m = self.likelihood(text)
                new = total / m if m else 0.0
                outside = sum(c > "\x7f" for c in text)
                # two whole sequences hardly come about by chance; one must also read better
                better = new - mean
                if (outside >= 2 and better > -1.5 and new > self.floor + 1.0) or better > 0.7 or (m == 0 and mean < -9):
                    if best is None or better > gain:
                        best, gain = text, better
                if text.isascii():
                    break
        if best is not None:
            return best
        for raw in _BYTES.findall(token):
            if len(_SYMBOLS.findall(raw)) >= 2:
                for written in ("euc_jp", "shift_jis"):
                    text = reread(token, written, "cp1252")
                    if text and _KANA.search(text):
                        return text
                best, gain = token, 2.0
        if len(token) < 2:
            return None
        for written, read in self.single:
            text = reread(token, written, read)
            if text is None or text == token or _LOST.search(text):
                continue
            total, m = self.likelihood(text)
            better = (total - given) / max(1, n)
            if total - given > 5.0 and better > 1.6 and better > gain and total / max(1, m) > self.floor + 1.5:
                best, gain = text, better
        return best

    def check(self, data: str) -> bool:
        """True if the value holds garbled characters."""
        data = without_entities(data)
        if _LOST.search(data):
            return True
        return any(self.fix(t) is not None for t in set(_RUN.findall(data)))

    def restore(self, data: str) -> str:
        """The value with every garbled token put right, as far as it can be; references to its characters become these."""
        return _RUN.sub(lambda m: self.fix(m[0]) or m[0], without_entities(data))


def _values(parts: DataFrame, archives: DataFrame) -> DataFrame:
    """(archive_id, part_no, header, data): the text of parts, and each value of archive headers as part -1."""
    headers = archives.select("archive_id", F.lit(-1).alias("part_no"), F.explode("headers").alias("header", "data"))
    own = parts.select("archive_id", F.col("part_no").cast("int").alias("part_no"), F.lit(None).cast("string").alias("header"), "data")
    return own.unionByName(headers)


def fit(values: DataFrame) -> tuple[list[tuple[str, str]], dict[str, float], float]:
    """Learned transformations and the pair model of all values."""
    table = counts(values)
    model, floor = pair_model(table)
    return learn(table, model, floor), model, floor


def garbled_records(parts: DataFrame, archives: DataFrame) -> DataFrame:
    """(archive_id, part_no) of the records that hold garbled characters; part_no -1 for archive headers."""
    values = _values(parts, archives)
    state = values.sparkSession.sparkContext.broadcast(fit(values))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(*state.value)
        for batch in batches:
            keep = pa.array([restorer.check(d) for d in batch.column(2).to_pylist()], pa.bool_())
            yield batch.select([0, 1]).filter(keep)

    rows = outside_ascii(values).select("archive_id", "part_no", "data")
    return rows.mapInArrow(run, "archive_id string, part_no int").distinct()


def restored_records(parts: DataFrame, archives: DataFrame) -> DataFrame:
    """(archive_id, part_no, header, restored, whole): the garbled values put right; whole is false where characters were lost."""
    values = _values(parts, archives)
    state = values.sparkSession.sparkContext.broadcast(fit(values))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(*state.value)
        for batch in batches:
            data = batch.column(3).to_pylist()
            keep = [restorer.check(d) for d in data]
            texts = [restorer.restore(d) for d, k in zip(data, keep) if k]
            yield pa.RecordBatch.from_arrays(
                [*batch.select([0, 1, 2]).filter(pa.array(keep, pa.bool_())).columns, pa.array(texts, pa.string()), pa.array([not _LOST.search(t) for t in texts], pa.bool_())],
                names=["archive_id", "part_no", "header", "restored", "whole"],
            )

    rows = outside_ascii(values)
    return rows.mapInArrow(run, "archive_id string, part_no int, header string, restored string, whole boolean").distinct()
