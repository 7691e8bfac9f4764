"""Problem 8: missing or wrong language labels, and texts that change language.

Method: hierarchical discrimination. A linear support vector machine per family (one against the rest) gives a sentence's
family, then one-against-one machines separate the languages within it. Features are hashed character n-grams of words
and whole words. The machines are fitted on sentences of at most ``DOCS_PER_LANGUAGE`` labelled documents per language
(a documented bound), wrong labels are cleaned out by a first fit. Everything else reads every document whole.

Code (fenced, indented, pre), links and markup are no text. Neighbouring sentences of one language form a segment;
sentences too short to tell join their neighbours.

Defined results: null, empty or code-only texts have no language and are no cases; a null or unknown label names no
language; repeated rows count once; extra columns are ignored; without labelled rows nothing can be told and nothing is
reported.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bounds of the sample the machines are fitted on.
DOCS_PER_LANGUAGE, SENTENCES_PER_DOC = 500, 8
#: A language needs this many labelled sentences to be learned.
MIN_SENTENCES = 12
DIMENSIONS = 1 << 16
#: Words a task keeps the sums of; beyond that it starts anew.
VOCABULARY_ROWS = 300_000
#: A sentence of fewer words doesn't change a text's language by itself.
MIN_WORDS = 3
#: ... nor does one whose margin over the surrounding language is smaller than this.
MIN_MARGIN = 0.25

#: Two-letter codes with their family and other spellings (three-letter codes, English and own names).
LANGUAGES = {
    "en": ("germanic", "eng english"), "de": ("germanic", "deu ger german deutsch"), "nl": ("germanic", "nld dut dutch nederlands flemish vlaams"), "sv": ("germanic", "swe swedish svenska"), "da": ("germanic", "dan danish dansk"),
    "no": ("germanic", "nor norwegian norsk nb nob bokmål nn nno"), "is": ("germanic", "isl ice icelandic íslenska"), "af": ("germanic", "afr afrikaans"),
    "es": ("romance", "spa spanish español castellano castilian"), "pt": ("romance", "por portuguese português"), "fr": ("romance", "fra fre french français"), "it": ("romance", "ita italian italiano"), "ro": ("romance", "ron rum romanian română"),
    "ca": ("romance", "cat catalan català"), "gl": ("romance", "glg galician galego"), "la": ("romance", "lat latin"),
    "ru": ("slavic", "rus russian русский"), "pl": ("slavic", "pol polish polski"), "uk": ("slavic", "ukr ukrainian українська"), "cs": ("slavic", "ces cze czech čeština"), "sk": ("slavic", "slk slo slovak slovenčina"), "bg": ("slavic", "bul bulgarian български"),
    "hr": ("slavic", "hrv croatian hrvatski"), "sr": ("slavic", "srp serbian српски"), "sl": ("slavic", "slv slovenian slovenščina"), "be": ("slavic", "bel belarusian беларуская"),
    "ja": ("japonic", "jpn japanese 日本語"), "zh": ("sinitic", "zho chi cmn chinese mandarin 中文"), "ko": ("koreanic", "kor korean 한국어"), "tr": ("turkic", "tur turkish türkçe"), "fi": ("uralic", "fin finnish suomi"), "hu": ("uralic", "hun hungarian magyar"),
    "et": ("uralic", "est estonian eesti"), "el": ("hellenic", "ell gre greek ελληνικά"), "ar": ("semitic", "ara arabic العربية"), "he": ("semitic", "heb hebrew עברית iw"), "hi": ("indic", "hin hindi हिन्दी"), "vi": ("austric", "vie vietnamese"), "id": ("malayic", "ind indonesian"),
}
_NAMES = {name: code for code, (_, names) in LANGUAGES.items() for name in (code, *names.split())}

_CODE = re.compile(r"^(```|~~~).*?(?:^\1[^\n]*$|\Z)|<(pre|code|script|style)\b[^>]*>.*?(?:</\2\s*>|\Z)|^(?: {4}|\t)[^\n]*$|`[^`\n]+`", re.S | re.M | re.I)
#: What is no text, with the sign without which it isn't looked for: addresses of pages, of mail, tags, references with numbers.
_LINKS = (
    ("/", re.compile(r"(?:https?|ftp)://\S+")), ("www.", re.compile(r"www\.\S+")), ("@", re.compile(r"[^\s@]+@\S+\.\w+")), ("<", re.compile(r"<[^<>\n]{1,200}>")), ("(", re.compile(r"\((?=[^()]*\d)[^()]{1,60}\)")),
)
_MARKS = re.compile(r"^\s*(?:[>*+-]|\d+[.)])+\s+", re.M)
_SENTENCE = re.compile(r"[^.!?…。！？\n]+(?:[.!?…](?![\s\"”»’')\]]|$)[^.!?…。！？\n]*)*[.!?…。！？]*[\"”»’')\]]*", re.M)
_WORDS = re.compile(r"[぀-ヿ㐀-鿿가-힯]|[^\W\d_]+(?:['’][^\W\d_]+)*")
_NOT_BREAK = re.compile(r"[^\n]")
_CJK = re.compile(r"[぀-ヿ㐀-鿿]")


def normal_label(label: str | None) -> str | None:
    """The two-letter code a label names, or None."""
    if not label:
        return None
    word = label.strip().lower()
    return _NAMES.get(word) or _NAMES.get(re.split(r"[-_ (,;]", word)[0])


def normal_label_column(label: Column) -> Column:
    """The same as ``normal_label``, as an expression."""
    names = F.create_map(*[F.lit(x) for pair in _NAMES.items() for x in pair])
    word = F.lower(F.trim(label))
    return F.coalesce(names[word], names[F.split(word, r"[-_ (,;]").getItem(0)])


def sentences(text: str) -> list[tuple[int, int, list[str]]]:
    """(start, end, words) of each sentence of the prose; code, links and markup are blanked, so that offsets hold."""

    def blank(m: re.Match) -> str:
        return " " * len(m[0]) if "\n" not in m[0] else _NOT_BREAK.sub(" ", m[0])

    prose = text
    if "`" in prose or "<" in prose or "    " in prose or "\t" in prose or "~~~" in prose:
        prose = _CODE.sub(blank, prose)
    for sign, pattern in _LINKS:
        if sign in prose:
            prose = pattern.sub(blank, prose)
    prose = _MARKS.sub(blank, prose)
    found = []
    for m in _SENTENCE.finditer(prose):
        words = _WORDS.findall(m[0])
        if words:
            found.append((m.start(), m.end(), words))
    return found


def word_features(word: str) -> list[int]:
    """Hashed n-grams of a word with its edges, and the word itself."""
    w = word.lower()
    if _CJK.match(w):
        return [xxhash.xxh32_intdigest(w) % DIMENSIONS, xxhash.xxh32_intdigest("\x02cjk") % DIMENSIONS]
    edged = f" {w} "
    grams = {edged[i : i + n] for n in (1, 2, 3, 4) for i in range(len(edged) - n + 1)}
    grams.add("=" + w)
    return [xxhash.xxh32_intdigest(g) % DIMENSIONS for g in grams]


class Discriminator:
    """The fitted machines. ``weights`` has a row per machine: families first, then pairs of languages of one family."""

    def __init__(self, families: list[str], members: dict[str, list[str]], pairs: list[tuple[str, str]], weights: np.ndarray, bias: np.ndarray, scale: float = 4.0):
        self.families, self.members, self.pairs, self.weights, self.bias, self.scale = families, members, pairs, weights, bias, scale
        self.languages = [x for f in families for x in members[f]]
        self.by_gram = np.ascontiguousarray(weights.T)
        self.kin = np.array([k for k, f in enumerate(families) for _ in members[f]])
        # the vocabulary met so far: a word's row of sums over its n-grams, and their number
        self.rows: dict[str, int] = {}
        self.sums = np.zeros((0, len(bias)), dtype=np.float32)
        self.sizes = np.zeros(0)
        # per language the machines that speak on it and their signs; unused places repeat the family's
        place = {p: len(families) + i for i, p in enumerate(pairs)}
        votes = []
        for k, family in enumerate(families):
            for x in members[family]:
                votes.append([(k, 1.0)] + [(place[x, y], 1.0) if (x, y) in place else (place[y, x], -1.0) for y in members[family] if y != x])
        width = max((len(v) for v in votes), default=0)
        self.votes = np.array([[v[min(j, len(v) - 1)][0] for j in range(width)] for v in votes], dtype=np.int64)
        self.signs = np.array([[v[min(j, len(v) - 1)][1] for j in range(width)] for v in votes])

    def learn_words(self, words: list[str]) -> None:
        """Adds words that aren't in the vocabulary yet."""
        if len(self.rows) > VOCABULARY_ROWS:
            self.rows.clear()
            self.sums, self.sizes = self.sums[:0], self.sizes[:0]
        features = [word_features(w) for w in words]
        sizes = np.array([len(f) for f in features])
        sums = np.add.reduceat(self.by_gram[np.array([g for f in features for g in f])], np.concatenate(([0], np.cumsum(sizes)[:-1])), axis=0)
        self.rows.update(zip(words, range(len(self.rows), len(self.rows) + len(words))))
        self.sums, self.sizes = np.concatenate((self.sums, sums.astype(np.float32))), np.concatenate((self.sizes, sizes))

    def read(self, sentences: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """(best language, margins) of each sentence: its family is decided first, the language within it by duels.

        A language's margin is the least of its family's and of its duels.
        """
        if not sentences:
            return np.zeros(0, dtype=np.int64), np.zeros((0, len(self.languages)))
        # the vocabulary may start anew, so that the words of this batch are all in it
        new = {w for s in sentences for w in s}.difference(self.rows)
        if new:
            if len(self.rows) > VOCABULARY_ROWS:
                new = {w for s in sentences for w in s}
            self.learn_words(sorted(new))
        ids = np.array([self.rows[w] for s in sentences for w in s])
        starts = np.concatenate(([0], np.cumsum([len(s) for s in sentences])[:-1]))
        total = np.add.reduceat(self.sums[ids], starts, axis=0) / np.sqrt(np.add.reduceat(self.sizes[ids], starts))[:, None] + self.bias
        margins = (total[:, self.votes] * self.signs).min(axis=2)
        family = total[:, : len(self.families)].argmax(axis=1)
        return np.where(self.kin[None, :] == family[:, None], margins, -np.inf).argmax(axis=1), margins

    def margins(self, words: list[str]) -> np.ndarray:
        """A margin for each language."""
        return self.read([words])[1][0]

    def confidences(self, margins: np.ndarray) -> np.ndarray:
        """The share of each language in the odds that the margins of a sentence give."""
        odds = np.exp(self.scale * (margins - margins.max(axis=1, keepdims=True, initial=-np.inf)))
        return odds / odds.sum(axis=1, keepdims=True)


def _fit_machine(rows: np.ndarray, words: np.ndarray, size: np.ndarray, grams: tuple[np.ndarray, np.ndarray], y: np.ndarray, steps: int = 120, rate: float = 0.05, decay: float = 5e-3) -> tuple[np.ndarray, float]:
    """One linear support vector machine (squared hinge loss, Adam on whole batches).

    A sentence is the sum of its words' n-grams over the root of their number, so a step goes through words, not n-grams.
    """
    n, vocabulary = len(y), int(grams[0].max()) + 1
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    used, cols = np.unique(grams[1], return_inverse=True)
    w, m, v = np.zeros(len(used)), np.zeros(len(used)), np.zeros(len(used))
    b = 0.0
    for t in range(1, steps + 1):
        of_word = np.bincount(grams[0], weights=w[cols], minlength=vocabulary)
        score = np.bincount(rows, weights=of_word[words], minlength=n) / size + b
        pull = 2.0 * weight * y * np.maximum(0.0, 1.0 - y * score)
        back = np.bincount(words, weights=(pull / size)[rows], minlength=vocabulary)
        g = decay * w / n**0.5 - np.bincount(cols, weights=back[grams[0]], minlength=len(used))
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        b += 0.02 * pull.sum()
    full = np.zeros(DIMENSIONS)
    full[used] = w
    return full, b


def _words(samples: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """(sentence of each word, number of each word, root of each sentence's n-grams, (word, n-gram) of the vocabulary)."""
    number: dict[str, int] = {}
    rows, words = [], []
    for i, sentence in enumerate(samples):
        for w in sentence:
            words.append(number.setdefault(w, len(number)))
            rows.append(i)
    features = [word_features(w) for w in number]
    counts = np.array([len(f) for f in features])
    grams = (np.repeat(np.arange(len(features)), counts), np.array([g for f in features for g in f]))
    rows, words = np.array(rows), np.array(words)
    return rows, words, np.sqrt(np.bincount(rows, weights=counts[words], minlength=len(samples))), grams


def clean_votes(samples: list[tuple[str, list[str]]]) -> tuple[list[tuple[str, list[str]]], set[tuple[str, ...]]]:
    """The sentences with one label each, and those whose label needs no judgement.

    A sentence that comes several times counts four times at most, with the label it has most often (none if two are as
    frequent); with three votes and a clear majority it is sure.
    """
    tally: dict[tuple[str, ...], dict[str, int]] = {}
    for lang, words in samples:
        votes = tally.setdefault(tuple(words), {})
        votes[lang] = votes.get(lang, 0) + 1
    out, sure = [], set()
    for words, votes in sorted(tally.items()):
        first, *rest = sorted(votes.items(), key=lambda x: -x[1])
        if not rest or rest[0][1] < first[1]:
            out += [(first[0], list(words))] * min(4, first[1])
            if first[1] >= 3 and first[1] >= 2 * sum(n for _, n in rest):
                sure.add(words)
    return out, sure


def fit(samples: list[tuple[str, list[str]]], spark: SparkSession | None = None) -> Discriminator | None:
    """Fits the machines on (language, words); sentences that machines fitted on the others disown are left out.

    With ``spark`` the machines are fitted in parallel tasks on the broadcast sample, whose size is bounded.
    """
    samples, sure = clean_votes(samples)
    # each half is judged by the machines of the other, which can't have learned its wrong labels by heart
    halves = [samples[::2], samples[1::2]]
    kept: list[tuple[str, list[str]]] = []
    for own, judge in zip(halves[::-1], _fit_all(halves, spark)):
        if judge is not None:
            best, _ = judge.read([words for _, words in own])
            kept += [(lang, words) for (lang, words), k in zip(own, best) if tuple(words) in sure or lang not in judge.languages or judge.languages[k] == lang]
    fitted = _fit_all([sorted(kept)], spark)[0] or _fit_all([samples], spark)[0]
    if fitted is None:
        return None
    named = [(lang, words) for lang, words in (kept or samples) if lang in fitted.languages]
    # the confidence's scale: the largest under which it is, on the mean, not surer than right
    held = named[::7]
    best, margins = fitted.read([words for _, words in held])
    right = sum(fitted.languages[k] == lang for k, (lang, _) in zip(best, held)) / max(1, len(held))
    fitted.scale = 1.0
    for scale in (2.0, 3.0, 4.0, 6.0, 8.0, 12.0):
        before, fitted.scale = fitted.scale, scale
        if fitted.confidences(margins)[np.arange(len(held)), best].sum() / max(1, len(held)) > right:
            fitted.scale = before
            break
    return fitted


class _Sample:
    """One sample's sentences as arrays, its languages, and the machines it needs."""

    def __init__(self, samples: list[tuple[str, list[str]]]):
        count: dict[str, int] = {}
        for lang, _ in samples:
            count[lang] = count.get(lang, 0) + 1
        known = sorted(x for x, n in count.items() if n >= MIN_SENTENCES)
        samples = [s for s in samples if s[0] in known]
        self.members: dict[str, list[str]] = {}
        for lang in known:
            self.members.setdefault(LANGUAGES[lang][0], []).append(lang)
        self.families = sorted(self.members)
        self.pairs = [p for f in self.families for p in combinations(self.members[f], 2)]
        self.arrays = _words([w for _, w in samples]) if known else None
        self.langs = np.array([lang for lang, _ in samples])
        self.kin = np.array([LANGUAGES[x][0] for x in self.langs])

    def __len__(self) -> int:
        return len(self.families) + len(self.pairs)

    def machine(self, k: int) -> tuple[np.ndarray, float]:
        """The k-th machine: families first, then pairs."""
        rows, words, size, grams = self.arrays
        if k < len(self.families):
            if len(self.families) == 1:
                return np.zeros(DIMENSIONS), 1.0
            return _fit_machine(rows, words, size, grams, np.where(self.kin == self.families[k], 1.0, -1.0))
        a, b = self.pairs[k - len(self.families)]
        keep = (self.langs == a) | (self.langs == b)
        number = np.cumsum(keep) - 1
        inside = keep[rows]
        return _fit_machine(number[rows[inside]], words[inside], size[keep], grams, np.where(self.langs[keep] == a, 1.0, -1.0))


def _fit_all(samples: list[list[tuple[str, list[str]]]], spark: SparkSession | None) -> list[Discriminator | None]:
    """The machines of each sample: here, or a task for each machine."""
    data = [_Sample(x) for x in samples]
    jobs = [(i, k) for i, d in enumerate(data) for k in range(len(d))]
    if spark is None or not jobs:
        found = {job: data[job[0]].machine(job[1]) for job in jobs}
    else:
        shared = spark.sparkContext.broadcast(data)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    weights, bias = shared.value[i].machine(k)
                    yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([k], pa.int32()), pa.array([weights.astype(np.float32).tobytes()], pa.binary()), pa.array([float(bias)], pa.float64())], names=["i", "k", "weights", "bias"])

        # a row per machine, a few dozen
        rows = spark.createDataFrame(jobs, "i int, k int").repartitionByRange(len(jobs), "i", "k").mapInArrow(run, "i int, k int, weights binary, bias double").collect()
        found = {(r["i"], r["k"]): (np.frombuffer(r["weights"], dtype=np.float32).astype(float), r["bias"]) for r in rows}
        shared.destroy()
    out: list[Discriminator | None] = []
    for i, d in enumerate(data):
        machines = [found[i, k] for k in range(len(d))]
        out.append(Discriminator(d.families, d.members, d.pairs, np.array([m[0] for m in machines]), np.array([m[1] for m in machines])) if machines else None)
    return out


def labelled_sentences(documents: DataFrame) -> list[tuple[str, list[str]]]:
    """The bounded sample: sentences of labelled documents picked by a hash of their id, alike at every size."""
    known = documents.withColumn("label", normal_label_column(F.col("lang"))).filter("label IS NOT NULL AND text IS NOT NULL")
    sizes = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}  # a row per language
    if not sizes:
        return []
    share = F.create_map(*[F.lit(x) for label, n in sizes.items() for x in (label, min(1.0, DOCS_PER_LANGUAGE / n))])
    picked = known.filter(F.pmod(F.xxhash64(F.lit("langid"), "doc_id"), F.lit(1_000_000)) < share[F.col("label")] * 1_000_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, texts = [], []
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = [w for _, _, w in sentences(text) if len(w) >= 2]
                step = max(1, len(found) // SENTENCES_PER_DOC)
                for words in found[::step][:SENTENCES_PER_DOC]:
                    labels.append(label)
                    texts.append(words[:200])
            yield pa.RecordBatch.from_arrays([pa.array(labels, pa.string()), pa.array(texts, pa.list_(pa.string()))], names=["label", "words"])

    rows = picked.select("label", "text").mapInArrow(run, "label string, words array<string>").collect()
    return sorted((r["label"], list(r["words"])) for r in rows)


def segments(text: str, machines: Discriminator) -> list[tuple[int, int, str, float, int]]:
    """(start, end, language, confidence, whole sentences) of the stretches of one language, in order."""
    return next(segments_of([text], machines))


def segments_of(texts: list[str], machines: Discriminator) -> Iterator[list[tuple[int, int, str, float, int]]]:
    """The segments of each text; all their sentences are judged at once."""
    found = [sentences(t) for t in texts]
    best, margins = machines.read([words for f in found for _, _, words in f])
    judged = zip(best.tolist(), margins.tolist(), machines.confidences(margins).tolist())
    for f in found:
        yield _segments([(start, end, k, m, c, len(words) / 3 if _CJK.match(words[0]) else len(words)) for (start, end, words), (k, m, c) in zip(f, judged)], machines.languages)


def _segments(judged: list[tuple[int, int, int, list[float], list[float], float]], languages: list[str]) -> list[tuple[int, int, str, float, int]]:
    """The segments of one text from its sentences: (start, end, best language, margins, confidences, size)."""
    if not judged:
        return []
    read = [[start, end, best, margins, size, sure] for start, end, best, margins, sure, size in judged]
    # weight of each language over the text, to lean on where a sentence is too short to tell
    weight: dict[int, float] = {}
    for _, _, best, margins, size, _ in read:
        weight[best] = weight.get(best, 0.0) + size * max(0.05, margins[best])
    main = max(weight, key=lambda x: weight[x])
    # a text without any whole sentence is one of its main language
    short = all(item[4] < MIN_WORDS for item in read)
    for i, item in enumerate(read):
        best, margins, size = item[2:5]
        if best != main and (size < MIN_WORDS or margins[best] - margins[main] < MIN_MARGIN):
            near = {read[j][2] for j in (i - 1, i + 1) if 0 <= j < len(read) and read[j][4] >= MIN_WORDS}
            if size < MIN_WORDS or near != {best}:
                item[2] = next(iter(near)) if len(near) == 1 else main
    out: list[tuple[int, int, str, float, int]] = []
    for start, end, best, margins, size, confidences in read:
        sure = confidences[best]
        whole = int(size >= MIN_WORDS or short)
        name = languages[best]
        if out and out[-1][2] == name:
            s, _, _, c, n = out[-1]
            out[-1] = (s, end, name, (c * max(1, n) + sure) / (max(1, n) + 1), n + whole)
        else:
            out.append((start, end, name, sure, whole))
    return out


_SEGMENTS = "doc_id bigint, label string, segment_no int, start int, end int, lang string, confidence double, whole_sentences int"


def language_segments(documents: DataFrame) -> DataFrame:
    """A row per stretch of one language: its place, language, confidence and number of whole sentences."""
    spark = documents.sparkSession
    machines = fit(labelled_sentences(documents), spark)
    if machines is None:
        return spark.createDataFrame([], _SEGMENTS)
    state = spark.sparkContext.broadcast((machines.families, machines.members, machines.pairs, machines.weights.astype(np.float32), machines.bias.astype(np.float32), machines.scale))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Discriminator(*state.value)
        for batch in batches:
            out: list[tuple] = []
            docs, labels, texts = (batch.column(i).to_pylist() for i in range(3))
            for start in range(0, len(docs), 512):
                part = slice(start, start + 512)
                for doc, lang, found in zip(docs[part], labels[part], segments_of(texts[part], own)):
                    label = normal_label(lang)
                    out += [(doc, label, k, *x) for k, x in enumerate(found)]
            cols = list(zip(*out)) if out else [[]] * 8
            types = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["doc_id", "label", "segment_no", "start", "end", "lang", "confidence", "whole_sentences"])

    return documents.filter("text IS NOT NULL").select("doc_id", "lang", "text").mapInArrow(run, _SEGMENTS)


def document_languages(documents: DataFrame) -> DataFrame:
    """(doc_id, lang, confidence, languages): the language of most of the text, and all that have whole sentences."""
    length = F.col("end") - F.col("start")
    per = language_segments(documents).groupBy("doc_id", "lang").agg(F.sum(length).alias("chars"), (F.sum(F.col("confidence") * length) / F.sum(length)).alias("confidence"), F.sum("whole_sentences").alias("whole"))
    return per.groupBy("doc_id").agg(F.max_by("lang", F.struct("chars", "lang")).alias("lang"), F.max_by("confidence", F.struct("chars", "lang")).alias("confidence"), F.sort_array(F.collect_set(F.when(F.col("whole") > 0, F.col("lang")))).alias("languages"))


def mislabelled_documents(documents: DataFrame) -> DataFrame:
    """(doc_id, lang) of the documents whose label is absent or untrue, or whose text changes language: a row per language."""
    per = language_segments(documents).filter("whole_sentences > 0").groupBy("doc_id").agg(F.first("label").alias("label"), F.collect_set("lang").alias("langs"))
    cases = per.filter(F.col("label").isNull() | (F.size("langs") > 1) | ~F.array_contains("langs", F.col("label")))
    return cases.select("doc_id", F.explode("langs").alias("lang"))
