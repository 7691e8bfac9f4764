"""Problem 3: template residue, filler, error pages and notices that scripts are required.

Method: every statement (a block of markup, a paragraph of plain text) goes down a prefix tree of fixed depth: its first
three tokens, then its length and last token; numbers, paths and coined names are masked. Leaves are templates. Each
partition counts its leaves, the counts are merged, and each template is classified once by what the tree shows of it: a
message stands in place of content. It is all the text of a value again and again, on several hosts, and so is what
begins like it; ordinary prose, menus and footers nearly always have other text beside them, however often they come. No
wording is given. The verdicts go back to every record that holds the template.

Slots left unfilled in ordinary prose, and filler without a fixed wording, are found apart from that, in each record.
Code (pre, code, fenced or indented) and scripts are never prose. Statements of every length count, no value is cut.

Defined results: null and empty data is no case; repeated rows count once; a very long value is read whole; extra columns
are ignored; an empty table gives an empty result; a message that comes only once can't be told from a short text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.blocks import Block, plain
from foliant.llm.lexicon import FILLER_WORDS, SLOT_RE
from foliant.llm.truncation import value_kind
from foliant.runtime import materialize

#: A statement stands alone if its value has fewer characters of other text than this.
OTHER_CHARS = 60
#: A message stands alone at least so often, on two hosts, in this share of its values; beginnings like its own as well.
MIN_ALONE, MIN_SHARE = 2, 0.2
#: ... on one host only, in two archives of it and in this share.
ONE_HOST_SHARE = 0.6
#: Templates kept by one partition before they are sent on; the rest follows in further partial rows.
PARTIAL_TEMPLATES = 50_000

_CODE = re.compile(r"<(pre|code|script|style|kbd|samp|textarea|template)\b[^>]*>.*?(?:</\1\s*>|\Z)|<!--.*?(?:-->|\Z)", re.S | re.I)
_CODE_SIGNS = ("<pre", "<code", "<script", "<style", "<!--", "<kbd", "<samp", "<textarea", "<template", "<PRE", "<CODE", "<SCRIPT", "<STYLE")
_FENCED = re.compile(r"^(```|~~~).*?(?:^\1[^\n]*$|\Z)|^(?: {4}|\t)[^\n]*$|`[^`\n]+`", re.S | re.M)
_MASKED = re.compile(r"\d|[/\\_@]|\w\.\w")
_THROWN = re.compile(r"(?:Exception|Error)\b:?$")
_ALNUM = re.compile(r"[^\W_]")
_PARAGRAPHS = re.compile(r"\n[ \t\r]*\n")
_WORD = re.compile(r"[^\W\d_]+")
_MARKUP = re.compile(r"(?! {4}|\t)\s*<(?:!doctype|\?xml|html|head|body|title|p|div|h[1-6]|ul|ol|table|center|main|article|section|header|footer|nav|noscript)\b", re.I)
_TITLE = re.compile(r"<title[^>]*>(.*?)</title", re.S | re.I)
_NOSCRIPT = re.compile(r"<noscript\b[^>]*>(.*?)(?:</noscript\s*>|\Z)", re.S | re.I)
_BLOCK = re.compile(r"<(h[1-6]|p|li|blockquote|figcaption)>([^<]*(?:<(?!/\1\s*>)[^<]*)*)(?:</\1\s*>|\Z)")
#: Text that stands in a container itself, outside the usual elements.
_STRAY = re.compile(r"<(?:body|div|td|section|main|article|center|span|dd|dt)\b[^<>]*>\s*([^<\s][^<]*)", re.I)
_ATTRIBUTES = re.compile(r"""\s[\w:-]+\s*=\s*("[^"]*"|'[^']*')""")
_SLOT_SIGNS = ("{", "%", "[", "@@", "__", "*|", "&lt;", "<INSERT", "<YOUR")


def masked(token: str) -> str:
    """The token in lower case, or the mask for what changes from one use of a template to the next."""
    return "<*>" if _MASKED.search(token) and not _THROWN.search(token) else token.lower()


def _hash(*pieces: str) -> int:
    return xxhash.xxh64_intdigest("\x1f".join(pieces)) - (1 << 63)


def _unspaced(statement: str) -> bool:
    return " " not in statement and not statement.isascii()


def size_of(statement: str) -> int:
    """Its characters; those of scripts that set no spaces say about three times as much."""
    return 3 * len(statement) if _unspaced(statement) else len(statement)


def tokens_of(statement: str) -> list[str]:
    """The words of a statement with folded spaces; pairs of characters where a script sets no spaces."""
    return [statement[i : i + 2] for i in range(0, len(statement), 2)] if _unspaced(statement) else statement.split(" ")


def tree_path(statement: str) -> tuple[int, int]:
    """The inner node (of the first two tokens) and the leaf a statement falls in, as 64-bit keys; spaces are folded."""
    tokens = tokens_of(statement)
    first = [masked(t) for t in tokens[:3]]
    length = len(tokens)
    last = tokens[-1]
    # a name at the end is a slot of the message, at the beginning it is its wording
    last = "<*>" if length > 1 and last[:1].isupper() else masked(last)
    return _hash(*first[:2]), _hash(str(length), *first, last)


def merge(a: list[str], b: list[str]) -> list[str]:
    """The consensus of two templates of one leaf."""
    return [x if x == y else "<*>" for x, y in zip(a, b)]


def is_filler(text: str) -> bool:
    """Filler without fixed wording: pseudo-Latin, or one or two words over and over."""
    rough = text.lower().split()
    if len(rough) < 5 or (len(FILLER_WORDS.intersection(rough)) < 3 and len(set(rough)) > 4):
        return False
    words = [w.lower() for w in _WORD.findall(text)]
    if len(words) < 5:
        return False
    if len(set(words)) <= 2 and len(words) >= 6:
        return True
    # words that other languages have too are no sign by themselves
    return sum(w in FILLER_WORDS for w in words) >= 0.8 * len(words) and sum(w in FILLER_WORDS and len(w) > 4 for w in words) >= 0.3 * len(words)


def holds_slot(prose: str) -> bool:
    """True if the prose has a slot left unfilled; attributes of tags don't count."""
    if not any(sign in prose for sign in _SLOT_SIGNS) or not SLOT_RE.search(prose):
        return False
    return "=" not in prose or bool(SLOT_RE.search(_ATTRIBUTES.sub("", prose)))


def read_value(data: str) -> tuple[bool, bool, dict[str, int], list[str], int]:
    """(slot, filler, statements with their number of characters over all copies, notices, chars of text) of one value.

    Headings are read for slots and filler; what names a site or a page is no message by standing alone.
    """
    statements: dict[str, int] = {}
    if not _MARKUP.match(data):
        prose = _FENCED.sub(" ", data) if "`" in data or "~~~" in data or "    " in data or "\t" in data else data
        for paragraph in _PARAGRAPHS.split(data):
            if text := " ".join(paragraph.split()):
                statements[text] = statements.get(text, 0) + size_of(text)
        return holds_slot(prose), is_filler(prose), statements, [], sum(statements.values())
    start = data.find("<body")
    body = data[start:] if start > 0 else data
    if any(sign in body for sign in _CODE_SIGNS):
        body = _CODE.sub(" ", body)
    slot = holds_slot(body)
    if not slot and start > 0 and (title := _TITLE.search(data, 0, start)):
        slot = holds_slot(title[1])
    notices: list[str] = []
    if "<noscript" in body:
        notices = [plain(x) for x in _NOSCRIPT.findall(body)]
        body = _NOSCRIPT.sub(" ", body)
    chars, filler = 0, False
    for tag, inner in _BLOCK.findall(body):
        if tag == "li" and "<a" in inner:
            continue
        text = plain(inner)
        if text:
            filler = filler or is_filler(text)
            if tag[0] != "h":
                size = size_of(text)
                chars += size
                statements[text] = statements.get(text, 0) + size
    for inner in _STRAY.findall(body):
        text = plain(inner)
        if text:
            size = size_of(text)
            chars += size
            filler = filler or is_filler(text)
            statements[text] = statements.get(text, 0) + size
    return slot, filler, statements, notices, chars


def read_page(data: str, blocks: list[Block]) -> tuple[bool, bool, dict[str, int], list[str], int]:
    """The same of a page whose blocks have been read already."""
    statements: dict[str, int] = {}
    slot = filler = False
    chars = 0
    start = data.find("<body")
    if start > 0 and (title := _TITLE.search(data, 0, start)):
        slot = holds_slot(title[1])
    notices = [plain(x) for x in _NOSCRIPT.findall(data)] if "<noscript" in data else []
    for b in blocks:
        if b.tag == "pre" or not b.text or b.text in notices:
            continue
        if "<" in b.raw and any(sign in b.raw for sign in _CODE_SIGNS):
            raw = _CODE.sub(" ", b.raw)
            text = plain(raw)
        else:
            raw, text = b.raw, b.text
        slot = slot or holds_slot(raw)
        if not text or b.tag[0] == "h" or (b.tag == "li" and "<a" in raw):
            continue
        size = size_of(text)
        chars += size
        filler = filler or is_filler(text)
        statements[text] = statements.get(text, 0) + size
    return slot, filler, statements, notices, chars


class Tree:
    """A partition's part of the tree: per leaf the node, values, values it stands alone in, their hosts and archives, consensus."""

    def __init__(self):
        self.leaves: dict[int, list] = {}

    def read(self, statements: dict[str, int], notices: list[str], chars: int, host: str | None, archive: str | None) -> list[int]:
        """Counts one value's statements and gives their leaves. A notice counts only where there is no other content."""
        keys: dict[int, None] = {}
        places: tuple[int, int] | None = None
        shown = [(text, chars - size < OTHER_CHARS) for text, size in statements.items()]
        if chars < OTHER_CHARS:
            shown += [(text, True) for text in notices if text]
        for text, alone in shown:
            if not _ALNUM.search(text):
                continue
            node, leaf = tree_path(text)
            if leaf in keys:
                continue
            keys[leaf] = None
            known = self.leaves.get(leaf)
            if known is None:
                known = self.leaves[leaf] = [node, 0, 0, None, None, None, None, None]
            known[1] += 1
            if alone:
                places = places or (_hash(host or ""), _hash(archive or ""))
                known[2] += 1
                for k, place in ((3, places[0]), (5, places[1])):
                    known[k] = place if known[k] is None else min(known[k], place)
                    known[k + 1] = place if known[k + 1] is None else max(known[k + 1], place)
                tokens = [masked(t) for t in tokens_of(text)]
                known[7] = tokens if known[7] is None or known[7] == tokens else merge(known[7], tokens)
        return list(keys)

    def flush(self) -> dict[str, list]:
        columns = list(zip(*((k, *v) for k, v in self.leaves.items()))) or [()] * len(LEAF)
        self.leaves.clear()
        return dict(zip(LEAF, map(list, columns)))


#: The columns of a partial row of the tree, and of a record.
LEAF = {"leaf": pa.int64(), "node": pa.int64(), "n": pa.int64(), "alone": pa.int64(), "host_min": pa.int64(), "host_max": pa.int64(), "archive_min": pa.int64(), "archive_max": pa.int64(), "template": pa.list_(pa.string())}
RECORD = {"archive_id": pa.string(), "part_no": pa.int32(), "found": pa.bool_(), "keys": pa.list_(pa.int64())}
_LEAF_DDL = "leaf bigint, node bigint, n bigint, alone bigint, host_min bigint, host_max bigint, archive_min bigint, archive_max bigint, template array<string>"


def batch_of(schema: dict[str, pa.DataType], values: dict[str, list]) -> pa.RecordBatch:
    """A batch of the given columns; those without values are null."""
    size = max((len(v) for v in values.values()), default=0)
    return pa.RecordBatch.from_arrays([pa.array(values[k], t) if k in values else pa.nulls(size, t) for k, t in schema.items()], names=list(schema))


def _mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tree = Tree()
    schema = RECORD | LEAF
    for batch in batches:
        rows: list[tuple] = []
        for archive, part, host, data in zip(*(batch.column(i).to_pylist() for i in range(4))):
            slot, filler, *read = read_value(data)
            keys = tree.read(*read, host, archive)
            if slot or filler or keys:
                rows.append((archive, part, slot or filler, keys))
        yield batch_of(schema, dict(zip(RECORD, map(list, zip(*rows)))))
        if len(tree.leaves) > PARTIAL_TEMPLATES:
            yield batch_of(schema, tree.flush())
    yield batch_of(schema, tree.flush())


def mined(values: DataFrame) -> DataFrame:
    """Rows of records (leaf null) and of partial leaves of (archive_id, part_no, host, content_type, data), kept as a table."""
    kind = value_kind(F.col("data"), F.col("content_type"))
    rows = values.filter(F.col("data").isNotNull() & kind.isin("markup", "text")).select("archive_id", F.col("part_no").cast("int").alias("part_no"), "host", "data")
    return materialize(rows.mapInArrow(_mine, f"archive_id string, part_no int, found boolean, keys array<bigint>, {_LEAF_DDL}"), "residue")


def messages(leaves: DataFrame) -> DataFrame:
    """(leaf, n, alone) of the templates that are messages, told from the partial leaves of all values."""
    # two hosts or archives show in the least and the greatest of their keys
    per_leaf = leaves.groupBy("leaf").agg(
        F.first("node").alias("node"), F.sum("n").alias("n"), F.sum("alone").alias("alone"), (F.min("host_min") != F.max("host_max")).alias("hosts"), (F.min("archive_min") != F.max("archive_max")).alias("archives")
    )
    needed = F.when(F.col("hosts"), MIN_SHARE).when(F.col("archives"), ONE_HOST_SHARE)
    likely = per_leaf.withColumn("needed", needed).filter((F.col("alone") >= MIN_ALONE) & (F.col("alone") >= F.col("needed") * F.col("n")))
    per_node = leaves.groupBy("node").agg((F.sum("alone") / F.sum("n")).alias("node_share")).filter(F.col("node_share") >= MIN_SHARE)
    return likely.join(per_node, "node").filter(F.col("node_share") >= F.col("needed")).select("leaf", "n", "alone")


def message_templates(table: DataFrame) -> DataFrame:
    """(leaf, n, alone, template) of the messages, with the wording that all their uses share."""
    leaves = table.filter(F.col("leaf").isNotNull())
    found = messages(leaves)
    tokens = leaves.filter("template IS NOT NULL").join(found.select("leaf"), "leaf").select("leaf", F.posexplode("template").alias("place", "token")).groupBy("leaf", "place").agg(F.min("token").alias("least"), F.max("token").alias("most"))
    agreed = F.struct("place", F.when(F.col("least") == F.col("most"), F.col("least")).otherwise(F.lit("<*>")).alias("token"))
    wording = tokens.groupBy("leaf").agg(F.array_join(F.transform(F.array_sort(F.collect_list(agreed)), lambda x: x["token"]), " ").alias("template"))
    return found.join(wording, "leaf")


def holders(records: DataFrame, leaves: DataFrame, *ids: str) -> DataFrame:
    """The ``ids`` of the records (found, keys) that are cases themselves or hold a message."""
    told = records.select(*ids, F.explode("keys").alias("leaf")).join(messages(leaves).select("leaf"), "leaf").select(*ids)
    return records.filter("found").select(*ids).unionByName(told).distinct()


def verdicts(values: DataFrame) -> DataFrame:
    """(archive_id, part_no) of the cases among (archive_id, part_no, host, content_type, data)."""
    table = mined(values)
    return holders(table.filter(F.col("leaf").isNull()), table.filter(F.col("leaf").isNotNull()), "archive_id", "part_no")


def part_values(parts: DataFrame) -> DataFrame:
    """The parts as values."""
    return parts.select("archive_id", F.col("part_no").cast("int").alias("part_no"), "host", "content_type", "data")


def page_values(pages: DataFrame) -> DataFrame:
    """page_data as values of part_no -1."""
    return pages.select("archive_id", F.lit(-1).alias("part_no"), "host", F.lit("text/html").alias("content_type"), "data")


def residue_records(parts: DataFrame, pages: DataFrame) -> DataFrame:
    """(archive_id, part_no) of the parts that are cases; part_no -1 for page_data."""
    return verdicts(part_values(parts).unionByName(page_values(pages)))
