"""Problem 2: rows that fail to parse. Valid manifest records come out typed, the others with every reason.

Method: the quote-aware automaton of ``functions.delimited``. A record longer than a chunk is read chunk by chunk and the
chunk transitions are composed; whole raw files are split into records in the same way, chunk transitions first
(in parallel), then their composition, then the pieces (``split_records``).

Defined results: a null line is one empty column (``column_count``); repeated rows count once, as ``line_id`` tells them
apart; a file name of neither suffix is read with commas; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import datetime
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.functions.delimited import BROKEN, QUOTED, START, STATES, chunk_table, read_chunk, tokenize

COLUMNS = ("archive_id", "part_no", "content_type", "transfer_encoding", "n_bytes", "captured_at", "headers", "anomalies")
#: Transfer encodings and anomaly types a record can name.
ENCODINGS = frozenset(("", "base64", "quoted-printable", "7bit", "8bit", "binary"))
ANOMALIES = frozenset(("document-mislabeled-as-archive", "declared-boundary-unused", "multipart-without-delimiters", "index-synthesized", "base64-left-encoded"))

_ARCHIVE = re.compile(r"arc-[0-9]{10}\Z")
_DIGITS = re.compile(r"[0-9]+\Z")
_MOMENT = re.compile(r"(\d{4})-(\d{2})-(\d{2})[T ](\d{2}):(\d{2}):(\d{2})(?:\.(\d+))?(?:Z|([+-])(\d{2}):(\d{2}))\Z", re.ASCII)

RECORD_SCHEMA = (
    "line_id bigint, reasons array<string>, error_offset int, archive_id string, part_no decimal(38,0), content_type string, "
    "transfer_encoding string, n_bytes decimal(38,0), captured_at timestamp, headers map<string,string>, anomalies array<struct<type:string,id:string>>"
)
_ARROW = pa.schema(
    [
        ("line_id", pa.int64()),
        ("reasons", pa.list_(pa.string())),
        ("error_offset", pa.int32()),
        ("archive_id", pa.string()),
        ("part_no", pa.decimal128(38, 0)),
        ("content_type", pa.string()),
        ("transfer_encoding", pa.string()),
        ("n_bytes", pa.decimal128(38, 0)),
        ("captured_at", pa.timestamp("us", tz="UTC")),
        ("headers", pa.map_(pa.string(), pa.string())),
        ("anomalies", pa.list_(pa.struct([("type", pa.string()), ("id", pa.string())]))),
    ]
)


def _no_constant(name: str):
    raise ValueError(name)


def strict_json(text: str):
    """``text`` as JSON by the standard: no NaN or Infinity, no control characters in strings."""
    try:
        return json.loads(text, parse_constant=_no_constant)
    except (ValueError, RecursionError):
        return None


def parse_moment(text: str) -> datetime.datetime | None:
    """A real date and time with its zone, in UTC; None for anything else."""
    m = _MOMENT.match(text)
    if not m:
        return None
    year, month, day, hour, minute, second = (int(x) for x in m.groups()[:6])
    try:
        moment = datetime.datetime(year, month, day, hour, minute, second, int((m[7] or "0")[:6].ljust(6, "0")), datetime.timezone.utc)
        if m[8]:
            if int(m[9]) > 23 or int(m[10]) > 59:
                return None
            shift = datetime.timedelta(hours=int(m[9]), minutes=int(m[10]))
            moment = moment - shift if m[8] == "+" else moment + shift
    except (ValueError, OverflowError):
        return None
    return moment


def check_record(fields: list[str]) -> tuple[list[str], dict]:
    """The names of the invalid columns, and the typed values of the valid ones."""
    archive, part_no, content_type, encoding, n_bytes, moment, headers, anomalies = fields
    bad: list[str] = []
    row: dict = {"content_type": content_type}
    if _ARCHIVE.match(archive):
        row["archive_id"] = archive
    else:
        bad.append("archive_id")
    if _DIGITS.match(part_no):
        row["part_no"] = part_no
    else:
        bad.append("part_no")
    known = encoding.strip(" \t").lower()
    if known in ENCODINGS:
        row["transfer_encoding"] = known
    else:
        bad.append("transfer_encoding")
    if _DIGITS.match(n_bytes):
        row["n_bytes"] = n_bytes
    else:
        bad.append("n_bytes")
    when = parse_moment(moment)
    if when is not None:
        row["captured_at"] = when
    else:
        bad.append("captured_at")
    mapping = strict_json(headers)
    if isinstance(mapping, dict) and all(isinstance(v, str) for v in mapping.values()):
        row["headers"] = list(mapping.items())
    else:
        bad.append("headers")
    entries = strict_json(anomalies)
    if isinstance(entries, list) and all(isinstance(x, dict) and isinstance(x.get("type"), str) and x["type"] in ANOMALIES and ("id" not in x or isinstance(x["id"], str)) for x in entries):
        row["anomalies"] = [{"type": x["type"], "id": x.get("id")} for x in entries]
    else:
        bad.append("anomalies")
    return bad, row


def _integer(text: str | None):
    from decimal import Decimal

    # a number beyond 38 digits is valid but has no typed value
    return Decimal(text) if text is not None and len(text.lstrip("0")) <= 38 else None


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for line_id, name, line in zip(*(batch.column(i).to_pylist() for i in range(3))):
            fields, offset = tokenize(line or "", "\t" if (name or "").lower().endswith(".tsv") else ",")
            if fields is None:
                reasons, row = ["quoting"], {}
            elif len(fields) != len(COLUMNS):
                reasons, row = ["column_count"], {}
            else:
                reasons, row = check_record(fields)
            row = {} if reasons else row
            row["part_no"], row["n_bytes"] = _integer(row.get("part_no")), _integer(row.get("n_bytes"))
            rows.append({"line_id": line_id, "reasons": reasons, "error_offset": offset if offset >= 0 else None, **row})
        yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)


def parse_records(lines: DataFrame) -> DataFrame:
    """Each record once: typed columns if it is valid, else null columns and its ``reasons`` (with the quoting error's offset)."""
    return lines.select("line_id", "file_name", "line").mapInArrow(_parse, RECORD_SCHEMA)


def valid_records(lines: DataFrame) -> DataFrame:
    """The valid records with typed columns."""
    return parse_records(lines).filter(F.size("reasons") == 0).drop("reasons", "error_offset").dropDuplicates(["line_id"])


def rejected_records(lines: DataFrame) -> DataFrame:
    """(line_id, reason): one row for each reason a record isn't valid."""
    return parse_records(lines).select("line_id", F.explode("reasons").alias("reason")).distinct()


# ---- whole files -----------------------------------------------------------------------------------------------------

#: Chunks that one task composes at once; longer files have a second level above these blocks.
BLOCK_CHUNKS = 1024


def _tables(sep: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, numbers, texts = (batch.column(i) for i in range(3))
            tables = [chunk_table(t or "", sep, True) for t in texts.to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    names,
                    numbers,
                    pa.array([[x.state for x in t] for t in tables], pa.list_(pa.int32())),
                    pa.array([[len(x.record_ends) for x in t] for t in tables], pa.list_(pa.int64())),
                ],
                names=["file_name", "chunk_no", "to_state", "n_ends"],
            )

    return run


def _fold(rows, state: int, count: int):
    """(state, records begun before) in front of each chunk, then behind the last."""
    for to_state, n_ends in rows:
        yield state, count
        if state != BROKEN:
            count += n_ends[state]
            state = to_state[state]
    yield state, count


def split_records(chunks: DataFrame, sep: str = ",") -> DataFrame:
    """(file_name, record_no, record, n_chars, closed) of raw files given as (file_name, chunk_no, text), chunks numbered from 0.

    Three passes: every chunk's transition from every state; the composition, first inside blocks of ``BLOCK_CHUNKS``
    chunks and then over a file's blocks; the pieces of records each chunk holds, joined by record number. A broken or never
    closed quote makes the rest of its file one last record that is not closed; its text is not brought together (``record``
    is null), only measured, so that no task has to hold the rest of a file.
    """
    import pandas as pd

    raw = chunks.select("file_name", F.col("chunk_no").cast("bigint").alias("chunk_no"), "text")
    tables = raw.mapInArrow(_tables(sep), "file_name string, chunk_no bigint, to_state array<int>, n_ends array<bigint>")
    blocks = tables.withColumn("block_no", F.floor(F.col("chunk_no") / BLOCK_CHUNKS))

    def fold_block(key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("chunk_no")
        ends = [list(_fold(zip(rows["to_state"], rows["n_ends"]), s, 0))[-1] for s in STATES]
        return pd.DataFrame({"file_name": [key[0]], "block_no": [key[1]], "to_state": [[e[0] for e in ends]], "n_ends": [[e[1] for e in ends]]})

    whole = blocks.groupBy("file_name", "block_no").applyInPandas(fold_block, "file_name string, block_no bigint, to_state array<int>, n_ends array<bigint>")

    def fold_file(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("block_no")
        *found, (end, total) = _fold(zip(rows["to_state"], rows["n_ends"]), START, 0)
        # the number of the record that is never closed, if there is one
        unclosed = total if end in (BROKEN, QUOTED) else -1
        return pd.DataFrame({"file_name": rows["file_name"], "block_no": rows["block_no"], "state": [x[0] for x in found], "records": [x[1] for x in found], "unclosed": unclosed})

    at_block = whole.groupBy("file_name").applyInPandas(fold_file, "file_name string, block_no bigint, state int, records bigint, unclosed bigint")

    def fold_chunks(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("chunk_no")
        found = list(_fold(zip(rows["to_state"], rows["n_ends"]), int(rows["state"].iloc[0]), int(rows["records"].iloc[0])))[:-1]
        return pd.DataFrame({"file_name": rows["file_name"], "chunk_no": rows["chunk_no"], "state": [x[0] for x in found], "records": [x[1] for x in found], "unclosed": rows["unclosed"]})

    at_chunk = blocks.join(at_block, ["file_name", "block_no"]).groupBy("file_name", "block_no").applyInPandas(fold_chunks, "file_name string, chunk_no bigint, state int, records bigint, unclosed bigint")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for name, number, text, state, before, unclosed in zip(*(batch.column(i).to_pylist() for i in range(6))):
                text = text or ""
                ends = read_chunk(text, state, sep, True).record_ends if state != BROKEN else ()
                last = 0
                for k, end in enumerate((*ends, len(text))):
                    out.append((name, before + k, number, None if before + k == unclosed else text[last:end], end - last, k < len(ends)))
                    last = end + 1
            cols = list(zip(*out)) if out else [[]] * 6
            types = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["file_name", "record_no", "chunk_no", "piece", "size", "closed"])

    parts = raw.join(at_chunk, ["file_name", "chunk_no"]).select("file_name", "chunk_no", "text", "state", "records", "unclosed").mapInArrow(pieces, "file_name string, record_no bigint, chunk_no bigint, piece string, size bigint, closed boolean")
    joined = parts.groupBy("file_name", "record_no").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("piece").isNotNull(), F.struct("chunk_no", "piece")))), lambda x: x["piece"]), "").alias("joined"),
        F.count("piece").alias("pieces"), F.sum("size").alias("n_chars"), F.bool_or("closed").alias("closed"),
    )
    record = F.when(F.col("pieces") > 0, F.regexp_replace("joined", r"\r\z", ""))
    # the empty piece behind a file's last line feed is no record
    return joined.filter((F.col("n_chars") > 0) | F.col("closed")).select("file_name", "record_no", record.alias("record"), "n_chars", "closed")
