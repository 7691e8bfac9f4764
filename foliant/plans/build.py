"""Building archives from table rows, as Catalyst expressions: the inputs of the registered queries and of tests."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions import mimeheader, transfer

BOUNDARY = "----=_foliant_boundary"


def part(body: Column, content_type: str | Column = "text/plain; charset=utf-8", encoding: str = "8bit", location: Column | None = None, content_id: Column | None = None, eol: str = "\r\n") -> Column:
    """One part, with its delimiter in front and a line end behind."""
    pieces = [F.lit(f"--{BOUNDARY}{eol}Content-Type: "), content_type if isinstance(content_type, Column) else F.lit(content_type), F.lit(f"{eol}Content-Transfer-Encoding: {encoding}{eol}")]
    if location is not None:
        pieces += [F.lit("Content-Location: "), location, F.lit(eol)]
    if content_id is not None:
        pieces += [F.lit("Content-ID: "), content_id, F.lit(eol)]
    return F.concat(*pieces, F.lit(eol), body, F.lit(eol))


def archive(*parts: Column, headers: Column | None = None, preamble: str = "", closing: bool = True, eol: str = "\r\n", subtype: str = "related", boundary: str = BOUNDARY) -> Column:
    """The archive's text."""
    top = [F.lit(f'Content-Type: multipart/{subtype}; boundary="{boundary}"{eol}')]
    if headers is not None:
        top.insert(0, headers)
    return F.concat(*top, F.lit(eol + preamble), *parts, F.lit(f"--{BOUNDARY}--{eol}" if closing else ""))


def _mapped(kernel, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = pa.array([None if v is None else kernel(v) for v in batch.column(1).to_pylist()], pa.string() if kind == "string" else pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), values], names=["key", "value"])

    return run


def mapped(rows: DataFrame, key: str, value: Column, kernel, kind: str = "string") -> DataFrame:
    """(key, value) with a kernel applied to the value in Arrow batches."""
    source = rows.select(F.col(key).alias("key"), value.alias("value"))
    return source.mapInArrow(_mapped(kernel, kind), f"key {rows.schema[key].dataType.simpleString()}, value {kind}").withColumnRenamed("key", key)


def quoted_printable(text: str) -> str:
    return transfer.encode_quoted_printable(text.encode("utf-8")).decode("ascii")


def words_b(text: str) -> str:
    return mimeheader.encode_words(text)


def words_q(text: str) -> str:
    return mimeheader.encode_words(text, how="Q", per_word=20)
