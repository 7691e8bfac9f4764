"""Reading archive files and writing pages."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import columns

#: File names of archives; the pattern is case-sensitive, so each letter stands in both cases.
PATTERN = "*.[mM][hH][tT]{,[mM][lL]}"


def read_archives(spark: SparkSession, paths: str | list[str], recursive: bool = True, pattern: str | None = PATTERN, max_bytes: int | None = None) -> DataFrame:
    """(archive_id, path, length, content) of archive files, directories or globs; the path is the id.

    With ``max_bytes`` longer files are left out before their content is read: the filter reaches the scan.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    files = reader.load(paths)
    if max_bytes is not None:
        files = files.filter(F.col("length") <= max_bytes)
    return files.select(F.col("path").alias("archive_id"), "path", "length", "content")


def from_strings(rows: DataFrame, text: str = "content") -> DataFrame:
    """Archives given as strings: their UTF-8 bytes."""
    return rows.withColumn(text, F.encode(F.col(text), "utf-8"))


def expand(spark: SparkSession, patterns: list[str]) -> tuple[list[str], list[str]]:
    """(paths, patterns that match nothing): globs and plain paths of any file system Hadoop reads."""
    conf = spark._jsc.hadoopConfiguration()
    found: dict[str, None] = {}
    missing = []
    for pattern in patterns:
        place = spark._jvm.org.apache.hadoop.fs.Path(pattern)
        status = place.getFileSystem(conf).globStatus(place)
        if not status:
            missing.append(pattern)
        for one in status or ():
            found.setdefault(one.getPath().toString())
    return sorted(found), missing


def put_file(uri: str, content: bytes) -> None:
    """Writes a file whole under another name and moves it, so that a task that runs twice leaves one file."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri.removeprefix("file:"))
    temporary = f"{path}.{os.getpid()}.tmp"
    system.create_dir(os.path.dirname(path), recursive=True)
    with system.open_output_stream(temporary) as f:
        f.write(content)
    system.move(temporary, path)


def _uri(path: str) -> str:
    """Spark's ``file:/a`` as ``file:///a``."""
    return "file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path


def put_files(batches: Iterator) -> Iterator:
    """Writes batches of (address, content) as files and gives their addresses."""
    for batch in batches:
        for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            put_file(_uri(name), content)
        yield batch.select([0])


def write_pages(converted: DataFrame, folder: str | None = None) -> int:
    """Writes each page as one file beside its archive, or into ``folder``, which all executors must share.

    In ``folder`` a page has its archive's path below what all paths have in common, so that no page takes another's place.
    The number of pages is returned; archives with an error are left out.
    """
    named = converted.filter("error IS NULL").withColumn("name", columns.output_name(F.col("archive_id")))
    home = ""
    if folder is not None:
        ends = named.agg(F.min("name").alias("first"), F.max("name").alias("last")).first()
        home = os.path.commonprefix([ends["first"] or "", ends["last"] or ""]).rpartition("/")[0] + "/"

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for name, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                below = name.removeprefix(home).lstrip("/")
                put_file(_uri(f"{folder.rstrip('/')}/{below}" if folder is not None else name), page.encode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch.column(0)], names=["name"])

    return named.select("name", "html").mapInArrow(run, "name string").count()
