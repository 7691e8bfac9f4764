"""Archives as a stream: files that arrive in a folder are parsed and converted as they come. No state is kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from foliant.operators.archives import convert_archives
from foliant.sources.archivefiles import PATTERN

FILE = "path string, modificationTime timestamp, length bigint, content binary"


def stream_archives(spark: SparkSession, folder: str, files_per_trigger: int = 1000, pattern: str = PATTERN) -> DataFrame:
    """(archive_id, content) of the archive files that arrive in a folder."""
    reader = spark.readStream.format("binaryFile").schema(FILE).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(folder).select(F.col("path").alias("archive_id"), "content")


def convert_stream(spark: SparkSession, folder: str, output: str, checkpoint: str, scripts: bool = False, once: bool = True) -> StreamingQuery:
    """Pages of arriving archives, as a Parquet table; each archive is converted once, whatever fails between."""
    pages = convert_archives(stream_archives(spark, folder), scripts)
    writer = pages.writeStream.format("parquet").option("path", output).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()
