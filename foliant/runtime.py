"""Session helpers: reading tables, and cutting lineage with tables in the shared checkpoint folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """The Parquet table ``name`` under ``base``."""
    return spark.read.parquet(f"{base}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``); a local one only where none is set, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    local = os.path.join(tempfile.gettempdir(), f"foliant-{os.getuid()}-{spark.sparkContext.applicationId}")
    os.makedirs(local, exist_ok=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{local}")
    atexit.register(shutil.rmtree, local, True)
    return f"file://{local}"


_written: list[str] = []


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def release(*tables: DataFrame) -> None:
    """Deletes tables of ``materialize`` that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_foliant_path", None)
        if path in _written:
            _delete(df.sparkSession, path)
            _written.remove(path)


def _clear(spark: SparkSession) -> None:
    """Deletes the tables of ``materialize``, as far as the session still lives."""
    try:
        for path in _written:
            _delete(spark, path)
    except Exception:  # noqa: BLE001 - the session has ended; the folder's owner clears it
        pass


def materialize(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back.

    Used where a plan needs the same expensive rows twice. The files outlive a lost executor, so nothing is recomputed
    from a single copy; they are deleted by ``release``, or when the driver's process ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/foliant-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _written:
        atexit.register(_clear, spark)
    _written.append(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._foliant_path = path
    return table


def ship(spark: SparkSession) -> None:
    """Make the package importable in the Python workers of every executor (once per session)."""
    context = spark.sparkContext
    if getattr(context, "_foliant_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="foliant-zip-")
    atexit.register(shutil.rmtree, folder, True)
    archive = shutil.make_archive(os.path.join(folder, "foliant"), "zip", os.path.dirname(root), os.path.basename(root))
    context.addPyFile(archive)
    context._foliant_shipped = True
