"""Reading named tables, and cutting lineage through the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no folder, as in tests.
FALLBACK_SHARED_DIR = "file:///tmp/checkpoints"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``sf_dir`` (any path that Spark's readers open)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows that ``spread`` puts into a part where it is told their number.
ROWS_A_PART = 100_000


def spread(df: DataFrame, *keys: str, rows: int = 0) -> DataFrame:
    """``df`` in as many parts as a shuffle has: rows of few bytes that much is computed for would be a task or two by their size.
    Where ``rows`` are more than these parts should hold there are more parts, so that a task's memory does not grow with the input."""
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS_A_PART)), *keys)


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where it is unset, a fallback is set and used."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = FALLBACK_SHARED_DIR
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, deleted when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/plumbline/{label}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def open_path(path: str):
    """(filesystem, path in it) of a URI or a plain path, for tasks that read a file themselves."""
    from pyarrow import fs

    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and return a scan of it.

    What is built on the result no longer depends on the inputs of ``df``: lost executors cost a reread of these
    files, not a recomputation, and values such as ``monotonically_increasing_id`` stay as they were written.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
