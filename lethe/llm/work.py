"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir`` or the context's; one of our own only where there is neither and all is one machine."""
    context = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not path:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spark-"))
        path = context.getCheckpointDir()
    return path.rstrip("/")


def saved(df: DataFrame, name: str, beside: DataFrame | None = None) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: later jobs do not depend on lost executors.

    beside: a saved table of which df is a small extract; df then becomes an eighth as many files, whatever the number
    of shuffle partitions. In a local folder each file costs an executor three processes, whose start shares all its memory.
    The folder is deleted when the driver's JVM ends.
    """
    if beside is not None:
        df = df.repartition(-(-len(beside.inputFiles()) // 8) or 1)
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lethe-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def sized_broadcast(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """Hint a broadcast only where the counted rows stay within the limit; a shuffled join beyond it."""
    return F.broadcast(df) if rows <= limit else df


def parts(batches, rows: int = 256):
    """Arrow batches in slices of so many rows, which bounds what a task holds as Python objects."""
    for batch in batches:
        for lo in range(0, len(batch), rows):
            yield batch.slice(lo, rows)


def trimmed(run):
    """A function of a task's batches, after which its worker, which lives on for other tasks, gives back the memory it no longer uses."""

    def all_of(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # not every system has it
                ctypes.CDLL(None).malloc_trim(0)

    return all_of
