"""Cutting lineage with tables in the folder that all executors share."""

from __future__ import annotations

import ctypes
import gc
import os
import sys
import tempfile
import time
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_local_dir: str | None = None
_released = 0.0


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; on a local master without that
    setting, one temporary folder for this process."""
    global _local_dir
    conf = spark.sparkContext.getConf()
    named = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _local_dir is None:
        _local_dir = tempfile.mkdtemp(prefix="arborlake-stage-")
    return _local_dir


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back, so that later
    uses neither recompute it nor depend on blocks that live on one executor."""
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), "stage", f"{name}-{uuid.uuid4().hex}")
    release(spark)  # the tables before this one are written
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stage_path = path  # type: ignore[attr-defined]
    return out


def discard(df: DataFrame) -> None:
    """Delete the table behind ``df``, if ``materialise`` wrote it; for tables that nothing will
    read any more."""
    path = getattr(df, "_stage_path", None)
    if path:
        where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession, seconds: float = 3.0) -> None:
    """Let go of what nothing refers to any more: shuffle files and broadcasts of queries that
    have ended, which Spark deletes once the driver's collector finds them dead, and heap that
    the driver and its Python no longer need.  Left to itself, the collector may not come by for the whole
    job.  At most once in so many ``seconds``."""
    global _released
    if time.monotonic() - _released < seconds:
        return
    gc.collect()  # Python's handles keep their Java objects alive
    for _ in range(2):  # the first pass frees the queries, the second their shuffles
        spark._jvm.System.gc()
        time.sleep(0.1)
    trim()
    _released = time.monotonic()


def trim() -> None:
    """Free memory of this Python goes back to the system; also for workers, which stay after a task."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux" and hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)
