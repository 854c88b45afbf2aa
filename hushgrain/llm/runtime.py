"""Helpers that the operators of this subpackage share: written tables, guards on what is broadcast, and
reads with small Arrow batches."""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushgrain.sources.shared import drop, new_path, remove, rows_of, shared_dir, written

__all__ = ["bounded", "drop", "new_path", "read", "remove", "shared_dir", "small_or_not", "table", "tidy"]

#: A side of a join with at most so many rows of a few numbers (16 MB or so) may be broadcast.
BROADCAST_ROWS = 500_000

#: Rows in an Arrow batch, unless the session names another number: a batch of Spark's 10,000 whole
#: texts takes memory in the executor twice and in its Python worker.
ARROW_ROWS = 1000


def bounded(spark: SparkSession) -> SparkSession:
    """Plans run after their operator has returned, so the setting stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(ARROW_ROWS))
    return spark


def table(df: DataFrame, label: str) -> DataFrame:
    """Writes df to the shared folder and returns a read of it: lineage ends there, and lost
    executors cost nothing but the tasks that were running."""
    bounded(df.sparkSession)
    return written(df, label)


def small_or_not(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, marked for broadcast if its number of rows shows that it is small; else Spark shuffles the
    join."""
    return F.broadcast(df) if rows_of(df, rows) <= rows else df


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return bounded(spark).read.parquet(f"{sf_dir}/{name}.parquet")


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library only


def tidy(spark: SparkSession) -> None:
    """Lets go of what earlier steps have left on the driver, for operators of many steps: plans and
    broadcasts that nothing refers to any more, and with them their blocks and shuffle files on the
    executors. Java's and Python's memory goes back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)
    spark._jvm.java.lang.System.gc()
