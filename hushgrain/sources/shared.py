"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Used only where one process is driver and executor and the session names no folder, as in tests.
LOCAL_SHARED = "/tmp/checkpoints"

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and every executor can reach: spark.checkpoint.dir. A cluster has to
    name it; a folder of each machine's own would lose rows."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    master = spark.conf.get("spark.master", "")
    if not named and (not master.startswith("local") or master.startswith("local-cluster")):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (named or LOCAL_SHARED).rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A path that is removed when Python ends."""
    path = f"{shared_dir(spark)}/hushgrain-{label}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def written(df: DataFrame, label: str) -> DataFrame:
    """Writes df and returns a read of it: its lineage ends there, and a lost executor costs only
    the tasks that were running. The number of rows is counted as they are written (see rows_of)."""
    spark = df.sparkSession
    path, seen = new_path(spark, label), Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._hushgrain_table = path, seen.get["n"]
    return out


def rows_of(df: DataFrame, most: int) -> int:
    """How many rows df has, if not more than most; counted, unless df is a table from written()."""
    known = getattr(df, "_hushgrain_table", None)
    return known[1] if known else df.limit(most + 1).count()


def drop(*tables: DataFrame) -> None:
    """Removes tables from written() that nothing reads any more."""
    for df in tables:
        path, _ = df._hushgrain_table
        remove(df.sparkSession, path)
        _made[:] = [x for x in _made if x[1] != path]


@atexit.register
def clean() -> None:
    """Removes what was written; results that were not stored elsewhere go with it."""
    while _made:
        try:
            remove(*_made.pop())
        except Exception:  # the session has ended; the folder's owner cleans it
            return
