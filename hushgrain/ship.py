"""Makes the package importable in Python workers that don't have it on their path."""

from __future__ import annotations

import functools
import os
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_ROOT = Path(__file__).resolve().parent.parent


def ship(spark: SparkSession) -> None:
    """Sends the package with Spark's own file distribution, once for each application."""
    context = spark.sparkContext
    on_path = [os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if str(_ROOT) in on_path and context.master.startswith("local") or getattr(context, "_hushgrain_shipped", False):
        return
    path = Path(tempfile.mkdtemp()) / "hushgrain.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted((_ROOT / "hushgrain").rglob("*.py")):
            z.write(f, f.relative_to(_ROOT))
        if (_ROOT / "corpus_pipeline.py").exists():
            z.write(_ROOT / "corpus_pipeline.py", "corpus_pipeline.py")
    context.addPyFile(str(path))
    context._hushgrain_shipped = True


def shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run
