"""Lite redaction of a stream. It decides row by row, so it needs neither state nor watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from hushgrain.operators.detect import Detector, detect_spans
from hushgrain.operators.redact import lite


def redacted_stream(docs: DataFrame, detector: Detector | None = None, pseudonymise: bool = False) -> DataFrame:
    """docs: a stream with doc_id and text."""
    return lite(detect_spans(docs, detector), pseudonymise)


def write_redacted(docs: DataFrame, path: str, checkpoint: str, detector: Detector | None = None) -> DataStreamWriter:
    """A writer of redacted texts; start() it."""
    return redacted_stream(docs, detector).select("doc_id", "redacted_text").writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
