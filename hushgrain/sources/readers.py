"""Where data comes from. Schemas are stated, never inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hushgrain.functions.text import strip
from hushgrain.schema import ANNOTATED, CACHE, RESULTS


def annotated(spark: SparkSession, path: str, form: str = "json", split: str | None = None) -> DataFrame:
    """Annotated documents (JSON lines or Parquet), of one split or all."""
    docs = spark.read.schema(ANNOTATED).format(form).load(path)
    return docs if split is None else docs.where(F.col("split") == split)


def text_files(spark: SparkSession, path: str, pattern: str = "*.txt") -> DataFrame:
    """(doc_id, text): one document for each file, its name without the ending."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter=pattern)
    return files.select(F.regexp_extract(F.input_file_name(), "([^/]+?)(\\.[^./]*)?$", 1).alias("doc_id"), F.col("value").alias("text"))


def example_texts(spark: SparkSession, path: str) -> DataFrame:
    """Text files without white space at their ends, by name."""
    return text_files(spark, path).withColumn("text", strip(F.col("text"))).orderBy("doc_id")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def results_csv(spark: SparkSession, path: str, model: str) -> DataFrame | None:
    """A results table; `model` is added where the file has no such column. None if it isn't there."""
    if not exists(spark, path):
        return None
    header = spark.read.text(path).first()
    named = header is not None and header[0].split(",")[0].strip() == "model"
    fields = RESULTS if named else RESULTS.partition(", ")[2]
    table = spark.read.schema(fields).csv(path, header=True)
    return table if named else table.select(F.lit(model).alias("model"), "*")


def predictions(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame:
    """The prediction cache (doc_id, model, spans)."""
    return spark.read.schema(CACHE).format(form).load(path)


def vault_json(text: Column) -> Column:
    """A column of JSON objects {token: name} as maps; null if one isn't an object."""
    return F.from_json(text, "map<string,string>")


def vaults(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, vault) of files that hold one JSON object each."""
    return text_files(spark, path, "*.json").select("doc_id", vault_json(F.col("text")).alias("vault"))
