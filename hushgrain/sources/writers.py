"""Where results go. Vaults are written apart from redacted texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hushgrain.operators.evaluate import type_order
from hushgrain.operators.pseudonym import vault_table
from hushgrain.schema import CACHE
from hushgrain.sources.readers import exists


def results_csv(table: DataFrame, path: str) -> None:
    """A results table (a few rows) as one CSV file with a header, in the usual order."""
    lead = [c for c in ("model", "strategy") if c in table.columns]
    table.coalesce(1).sortWithinPartitions(*lead, F.desc("mode"), type_order(F.col("entity_type"))).write.mode("overwrite").csv(path, header=True)


def as_json(audit: str | None = None) -> Column:
    """A redacted document as a JSON object; confidence isn't part of it. audit: a column with its
    audit entries."""
    names = ("start", "end", "entity_type", "text", "identifier_role", "source", "generalization_level", "replacement")
    spans = F.transform("spans", lambda s: F.struct(*[s[n].alias(n) for n in names]))
    vault = F.map_from_entries(F.transform("vault", lambda v: F.struct(v["token"], v["original"])))
    entries = [F.col(audit).alias("audit")] if audit else []
    return F.to_json(
        F.struct("redacted_text", spans.alias("spans"), *entries, "mosaic_risk_initial", "mosaic_risk_final", "iterations_used", "converged", vault.alias("pseudonym_vault")),
        {"ignoreNullFields": "false"},
    )


def redacted_json(redacted: DataFrame, path: str) -> None:
    redacted.select(as_json().alias("value")).write.mode("overwrite").text(path)


def as_html() -> Column:
    """A redacted document as a part of an HTML page: its risk, and its text with what was put in marked."""
    text = F.regexp_replace(F.replace(F.replace(F.replace("redacted_text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), "\\[[A-Z]+(?:_[A-Z]+)?\\]", "<mark>$0</mark>")
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    risk = F.concat(F.lit("k "), shown("mosaic_risk_initial"), F.lit(" → "), shown("mosaic_risk_final"), F.lit(", "), shown("iterations_used"), F.lit(" iterations, "), F.when(F.col("converged"), "converged").otherwise("not converged"))
    return F.concat(F.lit("<article><h2>"), F.col("doc_id").cast("string"), F.lit("</h2><p>"), risk, F.lit("</p><pre>"), text, F.lit("</pre></article>"))


def html_pages(redacted: DataFrame, path: str) -> None:
    """Files of articles, to be put between an HTML page's head and end."""
    redacted.select(as_html().alias("value")).write.mode("overwrite").text(path)


def redacted_texts(redacted: DataFrame, path: str) -> None:
    redacted.select("doc_id", "redacted_text").write.mode("overwrite").parquet(path)


def vaults(redacted: DataFrame, path: str) -> None:
    """(doc_id, token, original), to a place with its own access rights."""
    vault_table(redacted).write.mode("overwrite").parquet(path)


def recall_report(entities: DataFrame, summary: DataFrame, folder: str) -> None:
    """Rows of entity_recall as CSV, and their summary as JSON."""
    entities.write.mode("overwrite").csv(f"{folder}/entities", header=True)
    summary.coalesce(1).write.mode("overwrite").json(f"{folder}/summary")


def resume_predictions(spark: SparkSession, docs: DataFrame, models: dict, path: str) -> int:
    """Adds to the cache at path what it lacks: spans of docs (doc_id, text) by each model, a detector
    each. Documents that are there are skipped, so a run that broke off goes on where it stopped.
    Returns the number of models that had something to add."""
    added = 0
    for name, detector in models.items():
        todo = docs
        if exists(spark, path):
            done = spark.read.schema(CACHE).parquet(path).where(F.col("model") == name).select("doc_id")
            todo = docs.join(done, "doc_id", "left_anti")
        if not todo.isEmpty():
            todo.select("doc_id", F.lit(name).alias("model"), detector(F.col("text")).alias("spans")).write.mode("append").parquet(path)
            added += 1
    return added
