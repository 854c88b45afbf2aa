"""Combination of several detectors' spans: votes over overlapping groups, and routing by type."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hushgrain.sources.shared import rows_of, written

#: Routes that are broadcast (two short strings each).
BROADCAST_ROUTES = 100_000


def check(models: list[str], min_votes: int, tie_break: str) -> None:
    if not models:
        raise ValueError("an ensemble needs a predictor")
    if not 1 <= min_votes <= len(models):
        raise ValueError(f"min_votes must be from 1 to {len(models)}")
    if tie_break not in ("longest", "shortest"):
        raise ValueError("tie_break must be longest or shortest")


def exploded(cache: DataFrame) -> DataFrame:
    """(doc_id, model, ord, start, end, entity_type, text) of a prediction cache (doc_id, model, spans)."""
    return cache.select("doc_id", "model", F.posexplode("spans").alias("ord", "s")).select("doc_id", "model", "ord", "s.*")


def groups(spans: DataFrame, *keys: str) -> DataFrame:
    """spans with `grp`: the number, in its document, of the group of spans that overlap, directly or
    over others; touching spans don't. One window over each document's spans."""
    own = [*keys, "doc_id"]
    order = Window.partitionBy(*own).orderBy("start", "end", "model", "ord")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    starts = spans.withColumn("new", F.when(before.isNull() | (F.col("start") >= before), 1).otherwise(0))
    return starts.withColumn("grp", F.sum("new").over(order)).drop("new")


def voted(spans: DataFrame, models: list[str], tie_break: str = "longest", *keys: str) -> DataFrame:
    """One row for each group: (keys, doc_id, grp, n_voters, start, end, entity_type, text). The type
    with the most spans wins, on a tie the one that comes first by start and end; of its spans the
    longest (shortest) stays, on a tie the one with the greater (lesser) text."""
    check(models, 1, tie_break)
    own = [*keys, "doc_id", "grp"]
    grouped = groups(spans.where(F.col("model").isin(*models)), *keys)
    place = {m: i for i, m in enumerate(models)}
    nth = F.create_map(*[x for m, i in place.items() for x in (F.lit(m), F.lit(i))])[F.col("model")]
    first = F.struct("start", "end", nth.alias("m"), "ord")
    best = F.struct(F.length("text").alias("len"), "text", (-F.col("start")).alias("s"), (-F.col("end")).alias("e"))
    by_type = grouped.groupBy(*own, "entity_type").agg(F.count("*").alias("n"), F.collect_set("model").alias("models"), F.min(first).alias("first"), (F.max(best) if tie_break == "longest" else F.min(best)).alias("b"))
    w = Window.partitionBy(*own)
    voters = F.size(F.array_distinct(F.flatten(F.collect_list("models").over(w)))).cast("long")  # of the models at most
    won = by_type.withColumn("n_voters", voters).withColumn("nth", F.row_number().over(w.orderBy(F.desc("n"), "first"))).where("nth = 1")
    return won.select(*own, "n_voters", (-F.col("b.s")).alias("start"), (-F.col("b.e")).alias("end"), "entity_type", F.col("b.text").alias("text"))


def vote(spans: DataFrame, models: list[str], min_votes: int = 1, tie_break: str = "longest") -> DataFrame:
    """The groups that at least min_votes different detectors have found."""
    check(models, min_votes, tie_break)
    return voted(spans, models, tie_break).where(F.col("n_voters") >= min_votes)


def sweep(spans: DataFrame, models: list[str]) -> DataFrame:
    """vote for every min_votes at once, with a column min_votes; groups are formed once."""
    kept = voted(spans, models)
    return kept.withColumn("min_votes", F.explode(F.sequence(F.lit(1), F.col("n_voters").cast("int"))))


def routed(spans: DataFrame, routes: DataFrame) -> DataFrame:
    """A model's spans of the types it is routed. routes: (entity_type, model), a row for each type; they
    are counted, and broadcast if they are few."""
    routes = written(routes, "routes")
    few = rows_of(routes, BROADCAST_ROUTES) <= BROADCAST_ROUTES
    return spans.join(F.broadcast(routes) if few else routes, ["entity_type", "model"], "left_semi")


def collected(spans: DataFrame, *keys: str) -> DataFrame:
    """Rows back to an array `predicted` by start, for scoring: (keys, doc_id, predicted)."""
    row = F.struct("start", "end", "entity_type", "text")
    return spans.groupBy(*keys, "doc_id").agg(F.array_sort(F.collect_list(row)).alias("predicted"))
