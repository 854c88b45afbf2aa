"""Scoring of span detectors against gold annotations.

Matching is greedy and one to one, in the order of the predictions, within a document: one Arrow
function over its arrays, without a shuffle. Counts are then summed in a long table.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.window import Window

from hushgrain.functions.text import apart, empty, overlaps
from hushgrain.schema import ALL, ENTITY_TYPES, PREDICTED

MODES = ("partial", "exact")


def gold(mentions: Column) -> Column:
    """DIRECT and QUASI mentions as predicted spans, in their order."""
    kept = F.filter(mentions, lambda m: m["identifier_type"].isin("DIRECT", "QUASI"))
    return F.transform(kept, lambda m: F.struct(m["start_offset"].alias("start"), m["end_offset"].alias("end"), m["entity_type"].alias("entity_type"), m["span_text"].alias("text")).cast(PREDICTED))


def fits(a: Column, b: Column, mode: str) -> Column:
    """Equal offsets if mode is "exact"; else any overlap."""
    return ((a["start"] == b["start"]) & (a["end"] == b["end"])) if mode == "exact" else overlaps(a, b)


def scored(predicted: Column) -> Column:
    """Predictions of known entity types only."""
    return F.filter(predicted, lambda p: p["entity_type"].isin(*ENTITY_TYPES))


def greedy(start: list[int], end: list[int], kind: list[str], g_start: list[int], g_end: list[int], g_kind: list[str], exact: bool) -> list[int]:
    """For each prediction, the position in gold that it takes: the first free one of its type that
    it fits, or -1. Gold spans are found by place, or in their order from the first that is free."""
    by: dict = {}
    for i, k in enumerate(g_kind):
        by.setdefault((k, g_start[i], g_end[i]) if exact else k, []).append(i)
    out = []
    if exact:
        for own in by.values():
            own.reverse()
        for x in zip(kind, start, end):
            free = by.get(x)
            out.append(free.pop() if free else -1)
        return out
    for k, a, z in zip(kind, start, end):
        free = by.get(k, ())
        n = next((n for n, i in enumerate(free) if g_start[i] < z and g_end[i] > a), -1)
        out.append(free.pop(n) if n >= 0 else -1)
    return out


def match(predicted: Column, golden: Column, mode: str) -> Column:
    """greedy for each document: array<int>. One Arrow function over columns of numbers."""
    slim = lambda spans: apart(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["entity_type"].alias("entity_type"))))

    @arrow_udf("array<int>")
    def run(said: pa.Array, gold_: pa.Array) -> pa.Array:
        sides = []
        for lists in (said, gold_):
            at = (lists.offsets.to_numpy() - lists.offsets[0].as_py()).tolist()
            sides.append((at, *(lists.flatten().field(c).to_pylist() for c in ("start", "end", "entity_type"))))
        (at, *p), (g_at, *g) = sides
        out = []
        for a, z, b, y in zip(at, at[1:], g_at, g_at[1:]):
            out += greedy(*(c[a:z] for c in p), *(c[b:y] for c in g), mode == "exact")
        return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(out, pa.int32()))

    return apart(run(slim(predicted), slim(golden)))


def outcomes(docs: DataFrame, mode: str, *keys: str) -> DataFrame:
    """docs: keys, predicted, gold. One row (keys, entity_type, outcome tp/fp/fn, start, end) for each
    prediction and each gold span left over."""
    return _outcomes(docs, mode, *keys).where(F.col("outcome").isNotNull())


def _outcomes(docs: DataFrame, mode: str, *keys: str) -> DataFrame:
    """outcomes, and for each document a row without one, so that its keys occur."""
    own = docs.select(*keys, F.coalesce(scored(F.col("predicted")), empty(f"array<{PREDICTED}>")).alias("p"), F.coalesce("gold", empty(f"array<{PREDICTED}>")).alias("g"))
    own = own.withColumn("m", match(F.col("p"), F.col("g"), mode))
    said = F.transform("p", lambda p, i: F.struct(p["entity_type"].alias("entity_type"), F.when(F.get("m", i) >= 0, "tp").otherwise("fp").alias("outcome"), p["start"].alias("start"), p["end"].alias("end")))
    missed = F.array_except(F.when(F.size("g") > 0, F.sequence(F.lit(0), F.size("g") - 1)).otherwise(empty("array<int>")), "m")
    left = F.transform(missed, lambda i: F.struct(F.get("g", i)["entity_type"].alias("entity_type"), F.lit("fn").alias("outcome"), F.get("g", i)["start"].alias("start"), F.get("g", i)["end"].alias("end")))
    mark = F.expr("array(struct(cast(null as string) as entity_type, cast(null as string) as outcome, cast(null as int) as start, cast(null as int) as end))")
    return own.select(*keys, F.explode(F.concat(said, left, mark)).alias("o")).select(*keys, "o.*")


def counts(docs: DataFrame, mode: str, *keys: str) -> DataFrame:
    """(keys, mode, entity_type, tp, fp, fn) for all entity types and the total. Documents are matched
    once: their keys come from the same sums as the counts."""
    summed = _outcomes(docs, mode, *keys).groupBy(*keys, "entity_type").agg(*[F.count_if(F.col("outcome") == o).alias(o) for o in ("tp", "fp", "fn")])
    entry = F.struct("entity_type", "tp", "fp", "fn")
    by_key = summed.groupBy(*keys).agg(F.collect_list(entry).alias("e"))  # at most one for each entity type
    types = F.array(*[F.lit(t) for t in (*ENTITY_TYPES, ALL)])
    of = lambda t, o: F.aggregate(F.filter("e", lambda x: (t == ALL) | (x["entity_type"] == t)), F.lit(0).cast("long"), lambda n, x: n + x[o])
    if not keys:  # a table without documents has rows, too
        by_key = summed.agg(F.collect_list(entry).alias("e"))
    filled = by_key.select(*keys, F.explode(F.transform(types, lambda t: F.struct(t.alias("entity_type"), *[of(t, o).alias(o) for o in ("tp", "fp", "fn")]))).alias("x"))
    return filled.select(*keys, F.lit(mode).alias("mode"), "x.entity_type", "x.tp", "x.fp", "x.fn")


def with_scores(table: DataFrame) -> DataFrame:
    """precision, recall and f1 of tp, fp, fn; 0 where there is nothing to divide by."""
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return table.withColumn("precision", p).withColumn("recall", r).withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def results(docs: DataFrame, *keys: str, modes: tuple[str, ...] = MODES) -> DataFrame:
    """The tidy table: (keys, mode, entity_type, precision, recall, f1, tp, fp, fn)."""
    out = None
    for mode in modes:
        part = counts(docs, mode, *keys)
        out = part if out is None else out.unionByName(part)
    return with_scores(out).select(*keys, "mode", "entity_type", "precision", "recall", "f1", "tp", "fp", "fn")


def type_order(entity_type: Column) -> Column:
    """To sort a results table as it is usually shown."""
    return F.array_position(F.array(*map(F.lit, (*ENTITY_TYPES, ALL))), entity_type)


def entity_recall(docs: DataFrame, *keys: str) -> DataFrame:
    """docs: keys, doc_id, entity_mentions, predicted. (keys, doc_id, entity_id, entity_type,
    n_mentions, n_found): of each entity's DIRECT and QUASI mentions, how many overlap a prediction
    of the type of the entity's first mention; predictions may serve many mentions."""
    rows = docs.select(*keys, "doc_id", "predicted", F.posexplode(F.filter("entity_mentions", lambda m: m["identifier_type"].isin("DIRECT", "QUASI"))).alias("pos", "m"))
    first = F.first_value("m.entity_type").over(Window.partitionBy(*keys, "doc_id", "m.entity_id").orderBy("pos"))
    rows = rows.withColumn("kind", first)
    found = F.exists("predicted", lambda p: (p["entity_type"] == F.col("kind")) & (p["start"] < F.col("m.end_offset")) & (p["end"] > F.col("m.start_offset")))
    own = rows.select(*keys, "doc_id", F.col("m.entity_id").alias("entity_id"), F.col("kind").alias("entity_type"), F.coalesce(found, F.lit(False)).alias("found"))
    return own.groupBy(*keys, "doc_id", "entity_id", "entity_type").agg(F.count("*").alias("n_mentions"), F.count_if("found").alias("n_found"))


def recall_summary(entities: DataFrame, *keys: str) -> DataFrame:
    """(keys, n_entities, n_mentions, macro_recall, micro_recall)."""
    return entities.groupBy(*keys).agg(
        F.count("*").alias("n_entities"),
        F.coalesce(F.sum("n_mentions"), F.lit(0)).alias("n_mentions"),
        F.coalesce(F.avg(F.col("n_found") / F.col("n_mentions")), F.lit(0.0)).alias("macro_recall"),
        (F.coalesce(F.sum("n_found"), F.lit(0)) / F.greatest(F.lit(1), F.coalesce(F.sum("n_mentions"), F.lit(0)))).alias("micro_recall"),
    )


def unmatched(docs: DataFrame, *keys: str) -> tuple[DataFrame, DataFrame]:
    """Missed gold spans, and false alarms: those that overlap none of their type on the other side."""
    lone = lambda a, b: F.filter(a, lambda x: ~F.exists(b, lambda y: (x["entity_type"] == y["entity_type"]) & overlaps(x, y)))
    missed = docs.select(*keys, "doc_id", F.explode(lone("gold", "predicted")).alias("s")).select(*keys, "doc_id", "s.*")
    false = docs.select(*keys, "doc_id", F.explode(lone("predicted", "gold")).alias("s")).select(*keys, "doc_id", "s.*")
    return missed, false


def f1_pivot(table: DataFrame, models: list[str], mode: str = "partial") -> DataFrame:
    """entity_type by model, mean f1."""
    return table.where(F.col("mode") == mode).groupBy("entity_type").pivot("model", models).agg(F.avg("f1"))


def routing(table: DataFrame, models: list[str], mode: str = "partial") -> DataFrame:
    """(entity_type, model): the model with the best f1 for each type, the first one in models on a tie."""
    order = F.array_position(F.array(*map(F.lit, models)), F.col("model"))
    own = table.where((F.col("mode") == mode) & (F.col("entity_type") != ALL) & F.col("model").isin(*models))
    return own.groupBy("entity_type").agg(F.max_by("model", F.struct("f1", -order)).alias("model"))


def best_strategy(table: DataFrame, mode: str = "partial") -> DataFrame:
    """Strategies by the total's f1, each with its distance from the best."""
    own = table.where((F.col("mode") == mode) & (F.col("entity_type") == ALL))
    return own.crossJoin(own.agg(F.max("f1").alias("best"))).select("strategy", "f1", (F.col("f1") - F.col("best")).alias("behind"))


# Summaries of annotated corpora


def dataset_summary(docs: DataFrame) -> DataFrame:
    """(measure, split, entity_type, role, n): rows of each split, and mentions by type, role and both."""
    mentions = docs.select("split", F.explode("entity_mentions").alias("m")).select("split", "m.entity_type", F.col("m.identifier_type").alias("role"))
    sets = mentions.cube("entity_type", "role").agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    name = F.element_at(F.array(*map(F.lit, ("type_role", "type", "role", "mentions"))), F.col("g").cast("int") + 1)
    null = F.lit(None).cast("string")
    by_split = docs.groupBy("split").agg(F.count("*").alias("n")).select(F.lit("documents").alias("measure"), "split", null.alias("entity_type"), null.alias("role"), "n")
    return by_split.unionByName(sets.select(name.alias("measure"), null.alias("split"), "entity_type", "role", "n"))


def disagreement(docs: DataFrame) -> DataFrame:
    """(n_entities, n_disagreed, rate): entities whose mentions have more than one role."""
    mentions = docs.select(F.explode("entity_mentions").alias("m")).select("m.entity_id", "m.identifier_type")
    each = mentions.groupBy("entity_id").agg(F.count_distinct("identifier_type").alias("roles"))
    n, d = F.count("*"), F.count_if(F.col("roles") > 1)
    return each.agg(n.alias("n_entities"), d.alias("n_disagreed"), F.coalesce(F.try_divide(d, n), F.lit(0.0)).alias("rate"))


def examples(docs: DataFrame, n: int = 3) -> DataFrame:
    """Up to n distinct texts for each type and role, drawn by a hash of the text."""
    mentions = docs.select(F.explode("entity_mentions").alias("m")).select("m.entity_type", F.col("m.identifier_type").alias("role"), F.col("m.span_text").alias("text")).distinct()
    w = Window.partitionBy("entity_type", "role").orderBy(F.md5("text"), "text")
    return mentions.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= n)


def top_documents(docs: DataFrame, n: int = 10) -> DataFrame:
    """The n documents with the most mentions, ties by doc_id."""
    return docs.select("doc_id", F.size("entity_mentions").cast("long").alias("n_mentions")).orderBy(F.desc("n_mentions"), "doc_id").limit(n)


def nth_document(docs: DataFrame, nth: int = 3) -> DataFrame:
    """The row of top_documents that comes nth: to pick one that is rich, but no outlier."""
    order = Window.orderBy(F.desc("n_mentions"), "doc_id")  # of nth rows at most
    return top_documents(docs, nth).withColumn("nth", F.row_number().over(order)).where(F.col("nth") == nth).drop("nth")


def distinct_direct(docs: DataFrame) -> DataFrame:
    """(doc_id, entity_type, text, first): distinct DIRECT spans with their first position."""
    rows = docs.select("doc_id", F.explode(F.filter("spans", lambda s: s["identifier_role"] == "DIRECT")).alias("s"))
    return rows.groupBy("doc_id", F.col("s.entity_type").alias("entity_type"), F.col("s.text").alias("text")).agg(F.min("s.start").alias("first"))


def sample(docs: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n rows, the same ones for the same seed however the table is partitioned."""
    return docs.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string"))), "doc_id").limit(n)


def first_rows(docs: DataFrame, n: int) -> DataFrame:
    return docs.orderBy("doc_id").limit(n)
