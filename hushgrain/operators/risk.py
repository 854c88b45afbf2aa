"""Re-identification risk: fingerprints of quasi-identifiers, k-anonymity, and how many facts an
attacker needs.

Facts are one row each, (doc_id, entity_type, value); shuffles are by document, by fact and by
fingerprint. Fingerprints are grouped by a 128-bit digest rather than by their arrays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hushgrain.functions.normalise import normalise
from hushgrain.functions.text import strip
from hushgrain.sources.shared import drop, rows_of, written

QUASI_TYPES = ("DEM", "DATETIME", "LOC", "QUANTITY")
#: A haystack of at most so many fingerprints may be broadcast (about 100 bytes each).
BROADCAST_SIGNATURES = 200_000


def facts(docs: DataFrame, entity_types: tuple[str, ...] = QUASI_TYPES, normalised: bool = False) -> DataFrame:
    """(doc_id, entity_type, value, start) for each QUASI mention of the types; blank values are
    dropped. docs: annotated documents."""
    m = F.col("m")
    kept = F.filter("entity_mentions", lambda x: (x["identifier_type"] == "QUASI") & x["entity_type"].isin(*entity_types))
    value = normalise(m["entity_type"], m["span_text"]) if normalised else F.lower(strip(m["span_text"]))
    rows = docs.select("doc_id", F.explode(kept).alias("m")).select("doc_id", "m.entity_type", value.alias("value"), F.col("m.start_offset").alias("start"))
    return rows.where("value <> ''")


def facts_by_document(rows: DataFrame) -> DataFrame:
    """Distinct facts with the place where each first appears, over all annotators."""
    return rows.groupBy("doc_id", "entity_type", "value").agg(F.min("start").alias("first"))


def _signature() -> Column:
    return F.array_sort(F.collect_set(F.struct("entity_type", "value"))).alias("signature")


def signatures(rows: DataFrame, *by: str) -> DataFrame:
    """The sorted distinct facts of each document (or of each group `by`)."""
    return rows.groupBy(*(by or ("doc_id",))).agg(_signature())


def signature_text(signature: Column) -> Column:
    return F.array_join(F.transform(signature, lambda f: F.concat_ws("=", f["entity_type"], f["value"])), "; ")


def signature_key(signature: Column) -> Column:
    """A digest to join and group by; equal signatures have equal keys."""
    return F.md5(F.array_join(F.transform(signature, lambda f: F.concat(f["entity_type"], F.lit("\x1f"), f["value"])), "\x1e"))


def k_anonymity(rows: DataFrame, min_facts: int = 2) -> DataFrame:
    """(doc_id, signature, n_facts, k): k documents share a fingerprint. Documents with fewer facts
    are left out; annotators of a document are united first."""
    own = signatures(rows).where(F.size("signature") >= min_facts).withColumn("key", signature_key(F.col("signature")))
    sizes = own.groupBy("key").agg(F.count("*").alias("k"))
    return own.join(sizes, "key").select("doc_id", "signature", F.size("signature").cast("long").alias("n_facts"), "k")


def k_distribution(table: DataFrame, at_most: tuple[int, ...] = (1, 2, 3, 4, 5, 10)) -> DataFrame:
    """(k_at_most, n_docs, percent) of a k-anonymity table."""
    counts = [F.struct(F.lit(n).alias("k_at_most"), F.count_if(F.col("k") <= n).alias("n_docs"), F.coalesce(F.try_divide(100.0 * F.count_if(F.col("k") <= n), F.count("*")), F.lit(0.0)).alias("percent")) for n in at_most]
    return table.agg(F.array(*counts).alias("c")).select(F.explode("c").alias("c")).select("c.*")


def haystack(docs: DataFrame, min_facts: int = 2) -> DataFrame:
    """(signature, cnt) of annotated documents. Each annotator's row counts by itself."""
    m = F.filter("entity_mentions", lambda x: (x["identifier_type"] == "QUASI") & x["entity_type"].isin(*QUASI_TYPES))
    values = F.transform(m, lambda x: F.struct(x["entity_type"].alias("entity_type"), F.lower(strip(x["span_text"])).alias("value")))
    signature = F.array_sort(F.array_distinct(F.filter(values, lambda f: f["value"] != "")))
    return docs.select(signature.alias("signature")).where(F.size("signature") >= min_facts).groupBy("signature").agg(F.count("*").alias("cnt"))


def seeded(docs: DataFrame, signature: str, copies: int) -> DataFrame:
    """A haystack in which each document's signature stands `copies` times."""
    return docs.where(F.size(signature) > 0).groupBy(F.col(signature).alias("signature")).agg((F.count("*") * copies).alias("cnt"))


def k_for(docs: DataFrame, hay: DataFrame, signature_cols: list[str], k_cols: list[str], by: str = "doc_id") -> DataFrame:
    """docs with the k of each signature column: how often the haystack has it, 1 at least; for an
    empty signature the haystack's size, 1 at least. Null signatures have a null k. The haystack is
    counted: while it is small each lookup is a broadcast join. Beyond that, all columns are looked up
    together: slim rows (row, column, digest), without empty or null signatures, meet the haystack in
    one join, are put together by row and joined back; no text is shuffled with the signatures. `by`
    must not be null there (a row without it finds nothing)."""
    keyed = written(hay.select(signature_key(F.col("signature")).alias("_key"), "cnt").groupBy("_key").agg(F.sum("cnt").alias("_cnt")), "haystack")
    total = keyed.agg(F.coalesce(F.sum("_cnt"), F.lit(0))).first()[0]
    value = lambda sig, cnt: F.when(F.col(sig).isNotNull(), F.when(F.size(sig) == 0, F.lit(max(int(total), 1)).cast("long")).otherwise(F.greatest(F.coalesce(cnt, F.lit(0)), F.lit(1)).cast("long")))
    if rows_of(keyed, BROADCAST_SIGNATURES) <= BROADCAST_SIGNATURES:
        for sig, k in zip(signature_cols, k_cols):
            side = F.broadcast(keyed.select(F.col("_key").alias("_own"), "_cnt"))
            docs = docs.withColumn("_own", signature_key(F.col(sig))).join(side, "_own", "left").withColumn(k, value(sig, F.col("_cnt"))).drop("_own", "_cnt")
        return docs
    asked = F.array(*[F.when(F.size(sig) > 0, signature_key(F.col(sig))) for sig in signature_cols])
    slim = docs.select(by, F.explode(asked).alias("_key")).where("_key is not null").distinct()
    of = slim.join(keyed, "_key").groupBy(by).agg(F.map_from_entries(F.collect_list(F.struct("_key", "_cnt"))).alias("_found"))  # at most one for each column and row of `by`
    joined = docs.join(of, by, "left")
    for sig, k in zip(signature_cols, k_cols):
        joined = joined.withColumn(k, value(sig, F.try_element_at("_found", signature_key(F.col(sig)))))
    return joined.drop("_found")


def is_safe(k: Column, k_target: int = 5) -> Column:
    return k >= k_target


def facts_needed(rows: DataFrame, order: str = "rarest") -> DataFrame:
    """(doc_id, n_facts, needed): how many of a document's facts, told in order, single it out; null
    if all of them don't. rows: facts_by_document.

    order: "rarest" (by the number of documents with the fact, ties by type and value) or
    "document" (by first appearance). Documents whose facts begin alike share a node, and a node
    knows the documents that hold all of its facts, so documents are never paired with each other:
    at each step a document has a row for each node that it fits. A node with one document is done.
    There is a step for each fact of the documents that are still not single, and a count for each.
    """
    fact = F.md5(F.concat_ws("\x1f", "entity_type", "value"))
    per_fact = rows.groupBy("entity_type", "value").agg(F.count("*").alias("df"))
    ranked = rows.join(per_fact, ["entity_type", "value"])
    by = [F.col("df")] if order == "rarest" else [F.col("first")]
    own = Window.partitionBy("doc_id")
    ranked = ranked.withColumn("rk", F.row_number().over(own.orderBy(*by, "entity_type", "value"))).withColumn("n_facts", F.count("*").over(own))
    told = written(ranked.select("doc_id", fact.alias("f"), "rk", "n_facts"), "told")
    targets = told.where("rk = 1").select("doc_id", F.col("f").alias("node"), "n_facts")
    members = told.select("doc_id", F.col("f").alias("node")).join(targets.select("node").distinct(), "node", "left_semi")
    depth, out, old = 1, None, []
    while True:
        sizes = members.groupBy("node").agg(F.count("*").alias("size"))
        state = targets.join(sizes, "node")
        single, told_all = F.col("size") == 1, F.col("n_facts") == depth
        done = state.where(single | told_all).select("doc_id", "n_facts", F.when(single, F.lit(depth)).cast("long").alias("needed"))
        done = written(done, "done")
        out = done if out is None else out.unionByName(done)
        after = told.where(F.col("rk") == depth + 1).select("doc_id", "f")
        live = written(state.where(~single & ~told_all).select("doc_id", "node", "n_facts").join(after, "doc_id"), "live")
        if not rows_of(live, 0):
            drop(told, live, *old)
            return out
        deeper = F.md5(F.concat("node", "f")).alias("node")
        wanted = live.select("node", "f").distinct()
        members = written(members.join(told.select("doc_id", "f"), "doc_id").join(wanted, ["node", "f"], "left_semi").select("doc_id", deeper), "members")
        drop(*old)
        old = [live, members]
        targets = live.select("doc_id", deeper, "n_facts")
        depth += 1


def rarest_fact(rows: DataFrame) -> DataFrame:
    """(doc_id, entity_type, value, n_docs): each document's rarest fact and how many documents hold it."""
    per_fact = rows.groupBy("entity_type", "value").agg(F.count("*").alias("n_docs"))
    best = rows.join(per_fact, ["entity_type", "value"]).groupBy("doc_id").agg(F.min(F.struct("n_docs", "entity_type", "value")).alias("b"))
    return best.select("doc_id", "b.entity_type", "b.value", "b.n_docs")


def cumulative(needed: DataFrame, most: int = 10) -> DataFrame:
    """(n, n_docs, percent): documents singled out by n facts or fewer."""
    counts = [F.struct(F.lit(n).alias("n"), F.count_if(F.col("needed") <= n).alias("n_docs"), F.coalesce(F.try_divide(100.0 * F.count_if(F.col("needed") <= n), F.count("*")), F.lit(0.0)).alias("percent")) for n in range(1, most + 1)]
    return needed.agg(F.array(*counts).alias("c")).select(F.explode("c").alias("c")).select("c.*")


def first_reaching(cdf: DataFrame, percent: float) -> DataFrame:
    """The least n of a cumulative table that reaches a percentage."""
    return cdf.where(F.col("percent") >= percent).agg(F.min("n").alias("n"))


def needed_summary(needed: DataFrame) -> DataFrame:
    """(n_docs, never, median, most): never: not singled out by all facts; median: cut to an integer."""
    return needed.agg(
        F.count("*").alias("n_docs"),
        F.count_if(F.col("needed").isNull()).alias("never"),
        F.percentile("needed", F.lit(0.5)).cast("long").alias("median"),
        F.max("needed").alias("most"),
    )


def needed_histogram(needed: DataFrame) -> DataFrame:
    return needed.where("needed IS NOT NULL").groupBy("needed").agg(F.count("*").alias("n_docs"))
