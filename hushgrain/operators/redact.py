"""Redaction: Lite suppresses direct identifiers; Pro also generalises quasi-identifiers until a
document's fingerprint is shared widely enough. One output row for each document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushgrain.functions.generalise import MAX_LEVEL, generalise
from hushgrain.functions.text import apart, empty, sorted_by, splice, strip
from hushgrain.operators.pseudonym import pseudonyms
from hushgrain.operators.risk import k_for

_VAULT = "array<struct<token:string,original:string>>"


def _with_tokens(docs: DataFrame, pseudonymise: bool) -> DataFrame:
    """docs with `named`: the spans, DIRECT ones replaced; and `vault`."""
    if pseudonymise:
        docs = docs.withColumn("spans", apart(F.col("spans")))
        docs = docs.withColumn("p", pseudonyms(F.col("spans")))
        token = lambda s, i: F.coalesce(F.col("p.tokens")[i], F.concat(F.lit("["), s["entity_type"], F.lit("]")))
        vault = F.col("p.vault")
    else:
        token = lambda s, i: F.concat(F.lit("["), s["entity_type"], F.lit("]"))
        vault = empty(_VAULT)
    direct = lambda s, i: s.withField("replacement", token(s, i)).withField("generalization_level", F.lit(MAX_LEVEL))
    named = F.transform("spans", lambda s, i: F.when(s["identifier_role"] == "DIRECT", direct(s, i)).otherwise(s))
    return docs.withColumn("named", named).withColumn("vault", vault)


def lite(docs: DataFrame, pseudonymise: bool = False) -> DataFrame:
    """docs: doc_id, text, spans. Returns doc_id, redacted_text, spans, vault and the constant
    mosaic_risk_initial, mosaic_risk_final (null), iterations_used (0), converged (true). Narrow: it
    runs as well on a stream."""
    return _with_tokens(docs, pseudonymise).select(
        "doc_id",
        splice(F.coalesce("text", F.lit("")), F.col("named")).alias("redacted_text"),
        F.col("named").alias("spans"),
        "vault",
        F.lit(None).cast("long").alias("mosaic_risk_initial"),
        F.lit(None).cast("long").alias("mosaic_risk_final"),
        F.lit(0).alias("iterations_used"),
        F.lit(True).alias("converged"),
    )


def lite_audit(redacted: DataFrame, pseudonymise: bool = False) -> DataFrame:
    """One row for each decision: doc_id, seq, start, end, entity_type, original_text, action,
    rationale, iteration, replacement."""
    s = F.col("s")
    kind = s["entity_type"]
    # The sentences of the rationales, here and in pro_audit.
    how = (
        F.concat(F.lit("DIRECT identifier ("), kind, F.lit("); pseudonymised to "), s["replacement"], F.lit(" (vault keeps the original)."))
        if pseudonymise
        else F.concat(F.lit("DIRECT identifier ("), kind, F.lit("); always suppressed in Lite."))
    )
    left = F.concat(F.lit("QUASI identifier ("), kind, F.lit("); Lite does not touch quasi-identifiers. Run Pro for mosaic-aware redaction."))
    direct = s["identifier_role"] == "DIRECT"
    return redacted.select("doc_id", F.posexplode("spans").alias("seq", "s")).select(
        "doc_id", "seq", "s.start", "s.end", "s.entity_type", F.col("s.text").alias("original_text"),
        F.when(direct, "redact").otherwise("leave").alias("action"),
        F.when(direct, how).otherwise(left).alias("rationale"),
        F.lit(0).alias("iteration"), "s.replacement",
    )


def ladder(spans: Column) -> Column:
    """For each span its role, entity type and value at every level: evaluated once, used by all that
    follows."""
    values = lambda s: F.array(*[generalise(s["entity_type"], s["text"], level) for level in range(MAX_LEVEL + 1)])
    quasi = lambda s: s["identifier_role"] == "QUASI"
    return F.transform(spans, lambda s: F.struct(quasi(s).alias("quasi"), s["entity_type"].alias("entity_type"), F.when(quasi(s), values(s)).alias("values")))


def residual_signature(rungs: Column, level: int) -> Column:
    """The fingerprint of the QUASI spans of a ladder at a level: sorted distinct (entity_type, value);
    bracketed values are suppressed and don't count."""
    facts = F.transform(F.filter(rungs, lambda r: r["quasi"]), lambda r: F.struct(r["entity_type"].alias("entity_type"), F.get(r["values"], F.lit(level)).alias("value")))
    shown = F.filter(facts, lambda f: ~(f["value"].startswith("[") & f["value"].endswith("]")))
    return F.array_sort(F.array_distinct(F.transform(shown, lambda f: f.withField("value", F.lower(strip(f["value"]))))))


def pro(docs: DataFrame, haystack: DataFrame, k_target: int = 5, max_iterations: int = 5, pseudonymise: bool = False) -> DataFrame:
    """docs: doc_id, text, spans; haystack: (signature, cnt). The columns of lite, and k0..k3, level
    and `named_levels` for the audit. All four levels' fingerprints are computed at once and
    looked up in the haystack; texts are not shuffled while the haystack is small."""
    docs = _with_tokens(docs, pseudonymise).withColumn("rungs", ladder(F.col("spans")))
    for level in range(MAX_LEVEL + 1):
        docs = docs.withColumn(f"sig{level}", residual_signature(F.col("rungs"), level))
    docs = k_for(docs, haystack, [f"sig{level}" for level in range(MAX_LEVEL + 1)], [f"k{level}" for level in range(MAX_LEVEL + 1)])
    any_quasi = F.exists("spans", lambda s: s["identifier_role"] == "QUASI")
    most = max(max_iterations, 0)
    # The first level that is safe, among those that the loop reaches.
    reached = [level for level in range(1, MAX_LEVEL + 1) if level <= most]
    safe = F.lit(None).cast("int")
    for level in reversed(reached):
        safe = F.when(F.col(f"k{level}") >= k_target, F.lit(level)).otherwise(safe)
    docs = docs.withColumn("safe", F.when(F.col("k0") >= k_target, F.lit(0)).otherwise(safe))
    exhausted = MAX_LEVEL if most >= MAX_LEVEL else most + 1
    level = F.coalesce("safe", F.lit(MAX_LEVEL))
    docs = docs.withColumn("level", level).withColumn("iterations_used", F.coalesce("safe", F.lit(exhausted)))
    k_final = F.col(f"k{MAX_LEVEL}")
    for step in range(MAX_LEVEL):
        k_final = F.when(F.col("level") == step, F.col(f"k{step}")).otherwise(k_final)
    final = lambda i: F.get(F.get("rungs", i)["values"], F.col("level"))
    changed = lambda s, i: F.when((s["identifier_role"] == "QUASI") & (F.col("level") > 0), s.withField("replacement", final(i)).withField("generalization_level", F.col("level"))).otherwise(s)
    docs = docs.withColumn("done", F.transform("named", changed))
    return docs.select(
        "doc_id",
        splice(F.coalesce("text", F.lit("")), F.col("done")).alias("redacted_text"),
        F.col("done").alias("spans"),
        "vault",
        F.col("k0").alias("mosaic_risk_initial"),
        k_final.alias("mosaic_risk_final"),
        "iterations_used",
        (F.col("safe").isNotNull() & ~(any_quasi & (F.col("level") >= MAX_LEVEL))).alias("converged"),
        *[f"k{step}" for step in range(MAX_LEVEL + 1)],
        F.col("safe").isNull().alias("exhausted"),
    )


def pro_audit(redacted: DataFrame, k_target: int = 5, max_iterations: int = 5, pseudonymise: bool = False) -> DataFrame:
    """One row for each decision of pro, in order: the columns of lite_audit, and replacement_step,
    the replacement at that step (replacement is the final one)."""
    most = max(max_iterations, 0)
    s = F.col("s")
    kind = s["entity_type"]
    rows = redacted.select("*", F.posexplode("spans").alias("pos", "s"))
    suppressed = (
        F.concat(F.lit("DIRECT identifier ("), kind, F.lit("); pseudonymised to "), s["replacement"], F.lit(" (vault holds the original)."))
        if pseudonymise
        else F.concat(F.lit("DIRECT identifier ("), kind, F.lit("); always suppressed."))
    )

    def event(when: Column, phase: int, action: str, iteration, rationale: Column, step: Column) -> Column:
        made = F.struct(F.lit(phase).alias("phase"), F.lit(action).alias("action"), F.lit(iteration).alias("iteration"), rationale.alias("rationale"), step.alias("replacement_step"))
        return F.when(when, made)

    direct, quasi = s["identifier_role"] == "DIRECT", s["identifier_role"] == "QUASI"
    text = lambda x: x.cast("string")
    safe_at_once = F.col("k0") >= k_target
    events = [
        event(direct, 0, "redact", 0, suppressed, s["replacement"]),
        event(quasi & safe_at_once, 1, "leave", 0, F.concat(F.lit("QUASI identifier ("), kind, F.lit("); residual k="), text(F.col("k0")), F.lit(f" ≥ k_target={k_target}, no generalization needed.")), F.lit(None).cast("string")),
    ]
    for level in range(1, min(MAX_LEVEL, most) + 1):
        value = generalise(kind, s["text"], level)
        why = F.concat(F.lit(f"Generalized to level {level}: '"), s["text"], F.lit("' → '"), value, F.lit("'. Post-step k="), text(F.col(f"k{level}")), F.lit("."))
        events.append(event(quasi & ~safe_at_once & (F.col("iterations_used") >= level), 1 + level, "generalize", level, why, value))
    if most < MAX_LEVEL:
        why = F.concat(F.lit("Iterate loop exhausted (k="), text(F.col(f"k{most}")), F.lit(f" < k_target={k_target}); falling back to full suppression."))
        events.append(event(quasi & F.col("exhausted"), 2 + MAX_LEVEL, "generalize", most + 2, why, generalise(kind, s["text"], MAX_LEVEL)))
    told = rows.select("doc_id", "pos", "s", F.explode(F.array_compact(F.array(*events))).alias("e"))
    return told.select(
        "doc_id", "e.phase", "pos", "s.start", "s.end", "s.entity_type", F.col("s.text").alias("original_text"),
        "e.action", "e.rationale", "e.iteration", "e.replacement_step", "s.replacement",
    )


def by_iteration(audit: DataFrame) -> DataFrame:
    """(doc_id, iteration, entries): each document's audit entries in their order, by iteration."""
    order = ("phase", "pos") if "phase" in audit.columns else ("seq",)
    names = [c for c in audit.columns if c not in ("doc_id", "iteration", *order)]
    entries = audit.groupBy("doc_id", "iteration").agg(F.array_sort(F.collect_list(F.struct(*order, *names))).alias("e"))
    return entries.select("doc_id", "iteration", F.transform("e", lambda e: F.struct(*[e[n].alias(n) for n in names])).alias("entries"))


def first_per_action(audit: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n entries of each document's audit for each action."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("doc_id", "action").orderBy(*order)
    return audit.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= n)


def simple(docs: DataFrame) -> DataFrame:
    """Each span becomes its entity type, or its raw label if it has none, in brackets."""
    shown = F.transform(sorted_by(F.col("spans"), lambda s: s["start"]), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.concat(F.lit("["), F.coalesce(s["entity_type"], s["label"]), F.lit("]")).alias("replacement")))
    return docs.select("doc_id", splice(F.coalesce("text", F.lit("")), shown).alias("redacted_text"))
