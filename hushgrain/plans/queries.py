"""Queries over the test tables, one or more for each family of operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushgrain.functions import labels, tokens
from hushgrain.functions.generalise import generalise
from hushgrain.functions.normalise import normalise
from hushgrain.functions.text import apart, context
from hushgrain.operators import bio, coref, detect, ensemble, evaluate, pseudonym, redact, risk
from hushgrain.plans import wordfiles
from hushgrain.plans.casefiles import MODELS, annotated, as_spans, cases, predicted
from hushgrain.sources import writers


def _docs(spark: SparkSession, sf_dir: str, name: str = "documents", key: str = "doc_id", text: str = "text") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(F.col(key).alias("doc_id"), F.col(text).alias("text"))


def _found(docs: DataFrame) -> DataFrame:
    """Rows of a regex pass."""
    spans = docs.select("doc_id", F.explode(detect.regex_pass(F.col("text"))).alias("s"))
    return spans.select("doc_id", "s.start", "s.end", "s.entity_type", "s.text", F.lit("regex").alias("source"))


def detect_spans_documents(spark, sf_dir):
    return _found(_docs(spark, sf_dir))


def detect_spans_pages(spark, sf_dir):
    return _found(_docs(spark, sf_dir, "pages", "page_id", "html"))


def detect_spans_conversations(spark, sf_dir):
    """Turns share their conversation's id, so a turn is told by both."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.struct("conv_id", "turn").alias("doc_id"), "text")
    return _found(turns).select("doc_id.*", "start", "end", "entity_type", "text", "source")


def span_type_counts(spark, sf_dir):
    return _found(_docs(spark, sf_dir)).groupBy("entity_type").agg(F.count("*").alias("n_spans"), F.count_distinct("doc_id").alias("n_docs"))


def role_counts(spark, sf_dir):
    rows = annotated(spark, sf_dir).select(F.explode("entity_mentions").alias("m"))
    return rows.groupBy(F.col("m.entity_type").alias("entity_type"), labels.role(F.col("m.entity_type")).alias("role")).agg(F.count("*").alias("n"))


def redact_contacts(spark, sf_dir):
    """The flagship: recognisers, overlaps, roles and redaction of whole documents, in one narrow stage."""
    docs = detect.detect_spans(_docs(spark, sf_dir), use_coref=False)
    return redact.lite(docs).select("doc_id", F.size("spans").cast("long").alias("n_spans"), "redacted_text")


def rules_detect_counts(spark, sf_dir):
    """The whole of detection with the rule detector: rules, recognisers, coreference, overlaps, roles."""
    docs = detect.detect_spans(cases(spark, sf_dir).select("doc_id", "text"), detect.detector("rules"))
    rows = docs.select(F.explode("spans").alias("s"))
    return rows.groupBy(*[F.col(f"s.{c}").alias(c) for c in ("entity_type", "identifier_role", "source")]).agg(F.count("*").alias("n"))


def label_mapping(spark, sf_dir):
    names = sorted({*labels.ONTONOTES, *labels.CONLL, *labels.PRESIDIO, "UNKNOWN"})
    rows = spark.createDataFrame([(n,) for n in names], "label string")
    return rows.select("label", *[labels.lookup(F.col("label"), m).alias(c) for c, m in (("ontonotes", labels.ONTONOTES), ("conll", labels.CONLL), ("presidio", labels.PRESIDIO))])


def analyser_spans(spark, sf_dir):
    rows = cases(spark, sf_dir).select("doc_id", F.explode(detect.analyser()(F.col("text"))).alias("s"))
    return rows.select("doc_id", "s.*")


def simple_redact(spark, sf_dir):
    """Every span by its type, or by its raw label where the label means no type."""
    span = lambda g: F.struct(g["start"].alias("start"), g["end"].alias("end"), F.when(g["entity_type"] != "DEM", g["entity_type"]).alias("entity_type"), F.concat(F.lit("RAW_"), g["entity_type"]).alias("label"))
    docs = cases(spark, sf_dir).select("doc_id", "text", F.transform(evaluate.gold(F.col("entity_mentions")), span).alias("spans"))
    return redact.simple(docs)


def seeded_sample(spark, sf_dir):
    return evaluate.sample(_docs(spark, sf_dir).select("doc_id"), 20)


# Ladders


def _ladder(kind: str):
    def run(spark, sf_dir):
        rows = cases(spark, sf_dir).select(F.explode("entity_mentions").alias("m")).where(F.col("m.entity_type") == kind)
        text = F.col("m.span_text")
        counted = rows.groupBy(text.alias("text")).agg(F.count("*").alias("n"))
        return counted.select("text", "n", *[generalise(F.lit(kind), F.col("text"), level).alias(f"level{level}") for level in (1, 2, 3)])

    return run


def normalise_facts(spark, sf_dir):
    rows = annotated(spark, sf_dir).select(F.explode("entity_mentions").alias("m")).select("m.entity_type", "m.span_text").distinct()
    return rows.select("entity_type", "span_text", normalise(F.col("entity_type"), F.col("span_text")).alias("value"))


def token_letters(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("k"))
    return rows.select("k", tokens.letters(F.col("k")).alias("letters"))


def bare_names(spark, sf_dir):
    rows = cases(spark, sf_dir).select(F.explode("entity_mentions").alias("m")).where("m.entity_type = 'PERSON'").select("m.span_text").distinct()
    return rows.select("span_text", tokens.without_honorifics(F.col("span_text")).alias("bare"))


# Risk


def _facts(spark, sf_dir, normalised=False):
    return risk.facts_by_document(risk.facts(annotated(spark, sf_dir), normalised=normalised))


def signatures(spark, sf_dir):
    return risk.signatures(_facts(spark, sf_dir)).select("doc_id", risk.signature_text(F.col("signature")).alias("signature"), F.size("signature").cast("long").alias("n_facts"))


def k_anonymity(spark, sf_dir):
    coarse = ("DEM", "LOC")
    table = risk.k_anonymity(risk.facts_by_document(risk.facts(annotated(spark, sf_dir), coarse)), 2)
    return table.select("doc_id", risk.signature_text(F.col("signature")).alias("signature"), "n_facts", "k")


def k_distribution(spark, sf_dir):
    return risk.k_distribution(risk.k_anonymity(risk.facts_by_document(risk.facts(annotated(spark, sf_dir), ("DEM", "LOC"))), 2))


def haystack_k(spark, sf_dir):
    """How often each document's fingerprint stands in the haystack of the other annotator."""
    docs = annotated(spark, sf_dir)
    own = docs.where("annotator_id = '1'").select("doc_id", redact.residual_signature(redact.ladder(as_spans(F.col("entity_mentions"))), 0).alias("sig"))
    found = risk.k_for(own, risk.haystack(docs.where("annotator_id = '2'")), ["sig"], ["k"])
    return found.select("doc_id", "k", risk.is_safe(F.col("k"), 2).alias("safe"))


def min_facts_smart(spark, sf_dir):
    return risk.facts_needed(_facts(spark, sf_dir, True))


def min_facts_doc_order(spark, sf_dir):
    return risk.facts_needed(_facts(spark, sf_dir, True), "document")


def reid_cdf(spark, sf_dir):
    return risk.cumulative(min_facts_smart(spark, sf_dir), 6)


def reid_threshold(spark, sf_dir):
    return risk.first_reaching(reid_cdf(spark, sf_dir), 50.0)


def reid_summary(spark, sf_dir):
    return risk.needed_summary(min_facts_smart(spark, sf_dir))


def reid_histogram(spark, sf_dir):
    return risk.needed_histogram(min_facts_smart(spark, sf_dir))


def rarest_fact(spark, sf_dir):
    return risk.rarest_fact(_facts(spark, sf_dir, True))


# Redaction


def _with_spans(spark, sf_dir):
    return cases(spark, sf_dir).select("k", "doc_id", "text", as_spans(F.col("entity_mentions")).alias("spans"))


def lite_redact(spark, sf_dir):
    return redact.lite(_with_spans(spark, sf_dir)).select("doc_id", "redacted_text", "iterations_used", "converged")


def lite_audit(spark, sf_dir):
    return redact.lite_audit(redact.lite(_with_spans(spark, sf_dir))).select("doc_id", "seq", "action", "rationale", "replacement")


def audit_first(spark, sf_dir):
    audit = redact.lite_audit(redact.lite(_with_spans(spark, sf_dir)))
    return redact.first_per_action(audit, 2, "seq").select("doc_id", "action", "nth", "original_text")


K_TARGET = 5


def _haystack(docs: DataFrame) -> DataFrame:
    """Fingerprints in which every other document is hidden at level 1, and the rest at level 2."""
    level = lambda n: redact.residual_signature(F.col("rungs"), n)
    rows = docs.withColumn("rungs", redact.ladder(F.col("spans"))).select(F.when(F.col("k") % 2 == 0, level(1)).otherwise(level(2)).alias("signature"))
    return risk.seeded(rows, "signature", 3)


def _pro(spark, sf_dir, most):
    docs = _with_spans(spark, sf_dir)
    return redact.pro(docs, _haystack(docs), K_TARGET, most)


def pro_redact(spark, sf_dir):
    return _pro(spark, sf_dir, 5).select("doc_id", "redacted_text", "mosaic_risk_initial", "mosaic_risk_final", "iterations_used", "converged")


def html_articles(spark, sf_dir):
    return _pro(spark, sf_dir, 1).select("doc_id", writers.as_html().alias("html"))


def pro_redact_short(spark, sf_dir):
    return _pro(spark, sf_dir, 1).select("doc_id", "redacted_text", "mosaic_risk_initial", "mosaic_risk_final", "iterations_used", "converged")


def pro_risk_summary(spark, sf_dir):
    return _pro(spark, sf_dir, 5).groupBy("iterations_used", "converged").agg(F.count("*").alias("n_docs"), F.min("mosaic_risk_final").alias("least_k"))


def pro_audit_counts(spark, sf_dir):
    return redact.pro_audit(_pro(spark, sf_dir, 1), K_TARGET, 1).groupBy("action", "iteration").agg(F.count("*").alias("n"))


def pro_audit(spark, sf_dir):
    """Every decision with its reason."""
    return redact.pro_audit(_pro(spark, sf_dir, 1), K_TARGET, 1).select("doc_id", "start", "action", "iteration", "rationale", "replacement_step", "replacement")


def audit_by_iteration(spark, sf_dir):
    grouped = redact.by_iteration(redact.pro_audit(_pro(spark, sf_dir, 1), K_TARGET, 1))
    return grouped.select("doc_id", "iteration", F.size("entries").cast("long").alias("n"), F.array_join(F.transform("entries", lambda e: e["entity_type"]), ",").alias("kinds"))


def context_windows(spark, sf_dir):
    rows = cases(spark, sf_dir).select("doc_id", "text", F.posexplode("entity_mentions").alias("idx", "m"))
    return rows.select("doc_id", "idx", context(F.col("text"), F.col("m.start_offset"), F.col("m.end_offset"), 40).alias("context"))


def distinct_direct(spark, sf_dir):
    return evaluate.distinct_direct(_with_spans(spark, sf_dir))


# Pseudonyms


def _pseudonymised(spark, sf_dir):
    return redact.lite(_with_spans(spark, sf_dir), pseudonymise=True)


def pseudonymise(spark, sf_dir):
    return _pseudonymised(spark, sf_dir).select("doc_id", "redacted_text")


def vault_entries(spark, sf_dir):
    return pseudonym.vault_table(_pseudonymised(spark, sf_dir))


def restore_text(spark, sf_dir):
    docs = _pseudonymised(spark, sf_dir)
    vault = F.map_from_entries(F.transform("vault", lambda v: F.struct(v["token"], v["original"])))
    return docs.select("doc_id", tokens.restore(F.col("redacted_text"), vault).alias("restored"))


def slot_round_trip(spark, sf_dir):
    """An answer made of the document's tokens, and restored."""
    named = F.filter("spans", lambda s: s["entity_type"].isin("PERSON", "ORG"))
    docs = _with_spans(spark, sf_dir).select("doc_id", F.transform(named, lambda s: F.struct(s["text"], s["entity_type"])).alias("names"))
    rows = _pseudonymised(spark, sf_dir).select("doc_id", "vault").join(docs, "doc_id")
    answer = pseudonym.filled(F.lit("{PERSON_A} sued {ORG_A}; see {ORG_B}."), pseudonym.slots(F.col("names"), F.col("vault")))
    vault = F.map_from_entries(F.transform("vault", lambda v: F.struct(v["token"], v["original"])))
    rows = rows.select("doc_id", answer.alias("answer"), vault.alias("vault"))
    return rows.select("doc_id", "answer", tokens.restore(F.col("answer"), F.col("vault")).alias("restored"))


def coref_spans(spark, sf_dir):
    """Mentions that short forms add to each case's full names."""
    full = F.filter(as_spans(F.col("entity_mentions")), lambda s: s["entity_type"].isin("PERSON", "ORG") & ~s["text"].startswith("Mrs ") & s["text"].contains(" "))
    rows = cases(spark, sf_dir).select("doc_id", F.explode(coref.extend(F.col("text"), full)).alias("s")).where("s.source = 'coref'")
    return rows.select("doc_id", "s.start", "s.end", "s.entity_type", "s.text", "s.confidence")


# Token labels


def bio_encode(spark, sf_dir):
    docs = cases(spark, sf_dir).select("doc_id", bio.words(F.col("text")).alias("t"), evaluate.gold(F.col("entity_mentions")).alias("g"))
    rows = docs.select("doc_id", "t", F.posexplode(bio.encode(F.col("t"), F.col("g"))).alias("pos", "id"))
    return rows.groupBy("id").agg(F.count("*").alias("n"))


def bio_decode(spark, sf_dir):
    docs = cases(spark, sf_dir).select("doc_id", "text", bio.words(F.col("text")).alias("t"), evaluate.gold(F.col("entity_mentions")).alias("g"))
    labelled = docs.withColumn("t", F.zip_with("t", bio.encode(F.col("t"), F.col("g")), lambda t, i: F.struct(t["start"].alias("start"), t["end"].alias("end"), i.alias("label_id"))))
    rows = labelled.select("doc_id", F.explode(bio.decode(F.col("text"), F.col("t"))).alias("s"))
    return rows.select("doc_id", "s.start", "s.end", "s.entity_type", "s.text")


def token_scores(spark, sf_dir):
    """Scores of a labeller that misses every ninth word or so."""
    docs = cases(spark, sf_dir).select("k", bio.words(F.col("text")).alias("t"), evaluate.gold(F.col("entity_mentions")).alias("g"))
    docs = docs.select("k", bio.encode(F.col("t"), F.col("g")).alias("golden"))
    missing = F.transform("golden", lambda x, i: F.when((F.col("k") + i + 1) % 9 == 0, 0).otherwise(x))
    return _rounded(bio.token_scores(docs.withColumn("said", missing), "said", "golden"))


def token_windows(spark, sf_dir):
    docs = _docs(spark, sf_dir).select("doc_id", F.filter(F.split("text", " "), lambda x: x != "").alias("t"))
    return bio.windows(docs, "t", 512, 64).select("doc_id", "window", "first", F.size("tokens").alias("n_tokens"))


# Evaluation


def _scored(spark, sf_dir):
    return predicted(spark, sf_dir).select("doc_id", "model", "entity_mentions", "gold", F.col("spans").alias("predicted"))


def _rounded(table: DataFrame) -> DataFrame:
    return table.select(*[F.round(c, 9).alias(c) if c in ("precision", "recall", "f1", "macro_recall", "micro_recall", "behind") else c for c in table.columns])


def eval_exact(spark, sf_dir):
    return _rounded(evaluate.results(_scored(spark, sf_dir), "model", modes=("exact",)))


def eval_partial(spark, sf_dir):
    return _rounded(evaluate.results(_scored(spark, sf_dir), "model", modes=("partial",)))


def mention_recall(spark, sf_dir):
    return _rounded(evaluate.recall_summary(evaluate.entity_recall(_scored(spark, sf_dir), "model"), "model"))


def mention_recall_by_type(spark, sf_dir):
    return _rounded(evaluate.recall_summary(evaluate.entity_recall(_scored(spark, sf_dir), "model"), "model", "entity_type"))


def mention_recall_coref(spark, sf_dir):
    """Recall of the rule detector without and with the coreference scan."""
    docs = cases(spark, sf_dir).select("doc_id", "text", "entity_mentions")
    out = None
    for name, on in (("baseline", False), ("coref", True)):
        found = detect.detect_spans(docs, detect.detector("rules"), use_coref=on)
        slim = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["entity_type"].alias("entity_type")))
        part = evaluate.recall_summary(evaluate.entity_recall(found.withColumn("predicted", slim)), F.lit(name).alias("label"))
        out = part if out is None else out.unionByName(part)
    return _rounded(out)


def missed_spans(spark, sf_dir):
    missed, _ = evaluate.unmatched(_scored(spark, sf_dir), "model")
    return missed.groupBy("model", "entity_type").agg(F.count("*").alias("n"))


def false_alarms(spark, sf_dir):
    _, false = evaluate.unmatched(_scored(spark, sf_dir), "model")
    return false.groupBy("model", "entity_type").agg(F.count("*").alias("n"))


def f1_pivot(spark, sf_dir):
    table = evaluate.f1_pivot(evaluate.results(_scored(spark, sf_dir), "model", modes=("exact",)), list(MODELS), "exact")
    return table.select("entity_type", *[F.round(m, 9).alias(m) for m in MODELS])


def routing_table(spark, sf_dir):
    return evaluate.routing(evaluate.results(_scored(spark, sf_dir), "model", modes=("exact",)), list(MODELS), "exact")


def _spans(spark, sf_dir):
    return ensemble.exploded(predicted(spark, sf_dir).select("doc_id", "model", "spans"))


def _shown(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "start", "end", "entity_type", "text")


def ensemble_union(spark, sf_dir):
    return _shown(ensemble.vote(_spans(spark, sf_dir), list(MODELS), 1))


def ensemble_consensus(spark, sf_dir):
    return _shown(ensemble.vote(_spans(spark, sf_dir), list(MODELS), 2, "shortest"))


def vote_sweep(spark, sf_dir):
    return ensemble.sweep(_spans(spark, sf_dir), list(MODELS)).groupBy("min_votes", "entity_type").agg(F.count("*").alias("n"))


def routed_spans(spark, sf_dir):
    return _shown(ensemble.routed(_spans(spark, sf_dir), routing_table(spark, sf_dir)))


def combiner_comparison(spark, sf_dir):
    """Each model alone, votes and routing, scored in one pass."""
    spans = _spans(spark, sf_dir)
    alone = spans.select(F.concat("model", F.lit("_alone")).alias("strategy"), "doc_id", "start", "end", "entity_type", "text")
    votes = ensemble.sweep(spans, list(MODELS)).select(F.concat(F.lit("min"), F.col("min_votes").cast("string")).alias("strategy"), "doc_id", "start", "end", "entity_type", "text")
    route = ensemble.routed(spans, routing_table(spark, sf_dir)).select(F.lit("routed").alias("strategy"), "doc_id", "start", "end", "entity_type", "text")
    said = ensemble.collected(alone.unionByName(votes).unionByName(route), "strategy")
    names = [f"{m}_alone" for m in MODELS] + [f"min{n}" for n in (1, 2, 3)] + ["routed"]
    golden = cases(spark, sf_dir).select("doc_id", evaluate.gold(F.col("entity_mentions")).alias("gold"), F.explode(F.array(*map(F.lit, names))).alias("strategy"))
    scored = golden.join(said, ["strategy", "doc_id"], "left")
    return _rounded(evaluate.results(scored, "strategy").where("entity_type = '_ALL'")).drop("entity_type")


def best_strategy(spark, sf_dir):
    return _rounded(evaluate.best_strategy(evaluate.results(_scored(spark, sf_dir).withColumnRenamed("model", "strategy"), "strategy", modes=("exact",)), "exact"))


# Summaries


def dataset_summary(spark, sf_dir):
    return evaluate.dataset_summary(annotated(spark, sf_dir))


def annotator_disagreement(spark, sf_dir):
    return evaluate.disagreement(annotated(spark, sf_dir)).select("n_entities", "n_disagreed", F.round("rate", 9).alias("rate"))


def top_documents(spark, sf_dir):
    return evaluate.top_documents(annotated(spark, sf_dir).where("annotator_id = '2'"), 10)


def third_document(spark, sf_dir):
    return evaluate.nth_document(annotated(spark, sf_dir).where("annotator_id = '2'"), 3)


def examples_by_role(spark, sf_dir):
    return evaluate.examples(annotated(spark, sf_dir), 3)


# The same operators over whole texts of `documents`


def _word_scored(spark, sf_dir):
    return wordfiles.predicted(spark, sf_dir).select("doc_id", "model", "gold", F.col("spans").alias("predicted"))


def words_eval_exact(spark, sf_dir):
    return _rounded(evaluate.results(_word_scored(spark, sf_dir), "model", modes=("exact",)))


def words_missed(spark, sf_dir):
    missed, _ = evaluate.unmatched(_word_scored(spark, sf_dir), "model")
    return missed.groupBy("model", "entity_type").agg(F.count("*").alias("n"))


def words_ensemble_union(spark, sf_dir):
    """Votes of overlapping groups, summed up by document."""
    cache = wordfiles.predicted(spark, sf_dir).select("doc_id", "model", "spans")
    kept = ensemble.vote(ensemble.exploded(cache), list(wordfiles.MODELS), 1)
    return kept.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.col("start").cast("long") * 3 + F.col("end")).alias("places"), F.sum(F.length("text").cast("long")).alias("length"))


def words_redact(spark, sf_dir):
    """Every gold span suppressed by its role, in texts of up to 20,000 words."""
    docs = wordfiles.gold(wordfiles.word_docs(spark, sf_dir))
    spans = F.transform(detect.as_pipeline(F.col("gold"), "manual"), lambda s: s.withField("identifier_role", labels.role(s["entity_type"])))
    done = redact.lite(docs.select("doc_id", "text", apart(spans).alias("spans")))
    return done.select("doc_id", F.length("redacted_text").cast("long").alias("n_chars"), F.md5("redacted_text").alias("md5"))


def words_bio_decode(spark, sf_dir):
    """Encoded and decoded again: the spans that the labels hold, by document."""
    docs = wordfiles.gold(wordfiles.word_docs(spark, sf_dir)).select("doc_id", "text", "gold", bio.words(F.col("text")).alias("t"))
    docs = docs.withColumn("t", F.zip_with("t", bio.encode(F.col("t"), F.col("gold")), lambda t, i: F.struct(t["start"].alias("start"), t["end"].alias("end"), i.alias("label_id"))))
    rows = docs.select("doc_id", F.explode(bio.decode(F.col("text"), F.col("t"))).alias("s"))
    return rows.groupBy("doc_id", "s.entity_type").agg(F.count("*").alias("n"), F.sum(F.col("s.start").cast("long")).alias("starts"), F.sum(F.col("s.end").cast("long")).alias("ends"))


_FUNCTIONS = (
    detect_spans_documents, detect_spans_pages, detect_spans_conversations, span_type_counts, role_counts, redact_contacts,
    rules_detect_counts, analyser_spans, simple_redact, seeded_sample, mention_recall_coref, label_mapping, normalise_facts, token_letters, bare_names, signatures, k_anonymity, k_distribution,
    haystack_k, min_facts_smart, min_facts_doc_order, reid_cdf, reid_threshold, reid_summary, reid_histogram, rarest_fact,
    lite_redact, lite_audit, audit_first, pro_redact, html_articles, pro_redact_short, pro_risk_summary, pro_audit_counts, pro_audit, audit_by_iteration, context_windows,
    distinct_direct, pseudonymise, vault_entries, restore_text, slot_round_trip, coref_spans, bio_encode, bio_decode, token_scores, token_windows, eval_exact,
    eval_partial, mention_recall, mention_recall_by_type, missed_spans, false_alarms, f1_pivot, routing_table, ensemble_union,
    ensemble_consensus, vote_sweep, routed_spans, combiner_comparison, best_strategy, dataset_summary, annotator_disagreement,
    top_documents, third_document, examples_by_role, words_eval_exact, words_missed, words_ensemble_union, words_redact,
    words_bio_decode,
)
QUERIES = {f.__name__: f for f in _FUNCTIONS} | {
    "generalise_dates": _ladder("DATETIME"),
    "generalise_quantities": _ladder("QUANTITY"),
    "generalise_locations": _ladder("LOC"),
    "generalise_demographics": _ladder("DEM"),
}
