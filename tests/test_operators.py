"""Operators on small documents."""

import json
import random
from itertools import pairwise

import pytest
from pyspark.sql import functions as F

from hushgrain import cli
from hushgrain.operators import bio, coref, detect, ensemble, evaluate, pseudonym, redact, risk
from hushgrain.schema import ANNOTATED, CACHE, MENTION, PREDICTED, SPANS
from hushgrain.sources import readers, writers
from hushgrain.streaming.redact import redacted_stream, write_redacted


def docs_of(spark, *texts):
    return spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(texts)], "doc_id string, text string")


SLIM = f"doc_id string, entity_mentions array<{MENTION}>"


def spans_of(spark, text, found):
    """A document with given spans (needle, type), by their first occurrence."""
    rows = [(text.index(n), text.index(n) + len(n), k, n) for n, k in found]
    docs = spark.createDataFrame([("d", text, rows)], f"doc_id string, text string, p array<{PREDICTED}>")
    return docs.select("doc_id", "text", detect.with_roles(detect.as_pipeline(F.col("p"), "manual")).alias("spans"))


def test_recognisers(spark):
    texts = [
        "Application no. 12345/67 and App. No 1/2010; Case No.7/99",
        "NHS 943 476 5919 or 943-476-5919",
        "IBAN GB82 WEST 1234 5698 7654 32 here",
        "Mail tomás.x+y@mail-1.example.co.uk now",
        "Call +44 20 7946 0958 or (020) 7946 0958, HR-2021-0847",
        "",
        None,
        "nothing",
    ]
    got = [[(s.text, s.entity_type) for s in r[0]] for r in docs_of(spark, *texts).orderBy("doc_id").select(detect.regex_pass(F.coalesce("text", F.lit("")))).collect()]
    assert got[0] == [("Application no. 12345/67", "CODE"), ("App. No 1/2010", "CODE"), ("Case No.7/99", "CODE")]
    assert got[1] == [("943 476 5919", "CODE"), ("943-476-5919", "CODE")]
    assert got[2] == [("GB82 WEST 1234 5698 7654 32", "CODE")]
    assert got[3] == [("tomás.x+y@mail-1.example.co.uk", "MISC")]
    assert ("2021-0847", "MISC") in got[4]
    assert got[5:] == [[], [], []]


def test_merge_and_dedupe(spark):
    row = "struct({} AS start, {} AS end, 'X' AS entity_type, '' AS text, 'DIRECT' AS identifier_role, '{}' AS source, 1.0D AS confidence, 0 AS generalization_level, CAST(NULL AS STRING) AS replacement)"
    make = lambda *xs: F.expr("array(" + ", ".join(row.format(*x) for x in xs) + ")").cast(SPANS)
    one = spark.range(1)
    merged = one.select(detect.merge(make((0, 20, "ner"), (30, 35, "ner")), make((5, 8, "regex")))).first()[0]
    assert [(s.start, s.end, s.source) for s in merged] == [(5, 8, "regex"), (30, 35, "ner")]
    kept = one.select(detect.dedupe(make((3, 9, "coref"), (0, 4, "coref"), (10, 12, "ner"), (10, 12, "regex"), (10, 15, "coref"), (15, 16, "ner")))).first()[0]
    assert [(s.start, s.end, s.source) for s in kept] == [(0, 4, "coref"), (10, 15, "coref"), (15, 16, "ner")]


def test_short_forms():
    assert coref.short_forms("Northwind Energy Ltd", "ORG") == ["Northwind Energy", "Northwind"]
    assert coref.short_forms("Acme Holdings Ltd", "ORG") == ["Acme"]
    assert coref.short_forms("the European Commission", "ORG") == ["European"]
    forms = coref.short_forms("Mrs Maria Petrova", "PERSON")
    assert forms[0] == "Miss. Petrova" and {"Maria", "Petrova", "Mrs Petrova", "Dr. Petrova"} <= set(forms) and len(forms) == 12
    assert all(len(a) >= len(b) for a, b in pairwise(forms))
    assert coref.short_forms("Petrova", "PERSON") == coref.short_forms("Ann Lee", "LOC") == []


def test_coref_finds_and_skips(spark):
    text = "Maria Petrova sued. Mrs Petrova won; Petrovas lost. Maria left."
    docs = spans_of(spark, text, [("Maria Petrova", "PERSON")])
    got = docs.select(coref.extend(F.col("text"), F.col("spans"))).first()[0]
    assert [(s.text, s.source) for s in got] == [("Maria Petrova", "manual"), ("Mrs Petrova", "coref"), ("Maria", "coref")]
    assert {s.confidence for s in got[1:]} == {0.7}


def test_lite_end_to_end(spark):
    text = "The applicant, Mrs Elena Markova, is a 47-year-old Bulgarian national living in Plovdiv. On 12 March 2018 she filed a complaint (Application no. 1234/18). Markova appealed."
    found = detect.detect_spans(docs_of(spark, text, "", None), detect.detector("missing", "rules"))
    done = {r.doc_id: r for r in redact.lite(found).collect()}
    assert done["d0"].redacted_text == "The applicant, [PERSON], is a 47-year-old Bulgarian national living in Plovdiv. On 12 March 2018 she filed a complaint ([CODE]). [PERSON] appealed."
    assert done["d1"].redacted_text == done["d2"].redacted_text == ""
    with pytest.raises(KeyError):
        detect.detector("missing")


def haystack(spark, *rows):
    return spark.createDataFrame([(list(map(tuple, s)), c) for s, c in rows], "signature array<struct<entity_type:string,value:string>>, cnt long")


TEXT = "Ann Lee, a 47-year-old from Plovdiv, spoke."
FOUND = [("Ann Lee", "PERSON"), ("47-year-old", "QUANTITY"), ("Plovdiv", "LOC")]
RAW = (("LOC", "plovdiv"), ("QUANTITY", "47-year-old"))
ONE = (("LOC", "bulgaria"), ("QUANTITY", "about 40"))
TWO = (("LOC", "europe"), ("QUANTITY", "in their 40s"))


@pytest.mark.parametrize(
    "hay,most,want",
    [
        ([(RAW, 9)], 5, (9, 9, 0, True, "[PERSON], a 47-year-old from Plovdiv, spoke.", {("redact", 0): 1, ("leave", 0): 2})),
        ([(ONE, 6)], 5, (1, 6, 1, True, "[PERSON], a about 40 from Bulgaria, spoke.", {("redact", 0): 1, ("generalize", 1): 2})),
        ([(TWO, 6)], 5, (1, 6, 2, True, "[PERSON], a in their 40s from Europe, spoke.", {("redact", 0): 1, ("generalize", 1): 2, ("generalize", 2): 2})),
        ([(ONE, 2), (TWO, 5 - 1)], 5, (1, 6, 3, False, "[PERSON], a [QUANTITY] from [LOC], spoke.", {("redact", 0): 1, ("generalize", 1): 2, ("generalize", 2): 2, ("generalize", 3): 2})),
        ([(ONE, 2)], 5, (1, 2, 3, False, "[PERSON], a [QUANTITY] from [LOC], spoke.", {("redact", 0): 1, ("generalize", 1): 2, ("generalize", 2): 2, ("generalize", 3): 2})),
        ([(TWO, 6)], 1, (1, 6, 2, False, "[PERSON], a [QUANTITY] from [LOC], spoke.", {("redact", 0): 1, ("generalize", 1): 2, ("generalize", 3): 2})),
        ([], 0, (1, 1, 1, False, "[PERSON], a [QUANTITY] from [LOC], spoke.", {("redact", 0): 1, ("generalize", 2): 2})),
    ],
)
def test_pro_truth_table(spark, hay, most, want):
    done = redact.pro(spans_of(spark, TEXT, FOUND), haystack(spark, *hay), 5, most)
    r = done.first()
    assert (r.mosaic_risk_initial, r.mosaic_risk_final, r.iterations_used, r.converged, r.redacted_text) == want[:5]
    audit = redact.pro_audit(done, 5, most).groupBy("action", "iteration").count().collect()
    assert {(a.action, a.iteration): a["count"] for a in audit} == want[5]


def test_pro_without_quasi_spans(spark):
    r = redact.pro(spans_of(spark, TEXT, FOUND[:1]), haystack(spark), 5, 5).first()
    assert (r.mosaic_risk_final, r.iterations_used, r.converged) == (1, 3, False)
    r = redact.pro(spans_of(spark, TEXT, FOUND[:1]), haystack(spark, (RAW, 7)), 5, 5).first()
    assert (r.mosaic_risk_final, r.iterations_used, r.converged) == (7, 0, True)


def test_k_for(spark, monkeypatch):
    hay = haystack(spark, (RAW, 2), (ONE, 1))
    docs = spark.createDataFrame([(0, list(RAW)), (1, list(ONE)), (2, list(TWO)), (3, []), (4, None)], "i int, s array<struct<entity_type:string,value:string>>")
    for most in (200_000, 0):  # broadcast, and one shuffled join
        monkeypatch.setattr(risk, "BROADCAST_SIGNATURES", most)
        for h, want in ((hay, [2, 1, 1, 3, None]), (haystack(spark), [1, 1, 1, 1, None])):
            found = risk.k_for(docs.withColumn("t", F.col("s")), h, ["s", "t"], ["k", "k2"], by="i").orderBy("i").collect()
            assert [r.k for r in found] == want == [r.k2 for r in found]


def test_pseudonyms():
    p = pseudonym.Pseudonyms()
    assert p.token("PERSON", "Mrs Petrova") == p.token("PERSON", "Maria Petrova") == p.token("PERSON", "Maria") == "[PERSON_A]"
    assert p.token("PERSON", "John Doe") == "[PERSON_B]" and p.token("ORG", "Maria") == "[ORG_A]"
    assert p.vault == {"[PERSON_A]": "Maria Petrova", "[PERSON_B]": "John Doe", "[ORG_A]": "Maria"}
    with pytest.raises(ValueError):
        p.token("PERSON", " ")


def test_pseudonymise_and_restore(spark, tmp_path):
    text = "Maria Petrova met John Smith. Mrs Petrova left."
    docs = spans_of(spark, text, [("Maria Petrova", "PERSON"), ("John Smith", "PERSON"), ("Mrs Petrova", "PERSON")])
    done = redact.lite(docs, pseudonymise=True)
    assert done.first().redacted_text == "[PERSON_A] met [PERSON_B]. [PERSON_A] left."
    writers.vaults(done, f"{tmp_path}/vault")
    vault = pseudonym.vault_map(spark.read.parquet(f"{tmp_path}/vault"))
    assert vault.first().vault == {"[PERSON_A]": "Maria Petrova", "[PERSON_B]": "John Smith"}
    out = json.loads(done.select(writers.as_json()).first()[0])
    assert out["pseudonym_vault"]["[PERSON_B]"] == "John Smith" and out["mosaic_risk_initial"] is None and "confidence" not in out["spans"][0]


def mention(start, end, kind, role="QUASI", text="x", entity="e"):
    return (start, end, kind, text, role, entity)


def scored(spark, predicted, golden):
    rows = [("d", [(a, b, k, "") for a, b, k in predicted], [(a, b, k, "") for a, b, k in golden])]
    return spark.createDataFrame(rows, f"doc_id string, predicted array<{PREDICTED}>, gold array<{PREDICTED}>")


def totals(frame, mode):
    r = next(x for x in evaluate.results(frame, modes=(mode,)).collect() if x.entity_type == "_ALL")
    return r.tp, r.fp, r.fn


def test_matching(spark):
    both = [(0, 4, "PERSON"), (10, 14, "ORG")]
    assert totals(scored(spark, both, both), "exact") == (2, 0, 0)
    assert totals(scored(spark, [(0, 4, "ORG")], [(0, 4, "PERSON")]), "partial") == (0, 1, 1)
    assert totals(scored(spark, [(0, 5, "ORG")], [(0, 4, "ORG")]), "partial") == (1, 0, 0)
    assert totals(scored(spark, [(0, 5, "ORG")], [(0, 4, "ORG")]), "exact") == (0, 1, 1)
    assert totals(scored(spark, [(0, 9, "ORG"), (0, 4, "ORG")], [(0, 4, "ORG"), (5, 9, "ORG")]), "partial") == (1, 1, 1)
    assert totals(scored(spark, [(0, 4, "NEW")], []), "partial") == (0, 0, 0)
    rows = evaluate.results(scored(spark, [], [])).collect()
    assert len(rows) == 18 and {r.f1 for r in rows} == {0.0}


def test_matching_conserves_counts(spark):
    rng = random.Random(2)
    span = lambda: (a := rng.randrange(40), a + rng.randrange(1, 8), rng.choice(["ORG", "LOC"]))
    rows = [(f"d{i}", [(*span(), "") for _ in range(rng.randrange(8))], [(*span(), "") for _ in range(rng.randrange(8))]) for i in range(60)]

    def greedy(pred, gold, fits):
        free, tp = list(gold), 0
        for p in pred:
            if (g := next((g for g in free if g[2] == p[2] and fits(p, g)), None)) is not None:
                free.remove(g)
                tp += 1
        return tp, len(pred) - tp, len(gold) - tp

    frame = spark.createDataFrame(rows, f"doc_id string, predicted array<{PREDICTED}>, gold array<{PREDICTED}>")
    for mode, fits in (("partial", lambda a, b: a[0] < b[1] and a[1] > b[0]), ("exact", lambda a, b: a[:2] == b[:2])):
        assert totals(frame, mode) == tuple(map(sum, zip(*(greedy(p, g, fits) for _, p, g in rows))))


def test_greedy_takes_the_first_free_span():
    rng = random.Random(9)
    for _ in range(3000):
        spans = lambda n: [(a := rng.randrange(12), a + rng.randrange(0, 5), rng.choice("xy")) for _ in range(n)]
        p, g = spans(rng.randrange(6)), spans(rng.randrange(6))
        for exact in (True, False):
            free, want = list(range(len(g))), []
            for a, z, k in p:
                hit = next((i for i in free if g[i][2] == k and (g[i][:2] == (a, z) if exact else g[i][0] < z and g[i][1] > a)), -1)
                want.append(hit)
                free = [i for i in free if i != hit]
            columns = lambda x: [list(c) for c in zip(*x)] or [[], [], []]
            assert evaluate.greedy(*columns(p), *columns(g), exact) == want


def test_gold_leaves_out_unmasked(spark):
    docs = spark.createDataFrame([("d", "1", "train", "t", [mention(0, 1, "LOC"), mention(2, 3, "ORG", "NO_MASK"), mention(4, 5, "CODE", "DIRECT")])], ANNOTATED)
    assert [s.entity_type for s in docs.select(evaluate.gold(F.col("entity_mentions"))).first()[0]] == ["LOC", "CODE"]


def votes(spark, rows, models, n, tie="longest"):
    frame = spark.createDataFrame([("d", m, i, a, b, k, t) for i, (m, a, b, k, t) in enumerate(rows)], "doc_id string, model string, ord int, start int, end int, entity_type string, text string")
    return sorted(tuple(r)[1:] for r in ensemble.vote(frame, models, n, tie).select("doc_id", "start", "end", "entity_type", "text").collect())


def test_votes(spark):
    three = [("a", 0, 5, "PERSON", "Maria"), ("b", 0, 5, "PERSON", "Maria"), ("c", 0, 6, "LOC", "Maria,")]
    assert votes(spark, three, ["a", "b", "c"], 2) == [(0, 5, "PERSON", "Maria")]
    assert votes(spark, [("a", 0, 5, "ORG", "x"), ("b", 5, 9, "ORG", "y")], ["a", "b"], 1) == [(0, 5, "ORG", "x"), (5, 9, "ORG", "y")]
    assert votes(spark, [("a", 0, 5, "ORG", "x"), ("b", 5, 9, "ORG", "y")], ["a", "b"], 2) == []
    chain = [("a", 0, 4, "ORG", "abcd"), ("b", 3, 8, "ORG", "defgh"), ("a", 7, 9, "ORG", "hi")]
    assert votes(spark, chain, ["a", "b"], 2) == [(3, 8, "ORG", "defgh")]
    assert votes(spark, chain, ["a", "b"], 2, "shortest") == [(7, 9, "ORG", "hi")]
    for models, n, tie in ((["a"], 0, "longest"), (["a"], 2, "longest"), ([], 1, "longest"), (["a"], 1, "x")):
        with pytest.raises(ValueError):
            ensemble.check(models, n, tie)


def annotated(spark, *fact_lists):
    rows = [(f"d{i}", "1", "train", "", [mention(j, j + 1, k, "QUASI", v) for j, (k, v) in enumerate(facts)]) for i, facts in enumerate(fact_lists)]
    return spark.createDataFrame(rows, ANNOTATED)


def needed(spark, order, *fact_lists):
    rows = risk.facts_by_document(risk.facts(annotated(spark, *([("DEM", v) for v in facts] for facts in fact_lists))))
    return {r.doc_id: r.needed for r in risk.facts_needed(rows, order).collect()}


def test_facts_needed(spark):
    assert needed(spark, "rarest", ["nurse", "plovdiv"], ["nurse"], ["nurse", "sofia"], ["nurse"])["d0"] == 1
    assert needed(spark, "rarest", ["nurse", "bulgarian"], ["nurse", "german"], ["teacher", "bulgarian"])["d0"] == 2
    assert needed(spark, "rarest", ["nurse"], ["nurse", "german"])["d0"] is None
    assert needed(spark, "document", ["c", "b", "a"], ["a", "b"], ["b"], ["c"], ["c"], ["c"])["d0"] == 2
    assert needed(spark, "rarest", ["c", "b", "a"], ["a", "b"], ["b"], ["c"], ["c"], ["c"])["d0"] == 3


@pytest.mark.parametrize("order", ["rarest", "document"])
def test_facts_needed_is_greedy(spark, order):
    rng = random.Random(9)
    docs = [sorted({rng.choice("abcdef") for _ in range(rng.randint(1, 4))}, key=lambda _: rng.random()) for _ in range(60)]
    df = {v: sum(v in d for d in docs) for v in "abcdef"}

    def plain(i):
        told = sorted(docs[i], key=lambda v: (df[v], v)) if order == "rarest" else docs[i]
        others = [set(d) for j, d in enumerate(docs) if j != i]
        for n in range(1, len(told) + 1):
            if not any(set(told[:n]) <= o for o in others):
                return n
        return None

    assert needed(spark, order, *docs) == {f"d{i}": plain(i) for i in range(len(docs))}


def test_k_table_unites_annotators(spark):
    rows = [("d0", "1", "train", "", [mention(0, 1, "LOC", "QUASI", "Rome")]), ("d0", "2", "train", "", [mention(2, 3, "DEM", "QUASI", "Roma "), mention(4, 5, "LOC", "QUASI", " ")]), ("d1", "1", "train", "", [mention(0, 1, "LOC", "QUASI", "rome"), mention(0, 1, "DEM", "QUASI", "roma")]), ("d2", "1", "train", "", [mention(0, 1, "LOC", "QUASI", "x")])]
    docs = spark.createDataFrame(rows, ANNOTATED)
    got = {r.doc_id: (r.n_facts, r.k) for r in risk.k_anonymity(risk.facts_by_document(risk.facts(docs))).collect()}
    assert got == {"d0": (2, 2), "d1": (2, 2)}
    assert risk.k_anonymity(risk.facts_by_document(risk.facts(docs.limit(0)))).count() == 0
    assert risk.haystack(docs).collect()[0].cnt == 1


def test_bio_round_trip_and_rules(spark):
    tokens = [(0, 0, None), (0, 4, 0), (4, 5, 0), (6, 9, 1), (10, 13, 2), (0, 0, None), (14, 16, 3)]
    golden = [(0, 9, "PERSON", ""), (10, 13, "PERSON", ""), (14, 15, "ORG", "")]
    docs = spark.createDataFrame([("abcde fgh ijk lm", tokens, golden)], f"text string, t array<struct<start:int,end:int,word_id:int>>, g array<{PREDICTED}>")
    b, i = bio.LABEL_ID["B-PERSON"], bio.LABEL_ID["I-PERSON"]
    assert docs.select(bio.encode(F.col("t"), F.col("g"))).first()[0] == [-100, b, -100, i, i, -100, 0]
    labelled = [(0, 0, b), (0, 5, i), (6, 9, i), (10, 13, b), (14, 16, 99)]
    rows = spark.createDataFrame([("abcde fgh ijk lm", labelled)], "text string, t array<struct<start:int,end:int,label_id:int>>")
    got = rows.select(bio.decode(F.col("text"), F.col("t"))).first()[0]
    assert [(s.start, s.end, s.entity_type, s.text) for s in got] == [(0, 9, "PERSON", "abcde fgh"), (10, 13, "PERSON", "ijk")]
    assert len(bio.LABELS) == 17


@pytest.mark.parametrize("n,want", [(0, []), (5, [(0, 5)]), (8, [(0, 8)]), (9, [(0, 8), (6, 3)]), (20, [(0, 8), (6, 8), (12, 8)])])
def test_windows(spark, n, want):
    docs = spark.createDataFrame([("d", list(range(n)))], "doc_id string, t array<int>")
    got = sorted((r.first, len(r.tokens)) for r in bio.windows(docs, "t", 8, 2).collect())
    assert got == want


def test_bio_against_plain_rules(spark):
    rng, kinds = random.Random(4), ["ORG", "LOC", "PERSON", "NEW"]
    rows = []
    for d in range(120):
        tokens, at = [], 0
        for i in range(rng.randrange(14)):
            if rng.random() < 0.15:
                tokens.append((0, 0, None))
            at += rng.randrange(3)
            tokens.append((at, at + rng.randrange(1, 4), rng.choice((i, i, max(i - 1, 0), None))))
            at = tokens[-1][1]
        golden = [(a := rng.randrange(20), a + rng.randrange(8), rng.choice(kinds), "") for _ in range(rng.randrange(5))]
        rows.append((d, "x" * 80, tokens, golden, [rng.choice((-100, 0, 99, None, *range(17))) for _ in tokens]))
    frame = spark.createDataFrame(rows, f"d int, text string, t array<struct<start:int,end:int,word_id:int>>, g array<{PREDICTED}>, ids array<int>")
    labelled = F.zip_with("t", "ids", lambda t, i: F.struct(t["start"].alias("start"), t["end"].alias("end"), i.alias("label_id")))
    got = frame.select("d", bio.encode(F.col("t"), F.col("g")).alias("e"), bio.decode(F.col("text"), labelled).alias("s")).collect()
    for (_, _, tokens, golden, ids), r in zip(rows, sorted(got, key=lambda r: r.d)):
        want, last, word = [], "O", None
        for a, z, w in tokens:
            if (a, z) == (0, 0):
                want.append(-100)
                word = None
                continue
            if w is not None and w == word:
                want.append(-100)
                continue
            word = w
            kind = next((k for s, e, k, _ in golden if s <= a and z <= e and k != "NEW"), None)
            label = "O" if kind is None else ("I-" if last[2:] == kind else "B-") + kind
            want.append(bio.LABEL_ID[label])
            last = label
        assert r.e == want
        spans, open_ = [], None
        for (a, z, _), i in zip(tokens, ids):
            if (a, z) == (0, 0):
                continue
            label = bio.LABELS[i] if i is not None and 0 < i < 17 else "O"
            if label[0] == "I" and open_ and open_[2] == label[2:]:
                open_[1] = z
            else:
                open_ = [a, z, label[2:]] if label != "O" else None
                spans += [open_] if open_ else []
        assert [[s.start, s.end, s.entity_type] for s in r.s] == spans


def test_a_long_document_is_labelled_in_linear_time(spark):
    import time

    text = "word " * 20_000
    golden = [(a, a + 14, "ORG", "") for a in range(0, 100_000, 250)]
    docs = spark.createDataFrame([(text, golden)], f"text string, g array<{PREDICTED}>").cache()
    docs.count()
    docs = docs.select("text", "g", bio.words(F.col("text")).alias("t"))
    docs = docs.withColumn("t", F.zip_with("t", bio.encode(F.col("t"), F.col("g")), lambda t, i: F.struct(t["start"].alias("start"), t["end"].alias("end"), i.alias("label_id"))))
    began = time.time()
    found = docs.select(F.size(bio.decode(F.col("text"), F.col("t")))).first()[0]
    assert found == 400 and time.time() - began < 15  # 66 s when it was quadratic


def test_token_scores(spark):
    b, i, o = bio.LABEL_ID["B-ORG"], bio.LABEL_ID["I-ORG"], bio.LABEL_ID["B-LOC"]
    rows = [([b, i, 0, o, b, 3], [b, i, 0, b, -100, 0])]
    r = bio.token_scores(spark.createDataFrame(rows, "said array<int>, golden array<int>"), "said", "golden").first()
    assert (r.tp, r.fp, r.fn) == (1, 2, 1)


def test_windows_are_united(spark):
    rows = [("d", 0, 0, 3, "ORG", "abc"), ("d", 1, 0, 3, "ORG", "abc"), ("d", 1, 0, 3, "LOC", "abc")]
    frame = spark.createDataFrame(rows, "doc_id string, window int, start int, end int, entity_type string, text string")
    assert bio.union_of_windows(frame).count() == 2


def test_located():
    assert detect.located("Sofia Sofiana, Sofia.", [("Sofia", "LOC"), ("Sofia", "ORG"), ("Sofia", "MISC"), ("", "ORG")]) == [(0, 5, "LOC", "Sofia"), (15, 20, "ORG", "Sofia")]


def test_analyser_scores(spark):
    propose = lambda t: F.expr("array(struct(0 AS start, 3 AS end, 'PERSON' AS label, 0.4D AS score), struct(4 AS start, 6 AS end, 'PERSON' AS label, 0.39D AS score), struct(4 AS start, 6 AS end, 'URL' AS label, 0.9D AS score))")
    docs = docs_of(spark, "Ann xy Case no. 12/99")
    assert [tuple(s) for s in docs.select(detect.analyser(propose)(F.col("text"))).first()[0]] == [(0, 3, "PERSON", "Ann"), (7, 21, "CODE", "Case no. 12/99")]
    assert len(docs.select(detect.analyser(propose, case_numbers=False)(F.col("text"))).first()[0]) == 1


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "b.txt").write_text(" Ann \n", encoding="utf-8")
    (tmp_path / "in" / "a.txt").write_text("é", encoding="utf-8")
    assert [tuple(r) for r in readers.example_texts(spark, f"{tmp_path}/in").collect()] == [("a", "é"), ("b", "Ann")]
    table = evaluate.results(scored(spark, [(0, 4, "ORG")], [(0, 4, "ORG")]))
    writers.results_csv(table, f"{tmp_path}/res")
    back = readers.results_csv(spark, f"{tmp_path}/res", "m")
    assert back.count() == 18 and {r.model for r in back.collect()} == {"m"}
    assert readers.results_csv(spark, f"{tmp_path}/none", "m") is None
    docs, rules = docs_of(spark, "in 1999", "x"), {"rules": detect.rule_detector()}
    assert writers.resume_predictions(spark, docs.limit(1), rules, f"{tmp_path}/cache") == 1
    assert writers.resume_predictions(spark, docs, rules, f"{tmp_path}/cache") == 1
    assert writers.resume_predictions(spark, docs, rules, f"{tmp_path}/cache") == 0
    cache = readers.predictions(spark, f"{tmp_path}/cache")
    assert cache.count() == 2 and cache.schema == spark.createDataFrame([], CACHE).schema
    docs.write.json(f"{tmp_path}/ann")
    assert readers.annotated(spark, f"{tmp_path}/ann").count() == 2


def test_adapters(spark):
    from types import SimpleNamespace as O

    from hushgrain.operators import adapters

    docs = docs_of(spark, "Ann of Paris", " \n")
    said = lambda make: [[tuple(s) for s in r[0]] for r in docs.orderBy("doc_id").select(make(F.col("text"))).collect()]
    grouped = adapters.token_pipeline(lambda: lambda t: [{"entity_group": "PER", "start": 0, "end": 3, "word": "ann"}, {"entity": "LOC", "start": 7, "end": 12}, {"entity": "NO", "start": 0, "end": 1}])
    assert said(grouped) == [[(0, 3, "PERSON", "Ann"), (7, 12, "LOC", "Paris")], []]
    parsed = adapters.entity_parser(lambda: lambda t: O(ents=[O(start_char=7, end_char=12, label_="GPE"), O(start_char=0, end_char=3, label_="ODD")]))
    assert said(parsed) == [[(7, 12, "LOC", "Paris")], []]
    analyser = adapters.scoring_analyser(lambda: O(analyze=lambda text, language: [O(start=0, end=3, entity_type="PERSON", score=0.4), O(start=7, end=12, entity_type="LOCATION", score=0.39)]))
    assert said(analyser) == [[(0, 3, "PERSON", "Ann")], []]
    person, place = bio.LABEL_ID["B-PERSON"], bio.LABEL_ID["I-LOC"]
    windows = {"input_ids": [[1, 2], [2, 3]], "attention_mask": [[1, 1], [1, 1]], "offset_mapping": [[(0, 0), (0, 3)], [(0, 3), (7, 12)]]}
    labels = {1: 0, 2: person, 3: place}
    tuned = adapters.token_classifier(lambda: (lambda text, **options: windows, lambda ids, mask: [labels[i] for i in ids]))
    assert said(tuned) == [[(0, 3, "PERSON", "Ann"), (7, 12, "LOC", "Paris")], []]
    assert adapters.labelled_spans([person, person + 1, 0, place, person], [(0, 1), (1, 2), (2, 3), (3, 4), (4, 5)]) == [(0, 2, "PERSON"), (3, 4, "LOC"), (4, 5, "PERSON")]


def test_detectors_fall_back(spark):
    def absent(model):
        raise ImportError("no such library")

    detect.register("absent", absent)
    assert len(docs_of(spark, "in 1999").select(detect.detector("absent", "unknown", "rules")(F.col("text"))).first()[0]) == 1
    with pytest.raises(KeyError, match="no such library"):
        detect.detector("absent")


def test_slots(spark):
    vault = [("[PERSON_A]", "Ann Lee"), ("[PERSON_B]", "Bo"), ("[ORG_A]", "Acme")]
    names = [("bo", "PERSON"), ("Paris", "LOC"), ("ANN LEE", "PERSON"), ("Bo", "PERSON"), ("Nobody", "PERSON")]
    row = spark.createDataFrame([(names, vault)], "n array<struct<text:string,entity_type:string>>, v array<struct<token:string,original:string>>")
    slots = pseudonym.slots(F.col("n"), F.col("v"))
    got = row.select(slots.alias("s"), pseudonym.filled(F.lit("{PERSON_A} and {PERSON_B} of {ORG_A}"), slots).alias("t")).first()
    assert got.s == {"PERSON_A": "[PERSON_B]", "PERSON_B": "[PERSON_A]"} and got.t == "[PERSON_B] and [PERSON_A] of [ORG_A]"


def test_all_routes_count(spark):
    spans = spark.createDataFrame([("d", "m", 0, 1, f"T{i}", "x") for i in range(200)], "doc_id string, model string, start int, end int, entity_type string, text string")
    routes = spark.createDataFrame([(f"T{i}", "m") for i in range(150)], "entity_type string, model string")
    assert ensemble.routed(spans, routes).count() == 150


def test_unmapped_spans(spark):
    spans = [(0, 1, "ORG", "a"), (2, 3, None, "b"), (4, 5, "LOC", "c")]
    row = spark.createDataFrame([(spans,)], f"s array<{PREDICTED}>")
    known, unknown = detect.unmapped(F.col("s"))
    got = row.select(known.alias("k"), unknown.alias("u")).first()
    assert [s.text for s in got.k] == ["a", "c"] and [s.text for s in got.u] == ["b"]


def test_first_and_third_documents(spark):
    docs = spark.createDataFrame([(f"d{i}", [(0, 1, "ORG", "x", "DIRECT", "e")] * n) for i, n in enumerate((2, 5, 2, 9))], SLIM)
    assert [r.doc_id for r in evaluate.first_rows(docs, 2).collect()] == ["d0", "d1"]
    assert [r.doc_id for r in evaluate.top_documents(docs, 4).collect()] == ["d3", "d1", "d0", "d2"]
    assert [r.doc_id for r in evaluate.nth_document(docs, 3).collect()] == ["d0"] and evaluate.nth_document(docs, 9).count() == 0


def test_recall_report(spark, tmp_path):
    docs = spark.createDataFrame([("d", [(0, 3, "ORG", "abc", "DIRECT", "e"), (5, 7, "ORG", "ab", "DIRECT", "e")], [(0, 2, "ORG", "ab")])], f"{SLIM}, predicted array<{PREDICTED}>")
    entities = evaluate.entity_recall(docs)
    writers.recall_report(entities, evaluate.recall_summary(entities), f"{tmp_path}/r")
    assert [tuple(r) for r in spark.read.csv(f"{tmp_path}/r/entities", header=True).collect()] == [("d", "e", "ORG", "2", "1")]
    summary = spark.read.json(f"{tmp_path}/r/summary").first()
    assert (summary.n_entities, summary.n_mentions, summary.macro_recall, summary.micro_recall) == (1, 2, 0.5, 0.5)


def test_html(spark, tmp_path):
    done = redact.lite(spans_of(spark, "Ann <a@b> & co", [("Ann", "PERSON")]))
    html = done.select(writers.as_html()).first()[0]
    assert "<pre><mark>[PERSON]</mark> &lt;a@b&gt; &amp; co</pre>" in html and "k - → -, 0 iterations, converged" in html
    writers.html_pages(done, f"{tmp_path}/h")
    assert spark.read.text(f"{tmp_path}/h").count() == 1


def test_failing_model_has_no_spans(spark):
    def load():
        def model(text):
            if "bad" in text:
                raise RuntimeError(text)
            return [(0, 1, "ORG", text[:1])]

        return model

    found = detect.detect_spans(docs_of(spark, "good", "bad"), detect.model_detector(load), use_coref=False)
    assert [len(r.spans) for r in found.orderBy("doc_id").collect()] == [1, 0]


def test_stream(spark, tmp_path):
    docs_of(spark, "mail a@b.com", "x").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("doc_id string, text string").parquet(f"{tmp_path}/in")
    assert redacted_stream(stream).isStreaming
    write_redacted(stream, f"{tmp_path}/out", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    assert {r.redacted_text for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {"mail [MISC]", "x"}


def test_command_line(spark, tmp_path, capsys):
    source = tmp_path / "t.txt"
    source.write_text("Mr John Smith of Paris wrote to a@b.com. Mr Smith called.", encoding="utf-8")
    assert cli.main(["redact", str(source), "--vault-out", str(tmp_path / "v.json")], spark) == 0
    text = capsys.readouterr().out
    assert text.strip() == "[PERSON_A] of Paris wrote to [MISC_A]. [PERSON_A] called."
    (tmp_path / "answer.txt").write_text(text, encoding="utf-8")
    cli.main(["restore", str(tmp_path / "answer.txt"), "--vault", str(tmp_path / "v.json")], spark)
    assert capsys.readouterr().out.strip() == "Mr John Smith of Paris wrote to a@b.com. Mr John Smith called."
    cli.main(["redact", str(source), "--variant", "pro", "--json"], spark)
    said = json.loads(capsys.readouterr().out)
    assert said["converged"] is False and said["iterations_used"] == 3 and {a["action"] for a in said["audit"]} == {"redact", "generalize"}
    (tmp_path / "more").mkdir()
    for name in "ab":
        (tmp_path / "more" / f"{name}.txt").write_text(f"Mr {name.upper()}nn Lee", encoding="utf-8")
    cli.main(["redact", str(tmp_path / "more"), "--ner", "absent-one,rules", "--vault-out", str(tmp_path / "vs.json")], spark)
    assert json.loads((tmp_path / "vs.json").read_text()) == {"a": {"[PERSON_A]": "Mr Ann Lee"}, "b": {"[PERSON_A]": "Mr Bnn Lee"}}
    with pytest.raises(SystemExit):
        cli.main(["redact", str(source), "--variant", "pro", "--mosaic-haystack", "tab"], spark)
