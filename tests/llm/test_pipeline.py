"""The corpus pipeline: each stage against plain code on a small table."""

import pytest

import corpus_pipeline
from hushgrain.llm import langid, pii, quality

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], SF).cache())
    return out


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "language_id", "near_dedup", "personal_data", "pack_sequences"]


def test_quality_stage(stages):
    docs, kept = stages[0], stages[1]
    assert kept.columns == docs.columns
    own = {r.doc_id for r in quality.assess(docs).where("kept").collect()}
    assert {r.doc_id for r in kept.collect()} == own


def test_language_stage(stages):
    kept = {r.doc_id: r for r in stages[2].collect()}
    assert set(kept) <= {r.doc_id for r in stages[1].collect()}
    assert {r.lang for r in kept.values()} <= {"en", "de", "fr", "es"} - {langid.UNKNOWN}


def test_dedup_stage(stages):
    from tests.llm.test_near_copies import plain_kept

    rows = [(r.doc_id, r.text) for r in stages[2].collect()]
    assert sorted(r.doc_id for r in stages[3].collect()) == plain_kept(rows)


def test_personal_data_stage(stages):
    before = {r.doc_id: r.text for r in stages[3].collect()}
    for r in stages[4].collect():
        assert r.text == pii.redact_text(before[r.doc_id]) and r.n_chars == len(r.text)
        assert not [s for s in pii.find_spans(r.text) if s[0] == "email"]


def test_packing_stage(stages):
    assert {r.doc_id for r in stages[5].collect()} == {r.doc_id for r in stages[4].collect()}


def test_empty(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0 and docs.columns == list(corpus_pipeline.COLUMNS)
    assert corpus_pipeline.pack_sequences(spark, docs, SF).count() == 0


def test_nulls_and_repeated_ids(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = docs.where("n_chars between 400 and 900").orderBy("doc_id").select("text", "lang").limit(2).collect()
    rows = [(5, t.text, t.lang, "s", 1) for t in text] + [(None, text[0].text, text[0].lang, None, None), (5, text[0].text, text[0].lang, "s", 1)]
    rows += [(6, None, None, None, None), (None, None, "en", None, 3), (7, "", "en", "s", 0)]
    some = spark.createDataFrame(rows, docs.schema)
    out = [some.unionByName(docs)]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], SF).cache())
    assert not [r for r in out[1].collect() if not r.text]  # too short, whatever their language
    texts = [r.text for r in out[3].collect()]
    assert len(set(texts)) == len(texts) and set(texts) <= {r.text for r in out[2].collect()}
    assert {r.doc_id for r in out[5].collect()} == {r.doc_id for r in out[4].collect()}
