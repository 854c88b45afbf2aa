"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir), docs having the columns of `documents`, and works on every
row of docs. run() writes each stage's result to the shared folder and reads it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushgrain.llm import langid, near_copies, packing, pii, quality
from hushgrain.llm.queries import WORD_BPE, tokenizer
from hushgrain.llm.runtime import bounded, read, table

#: Least posterior of a document's language.
MIN_LANGUAGE_SCORE = 0.5
#: Most bits a byte, as a multiple of what the texts take that the language was learned from.
MAX_STRANGE = 3.0
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that fail the base limits or are outliers of their language and source."""
    return quality.keep(docs).select(*COLUMNS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents whose language is unknown or unsure, or whose bytes are far from what is usual in
    it; lang is the predicted language."""
    model = langid.train(docs)
    found = docs.withColumn("found", langid.predictions(docs, model))
    sure = (F.col("found.score") >= MIN_LANGUAGE_SCORE) & (F.col("found.strange") <= MAX_STRANGE)
    kept = found.where((F.col("found.lang_pred") != langid.UNKNOWN) & sure)
    return kept.withColumn("lang", F.col("found.lang_pred")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, linked at a Jaccard similarity of 0.8 or more of their
    five-word shingles: the one with the least doc_id. SimHash's trie self-join links the close ones;
    what differs in more bits than it reaches is found by near_copies. Rows count by themselves:
    repeated rows and rows without a doc_id are copies like others, and a doc_id's other texts stay."""
    return near_copies.without_copies(docs).select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in brackets."""
    bounded(spark)
    return docs.withColumn("text", pii.redacted(F.col("text"))).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in token sequences, ids and their checksum."""
    bounded(spark)
    placed = packing.pack(docs, cached=150_000, portion=1_000_000, **tokenizer(WORD_BPE))
    return placed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("personal_data", personal_data),
    ("pack_sequences", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
