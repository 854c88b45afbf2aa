"""One query for each operator, over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hushgrain.llm import arrow_store, knn, langid, packing, pieces, pii, quality, simhash, token_counts, url_rules
from hushgrain.llm.runtime import new_path, read

#: Tokenizer files and what each needs to know; the path is looked up when a query runs.
WORD_BPE = {"name": "word_bpe_49k.json", "end_id": 2, "drops_space": True}
PIECES = "piece_bpe_32k.model"
BYTE_BPE = {"name": "byte_bpe_50k.json", "end_id": 0, "drops_space": False}


def tokenizer(spec: dict) -> dict:
    import public_tokenizers

    return {"tokenizer": public_tokenizers.path(spec["name"]), "end_id": spec["end_id"], "drops_space": spec["drops_space"]}


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.counts(F.col("text"), tokenizer(BYTE_BPE)["tokenizer"])
    return read(spark, sf_dir, "documents").select("doc_id", counted.alias("c")).select("doc_id", "c.n_words", "c.n_tokens")


def op2_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    mined = url_rules.mine(url_rules.labelled(pages, read(spark, sf_dir, "labels")))
    return url_rules.judge(pages, mined).drop("mined_bad")


def op3_voronoi_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op4_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = packing.pack(read(spark, sf_dir, "documents"), **tokenizer(WORD_BPE))
    return placed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = read(spark, sf_dir, "documents").select("doc_id", pii.spans(F.col("text")).alias("found"))
    base = F.filter("found", lambda s: s["kind"].isin(*pii.BASE_KINDS))

    def count(kind: str) -> Column:
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, pii.BASE_KINDS), F.sha2(pii.described(base), 256).alias("base_sha256"), pii.described(F.col("found")).alias("spans"))


def op7_robust_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.assess(read(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


def op8_nbest_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path(PIECES)
    found = read(spark, sf_dir, "documents").select("doc_id", "text", pieces.encoded(F.col("text"), path).alias("e"))
    found = found.select("*", pieces.decoded(F.col("e.ids"), path).alias("back"))
    scores = F.array_join(F.transform("e.nbest", lambda x: F.concat_ws(":", (x["score"] * 1024).cast("long").cast("string"), x["n_pieces"].cast("string"))), ",")
    return found.select("doc_id", F.col("e.nbest")[0]["n_pieces"].alias("n_pieces"), F.crc32("e.ids").alias("ids_crc32"), scores.alias("nbest"), (F.col("back") == F.col("text")).alias("round_trip"))


def op9_arrow_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = arrow_store.write(read(spark, sf_dir, "documents"), new_path(spark, "sequences"), **tokenizer(BYTE_BPE))
    return arrow_store.read_documents(spark, parts, checksum=True)


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def op10_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = langid.train(docs.where(~held_out(F.col("doc_id"))))
    found = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), langid.predictions(docs, model).alias("p"))
    return found.select("doc_id", "held_out", "p.lang_pred", "p.score")


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_url_rules, op3_voronoi_knn, op4_sum_of_squares_packing, op5_simhash_trie, op6_personal_data, op7_robust_quality, op8_nbest_pieces, op9_arrow_sequences, op10_ppm_language)}
ORACLE_SQL: dict[str, str] = {
    "op2_url_rules": """
WITH RECURSIVE cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(rest, '^[^?#]*\\?([^#]*)', 1) AS query FROM cut),
tokened AS (
  SELECT page_id, host, path, list_sort(list_distinct(list_concat(list_concat(
    ['h:' || x FOR x IN string_split(host, '.') IF x <> ''],
    ['p:' || regexp_replace(x, '[0-9]+', '#', 'g') FOR x IN string_split(path, '/') IF x <> '']),
    ['q:' || string_split(x, '=')[1] FOR x IN string_split(query, '&') IF string_split(x, '=')[1] <> '']))) AS tokens
  FROM parts),
bad AS (
  SELECT doc_id, max(CASE WHEN coalesce(quality, 1) = 0 OR coalesce(toxic, 0) = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id),
examples AS (
  SELECT row_number() OVER () AS id, tokens, bad FROM tokened JOIN bad ON page_id = doc_id),
needed AS (SELECT greatest(20, ceil(0.002 * count(*) - 1e-9)) AS least, avg(bad) AS base FROM examples),
one AS (
  SELECT id, bad, t FROM (SELECT id, bad, unnest(tokens) AS t FROM examples) JOIN needed ON TRUE
  QUALIFY sum(bad) OVER (PARTITION BY t) >= least),
sets AS (
  SELECT id, bad, [t] AS s, t AS last FROM one
  UNION ALL SELECT g.id, g.bad, list_append(g.s, o.t), o.t FROM sets g JOIN one o ON o.id = g.id AND o.t > g.last),
counted AS (SELECT s, count(*) AS n, sum(bad) AS b FROM sets GROUP BY s),
mined AS (
  SELECT s FROM (SELECT s, n, b / n AS p, least, b, base FROM counted JOIN needed ON TRUE)
  WHERE b >= least AND p >= 0.5 AND (p + 3.29 * 3.29 / (2 * n) - 3.29 * sqrt(p * (1 - p) / n + 3.29 * 3.29 / (4 * n * n))) / (1 + 3.29 * 3.29 / n) > base),
hit AS (SELECT DISTINCT page_id FROM tokened JOIN mined ON list_has_all(tokens, s)),
stated(rule, verdict) AS (VALUES ('com/en/', 'block'), ('example.com/en/7', 'allow'), ('net/de/', 'allow'), ('example.net/de/8', 'block'), ('org/es/', 'block')),
fits AS (
  SELECT page_id, host, path, tokens, (
    SELECT rule FROM stated WHERE (host = split_part(rule, '/', 1) OR ends_with(host, '.' || split_part(rule, '/', 1)))
      AND starts_with(path, substr(rule, strpos(rule, '/'))) ORDER BY length(rule) DESC, rule LIMIT 1) AS rule FROM tokened)
SELECT f.page_id, host, path, f.rule,
  coalesce(verdict, CASE WHEN h.page_id IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM fits f LEFT JOIN stated ON stated.rule = f.rule LEFT JOIN hit h ON h.page_id = f.page_id""",
    "op3_voronoi_knn": """
WITH v AS (
  SELECT vec_id, [floor(1024 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0),
s AS (
  SELECT q.vec_id AS query_id, d.vec_id, CAST(list_inner_product(q.v, d.v) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id % 100 = 0 AND q.vec_id <> d.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
}
