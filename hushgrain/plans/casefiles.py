"""An annotated corpus made of the star-schema tables: one case file for each customer, with gold
mentions by two annotators and three imperfect predictors. Its SQL twin is CASES_SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hushgrain.functions.labels import role
from hushgrain.operators.detect import as_pipeline
from hushgrain.operators.evaluate import gold
from hushgrain.schema import MENTION, PREDICTED

FIRST = ("Maria", "John", "Elena", "Ivan", "Tomás", "Ana", "Piotr", "Sofie", "Lars", "Nadia", "Omar", "Grace", "Hugo", "Irene", "Jakub", "Klara", "Liam", "Mona", "Nils", "Olga")
LAST = ("Petrova", "Smith", "Ferreira", "Kowalski", "Novak", "Jensen", "Rossi", "Dubois", "Schmidt", "Garcia", "Ivanov", "Murphy", "Nagy", "Popescu", "Larsen", "Virtanen", "Costa", "Moreau", "Weber", "Santos", "Horvat", "Byrne", "Keller", "Marin", "Lund")
ORGS = ("Northwind Energy Ltd", "Acme Holdings Ltd", "Sofia District Court", "Meridian Shipping Ltd", "Quantum Labs Inc", "Harbour Group plc", "Alpine Foods GmbH", "Cobalt Mining Corp", "Verdant Farms Ltd", "Regional Court", "Bluewater Group", "Orion Textiles Ltd")
CITIES = ("Plovdiv", "Sofia", "Istanbul", "Moscow", "Warsaw", "Budapest", "Kyiv", "Athens", "Rome", "Paris", "London", "Leeds", "Berlin", "Madrid", "Atlantis", "Dublin")
DEMS = ("Bulgarian", "Romanian", "Russian", "Polish", "German", "Turkish", "Greek", "Roma", "Catholic", "Martian")
MODELS = ("a", "b", "c")

_SEGMENT = "struct<t:string,kind:string,role:string,entity:string>"


def _pick(names: tuple[str, ...], index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), (index % len(names) + 1).cast("int"))


def _segments(k: Column) -> Column:
    def plain(t: str) -> Column:
        return F.struct(F.lit(t).alias("t"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("entity"))

    def named(t: Column, kind: str, role, entity: str) -> Column:
        role = F.lit(role) if isinstance(role, str) else role
        return F.struct(t.alias("t"), F.lit(kind).alias("kind"), role.alias("role"), F.concat(F.lit(entity), k.cast("string")).alias("entity"))

    third, fifth, seventh = (F.floor(k / n) for n in (3, 5, 7))
    first, last, org = _pick(FIRST, k), _pick(LAST, third), _pick(ORGS, fifth)
    case = F.concat(F.lit("Application no. "), (k + 1000).cast("string"), F.lit("/"), (k % 89 + 10).cast("string"))
    amount = F.concat(F.lit("€"), F.floor(F.abs("c_acctbal")).cast("long").cast("string"))
    return F.array(
        plain("The applicant, "), named(F.concat_ws(" ", first, last), "PERSON", "DIRECT", "p"),
        plain(", is a "), named(F.concat((k % 60 + 18).cast("string"), F.lit("-year-old")), "QUANTITY", "QUASI", "q"),
        plain(" "), named(_pick(DEMS, seventh), "DEM", "QUASI", "d"),
        plain(" national living in "), named(_pick(CITIES, k * 7), "LOC", F.when(k % 13 == 0, "NO_MASK").otherwise("QUASI"), "l"),
        plain(". On "), named(F.date_format("opened", "d MMMM yyyy"), "DATETIME", "QUASI", "t"),
        plain(" a complaint ("), named(case, "CODE", "DIRECT", "c"),
        plain(") was filed against "), named(org, "ORG", "DIRECT", "o"),
        plain(". "), named(F.concat(F.lit("Mrs "), last), "PERSON", "DIRECT", "p"),
        plain(" seeks "), named(amount, "QUANTITY", "QUASI", "m"),
        plain(" from "), named(F.substring_index(org, " ", 1), "ORG", "DIRECT", "o"), plain("."),
    )


def _mentions(segments: Column) -> Column:
    """Mentions with their offsets: one fold over the segments."""

    def step(acc: Column, s: Column) -> Column:
        end = (acc["at"] + F.length(s["t"])).cast("int")
        m = F.struct(acc["at"].alias("start_offset"), end.alias("end_offset"), s["kind"].alias("entity_type"), s["t"].alias("span_text"), s["role"].alias("identifier_type"), s["entity"].alias("entity_id"))
        return F.struct(end.alias("at"), F.when(s["kind"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(m))).alias("out"))

    start = F.struct(F.lit(0).cast("int").alias("at"), F.array().cast(f"array<{MENTION}>").alias("out"))
    return F.aggregate(segments, start, step, lambda a: a["out"])


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, doc_id, split, text, entity_mentions) with all mentions."""
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("k"), "c_acctbal")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(F.col("o_custkey").alias("k")).agg(F.min("o_orderdate").alias("opened"))
    rows = customer.join(orders, "k", "left").withColumn("opened", F.coalesce("opened", F.to_timestamp(F.lit("1995-01-01 00:00:00"))))
    rows = rows.withColumn("segments", _segments(F.col("k")))
    split = F.when(F.col("k") % 10 < 7, "train").when(F.col("k") % 10 < 8, "validation").otherwise("test")
    return rows.select("k", F.concat(F.lit("case-"), F.col("k").cast("string")).alias("doc_id"), split.alias("split"), F.array_join(F.transform("segments", lambda s: s["t"]), "").alias("text"), _mentions(F.col("segments")).alias("entity_mentions"))


def annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each of two annotators. The second misses some mentions and takes some demographic
    terms for direct identifiers."""
    one = cases(spark, sf_dir)
    k = F.col("k")
    kept = F.filter("entity_mentions", lambda m, i: (k + i) % 7 != 0)
    other = F.transform(kept, lambda m: F.when((m["entity_type"] == "DEM") & (k % 5 == 0), m.withField("identifier_type", F.lit("DIRECT"))).otherwise(m))
    both = one.select("*", F.explode(F.array(F.struct(F.lit("1").alias("annotator_id"), F.col("entity_mentions").alias("m")), F.struct(F.lit("2").alias("annotator_id"), other.alias("m")))).alias("x"))
    return both.select("k", "doc_id", "x.annotator_id", "split", "text", F.col("x.m").alias("entity_mentions"))


def predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, model, gold, spans): the prediction cache of three predictors, each with its faults."""
    rows = cases(spark, sf_dir).withColumn("gold", gold(F.col("entity_mentions")))
    k = F.col("k")
    cut = lambda s: F.struct(s["start"].alias("start"), (s["end"] - 1).alias("end"), s["entity_type"].alias("entity_type"), F.substring(s["text"], F.lit(1), F.length(s["text"]) - 1).alias("text")).cast(PREDICTED)
    a = F.transform(F.filter(F.transform("gold", lambda s, i: F.struct(s.alias("s"), i.alias("i"))), lambda x: (k + x["i"]) % 7 != 0), lambda x: F.when((k + x["i"]) % 5 == 0, cut(x["s"])).otherwise(x["s"]))
    b = F.transform(F.filter(F.transform("gold", lambda s, i: F.struct(s.alias("s"), i.alias("i"))), lambda x: (k + x["i"]) % 4 != 0), lambda x: F.when((k + x["i"]) % 11 == 0, x["s"].withField("entity_type", F.lit("MISC"))).otherwise(x["s"]))
    stray = F.struct(F.lit(0).alias("start"), F.lit(3).alias("end"), F.lit("ORG").alias("entity_type"), F.lit("The").alias("text")).cast(PREDICTED)
    c = F.concat(F.array(stray), F.filter("gold", lambda s, i: (k + i) % 3 != 0))
    models = F.array(*[F.struct(F.lit(m).alias("model"), spans.alias("spans")) for m, spans in zip(MODELS, (a, b, c))])
    return rows.select("doc_id", "text", "entity_mentions", "gold", F.explode(models).alias("m")).select("doc_id", "text", "entity_mentions", "gold", "m.model", "m.spans")


def as_spans(mentions: Column) -> Column:
    """DIRECT and QUASI mentions as pipeline spans with their roles, as a manual annotator gives them."""
    return F.transform(as_pipeline(gold(mentions), "manual"), lambda s: s.withField("identifier_role", role(s["entity_type"])))


def _list(names: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{n}'" for n in names) + "]"


def _sql_pick(names: tuple[str, ...], index: str) -> str:
    return f"({_list(names)})[CAST(({index}) % {len(names)} AS INTEGER) + 1]"


_SQL_SEGMENTS = (
    ("'The applicant, '", None, None, None),
    ("concat(first, ' ', last)", "PERSON", "'DIRECT'", "p"),
    ("', is a '", None, None, None),
    ("concat(k % 60 + 18, '-year-old')", "QUANTITY", "'QUASI'", "q"),
    ("' '", None, None, None),
    (_sql_pick(DEMS, "k // 7"), "DEM", "'QUASI'", "d"),
    ("' national living in '", None, None, None),
    (_sql_pick(CITIES, "k * 7"), "LOC", "CASE WHEN k % 13 = 0 THEN 'NO_MASK' ELSE 'QUASI' END", "l"),
    ("'. On '", None, None, None),
    ("strftime(opened, '%-d %B %Y')", "DATETIME", "'QUASI'", "t"),
    ("' a complaint ('", None, None, None),
    ("concat('Application no. ', k + 1000, '/', k % 89 + 10)", "CODE", "'DIRECT'", "c"),
    ("') was filed against '", None, None, None),
    ("org", "ORG", "'DIRECT'", "o"),
    ("'. '", None, None, None),
    ("concat('Mrs ', last)", "PERSON", "'DIRECT'", "p"),
    ("' seeks '", None, None, None),
    ("concat('€', CAST(floor(abs(c_acctbal)) AS BIGINT))", "QUANTITY", "'QUASI'", "m"),
    ("' from '", None, None, None),
    ("split_part(org, ' ', 1)", "ORG", "'DIRECT'", "o"),
    ("'.'", None, None, None),
)


def _sql_segment(i: int, t: str, kind: str | None, role: str | None, entity: str | None) -> str:
    named = (f"'{kind}'", role, f"concat('{entity}', k)") if kind else ("NULL", "NULL", "NULL")
    return f"SELECT k, {i} AS i, {t} AS t, CAST({named[0]} AS VARCHAR) AS kind, CAST({named[1]} AS VARCHAR) AS role, CAST({named[2]} AS VARCHAR) AS entity FROM base"


#: Tables for oracles: seg, doc(k, doc_id, split, text), men(doc_id, k, idx, s, e, kind, txt, role, ent) of the
#: first annotator, ann(... annotator) of both, pred(doc_id, model, ord, s, e, kind, txt), gold(doc_id, idx, s, e, kind, txt).
CASES_SQL = (
    f"""base AS (
  SELECT c_custkey AS k, c_acctbal, coalesce(opened, TIMESTAMP '1995-01-01') AS opened,
    {_sql_pick(FIRST, "c_custkey")} AS first, {_sql_pick(LAST, "c_custkey // 3")} AS last, {_sql_pick(ORGS, "c_custkey // 5")} AS org
  FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderdate) AS opened FROM orders GROUP BY 1) o ON o_custkey = c_custkey),
seg0 AS ("""
    + "\n  UNION ALL ".join(_sql_segment(i, *s) for i, s in enumerate(_SQL_SEGMENTS))
    + """),
seg AS (SELECT *, CAST(coalesce(sum(length(t)) OVER (PARTITION BY k ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS s FROM seg0),
doc AS (SELECT k, concat('case-', k) AS doc_id, CASE WHEN k % 10 < 7 THEN 'train' WHEN k % 10 < 8 THEN 'validation' ELSE 'test' END AS split, string_agg(t, '' ORDER BY i) AS text FROM seg GROUP BY k),
men AS (SELECT concat('case-', k) AS doc_id, k, row_number() OVER (PARTITION BY k ORDER BY i) - 1 AS idx, s, CAST(s + length(t) AS INTEGER) AS e, kind, t AS txt, role, entity AS ent FROM seg WHERE kind IS NOT NULL),
ann AS (
  SELECT *, '1' AS annotator FROM men
  UNION ALL SELECT doc_id, k, idx, s, e, kind, txt, CASE WHEN kind = 'DEM' AND k % 5 = 0 THEN 'DIRECT' ELSE role END, ent, '2' FROM men WHERE (k + idx) % 7 <> 0),
gold AS (SELECT doc_id, k, row_number() OVER (PARTITION BY doc_id ORDER BY idx) - 1 AS idx, s, e, kind, txt FROM men WHERE role IN ('DIRECT', 'QUASI')),
pred AS (
  SELECT doc_id, 'a' AS model, idx AS ord, s, CASE WHEN (k + idx) % 5 = 0 THEN e - 1 ELSE e END AS e, kind, CASE WHEN (k + idx) % 5 = 0 THEN left(txt, length(txt) - 1) ELSE txt END AS txt FROM gold WHERE (k + idx) % 7 <> 0
  UNION ALL SELECT doc_id, 'b', idx, s, e, CASE WHEN (k + idx) % 11 = 0 THEN 'MISC' ELSE kind END, txt FROM gold WHERE (k + idx) % 4 <> 0
  UNION ALL SELECT doc_id, 'c', idx + 1, s, e, kind, txt FROM gold WHERE (k + idx) % 3 <> 0
  UNION ALL SELECT doc_id, 'c', 0, 0, 3, 'ORG', 'The' FROM doc)"""
)
