"""Column functions against plain values and Python's re."""

import random
import re

import pytest
from pyspark.sql import functions as F

from hushgrain.functions import labels, tokens
from hushgrain.functions.generalise import generalise
from hushgrain.functions.normalise import normalise
from hushgrain.functions.text import context, find_all, splice, strip, without_overlaps

UNICODE = "Tomás Ferreira 😀 aged 47 İstanbul"


def column(spark, values, expr, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in rows.orderBy("i").select(expr(F.col("x"))).collect()]


@pytest.mark.parametrize("pattern", [r"\b\w+\b", r"\d+", "[A-Z][a-z]+", r"a(?:b|c)?", r"\S+@\S+"])
def test_find_all_is_finditer(spark, pattern):
    rng = random.Random(1)
    texts = [UNICODE, "", " ", "abacab", "x\u0001y 12\u000134", "47", "éa1 b2😀c3", *("".join(rng.choice("ab c1😀éİA@\n") for _ in range(rng.randrange(30))) for _ in range(200))]
    for text, got in zip(texts, column(spark, texts, lambda x: find_all(x, pattern))):
        want = [(m.start(), m.end(), m.group()) for m in re.finditer(pattern, text.replace("\u0001", "\u0002"))]
        assert [tuple(g) for g in got] == want, text


def test_splice_and_context(spark):
    row = spark.createDataFrame([(UNICODE,)], "t string")
    spans = F.expr("array(struct(0 AS start, 5 AS end, '[A]' AS replacement), struct(15 AS start, 16 AS end, CAST(NULL AS STRING) AS replacement), struct(25 AS start, 33 AS end, '$1' AS replacement))")
    assert row.select(splice(F.col("t"), spans)).first()[0] == "[A] Ferreira 😀 aged 47 $1"
    assert row.select(context(F.col("t"), F.lit(15), F.lit(16), 3)).first()[0] == UNICODE[12:19]
    assert row.select(context(F.col("t"), F.lit(1), F.lit(3), 5)).first()[0] == UNICODE[:8]
    assert column(spark, ["  a b\n\t"], strip) == ["a b"]


def test_touching_spans_stay(spark):
    kind = "array<struct<start:int,end:int>>"
    got = spark.sql("SELECT array(struct(0 AS start, 4 AS end), struct(4 AS start, 6 AS end), struct(5 AS start, 9 AS end)) AS s").select(without_overlaps(F.col("s"), kind)).first()[0]
    assert [tuple(x) for x in got] == [(0, 4), (4, 6)]


LADDERS = [
    ("DATETIME", "12 March 1998", "1998", "1990s"),
    ("DATETIME", "last Tuesday", "[DATETIME]", "[DATETIME]"),
    ("DATETIME", "in 1066", "1066", "1060s"),
    ("QUANTITY", "47-year-old", "about 40", "in their 40s"),
    ("QUANTITY", "3 years", "about 0", "under 10"),
    ("QUANTITY", "19 years old", "about 10", "under 20"),
    ("QUANTITY", "-5", "about -10", "[QUANTITY]"),
    ("QUANTITY", "£450", "about 400", "[QUANTITY]"),
    ("QUANTITY", "£18,500", "about 18,000", "[QUANTITY]"),
    ("QUANTITY", "£2,300,000", "about 2,000,000", "[QUANTITY]"),
    ("QUANTITY", "six years", "[QUANTITY]", "[QUANTITY]"),
    ("QUANTITY", "130 years old", "about 100", "[QUANTITY]"),
    ("QUANTITY", "a household of 4.7", "about 0", "under 10"),
    ("LOC", "Plovdiv", "Bulgaria", "Europe"),
    ("LOC", " St. Petersburg, ", "Russia", "Europe/Asia"),
    ("LOC", "Bulgaria", "[LOC]", "[LOC]"),
    ("LOC", "Atlantis", "[LOC]", "[LOC]"),
    ("DEM", "Bulgarian", "European", "[DEM]"),
    ("DEM", "Martian", "[DEM]", "[DEM]"),
    ("PERSON", "Ann", "[PERSON]", "[PERSON]"),
    ("OTHER", "x", "[OTHER]", "[OTHER]"),
]


def test_ladders(spark):
    rows = spark.createDataFrame([(i, k, t) for i, (k, t, *_) in enumerate(LADDERS)], "i int, k string, t string").orderBy("i")
    got = rows.select(*[generalise(F.col("k"), F.col("t"), n) for n in range(4)]).collect()
    assert [tuple(r) for r in got] == [(t, one, two, f"[{k}]") for k, t, one, two in LADDERS]


NORMAL = [
    ("DATETIME", "12 March 2018", "2018"),
    ("DATETIME", "in 2018", "2018"),
    ("DATETIME", "1066", "1066"),
    ("DATETIME", "last  Tuesday!", "last tuesday"),
    ("QUANTITY", "47-year-old", "age:47"),
    ("QUANTITY", "47 year old", "age:47"),
    ("QUANTITY", "47-year old", "age:47"),
    ("QUANTITY", "aged 047", "age:47"),
    ("QUANTITY", "forty-seven", "47"),
    ("QUANTITY", "three children", "3 children"),
    ("QUANTITY", "zero", "0"),
    ("QUANTITY", "EUR 4.2 million", "eur 4.2 million"),
    ("QUANTITY", "many, many", "many many"),
    ("LOC", "Plovdiv,", "plovdiv"),
    ("DEM", "  Bulgarian  national ", "bulgarian national"),
    ("MISC", "L'État!", "l état"),
]


def test_normal_values(spark):
    rows = spark.createDataFrame([(i, k, t) for i, (k, t, _) in enumerate(NORMAL)], "i int, k string, t string").orderBy("i")
    assert [r[0] for r in rows.select(normalise(F.col("k"), F.col("t"))).collect()] == [v for *_, v in NORMAL]


def test_letters(spark):
    want = {0: "A", 25: "Z", 26: "AA", 27: "AB", 51: "AZ", 52: "BA", 701: "ZZ", 702: "AAA", 18277: "ZZZ", 18278: "AAAA"}
    assert {i: tokens.letters_of(i) for i in want} == want
    assert column(spark, list(want), tokens.letters, "int") == list(want.values())
    assert column(spark, [-1, None], tokens.letters, "int") == [None, None]
    with pytest.raises(ValueError):
        tokens.letters_of(-1)


def test_honorifics(spark):
    names = {"Mrs Petrova": "Petrova", "Dr. Mr Smith": "Smith", "Mr": "Mr", "Maria Petrova": "Maria Petrova", "Sir, X": "X", "Frank": "Frank", "MISS Y": "Y"}
    assert column(spark, list(names), tokens.without_honorifics) == list(names.values())


def test_word_parts(spark):
    pairs = [("ko", "kosovo", False), ("petrova", "maria petrova", True), ("a", "a", True), ("", "a", False), ("a.b", "x a.b y", True), ("a.b", "x acb y", False), ("é", "l é", True)]
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, n string, h string, w boolean").orderBy("i")
    assert [r[0] for r in rows.select(tokens.is_word_part(F.col("n"), F.col("h"))).collect()] == [w for *_, w in pairs]


def test_restore_is_one_pass(spark):
    vault = F.create_map(*map(F.lit, ("[PERSON_A]", "[PERSON_B]", "[PERSON_B]", "$1 \\x", "[ORG_A]", "Acme")))
    texts = ["[PERSON_A] met [PERSON_B] of [ORG_A].", "[PERSON] and [PERSON_Z] spoke", "", "no token", "[PERSON_B][ORG_A]"]
    assert column(spark, texts, lambda x: tokens.restore(x, vault)) == ["[PERSON_B] met $1 \\x of Acme.", "[PERSON] and [PERSON_Z] spoke", "", "no token", "$1 \\xAcme"]


def test_label_maps_and_roles(spark):
    spans = spark.sql("SELECT 'x Ann y' AS t, array(struct(2 AS start, 5 AS end, 'PER' AS label, 0.9D AS score), struct(0 AS start, 1 AS end, 'ZZZ' AS label, 0.9D AS score), struct(6 AS start, 7 AS end, 'LOC' AS label, 0.3D AS score)) AS s")
    got = spans.select(labels.mapped(F.col("s"), labels.CONLL, F.col("t"), labels.MIN_SCORE)).first()[0]
    assert [tuple(x) for x in got] == [(2, 5, "PERSON", "Ann")]
    kinds = ["PERSON", "ORG", "CODE", "MISC", "DATETIME", "LOC", "DEM", "QUANTITY", "NEW"]
    assert column(spark, kinds, labels.role) == ["DIRECT"] * 4 + ["QUASI"] * 4 + ["DIRECT"]
    assert column(spark, ["LOC", "DEM"], lambda x: labels.role(x, F.when(x == "LOC", "DIRECT"))) == ["DIRECT", "QUASI"]
