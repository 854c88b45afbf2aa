"""Canonical values of quasi-identifiers, so that equal facts meet."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hushgrain.functions.text import empty, strip

# Spelt cardinals and the patterns of years and ages.
CARDINALS = {
    "zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6,
    "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12,
    "thirteen": 13, "fourteen": 14, "fifteen": 15, "sixteen": 16,
    "seventeen": 17, "eighteen": 18, "nineteen": 19,
    "twenty": 20, "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60,
    "seventy": 70, "eighty": 80, "ninety": 90,
}
YEAR = "(?U)\\b(1[5-9]\\d{2}|20\\d{2})\\b"
AGE = "(?U)\\b(\\d{1,3})\\s*[- ]?\\s*year[s]?[- ]?old\\b|\\baged\\s+(\\d{1,3})\\b"


def _collapsed(text: Column, kept: str = "") -> Column:
    """Punctuation becomes space, runs of space one space."""
    return strip(F.regexp_replace(F.regexp_replace(text, f"(?U)[^\\w\\s{kept}]+", " "), "(?U)\\s+", " "))


def _spelt(text: Column) -> Column:
    """Leading cardinal words are added up and the rest kept; null without such a word."""
    words = F.split(text, "(?U)[\\s-]+")
    values = F.create_map(*[F.lit(x) for kv in CARDINALS.items() for x in kv])
    start = F.struct(F.lit(0).alias("total"), F.lit(True).alias("leading"), F.lit(False).alias("some"), empty("array<string>").alias("rest"))

    def step(acc: Column, w: Column) -> Column:
        value = F.when(acc["leading"], F.try_element_at(values, w))
        rest = F.when(value.isNull(), F.concat(acc["rest"], F.array(w))).otherwise(acc["rest"])
        return F.struct((acc["total"] + F.coalesce(value, F.lit(0))).alias("total"), value.isNotNull().alias("leading"), (acc["some"] | value.isNotNull()).alias("some"), rest.alias("rest"))

    return F.aggregate(words, start, step, lambda a: F.when(a["some"], strip(F.concat_ws(" ", a["total"].cast("string"), F.array_join(a["rest"], " ")))))


def normalise(entity_type: Column, text: Column) -> Column:
    """The canonical value of one fact."""
    t = F.lower(strip(text))
    year = F.regexp_extract(t, YEAR, 1)
    age = F.concat(F.regexp_extract(t, AGE, 1), F.regexp_extract(t, AGE, 2))
    quantity = (
        F.when(age != "", F.concat(F.lit("age:"), F.coalesce(age.try_cast("int").cast("string"), age)))
        .when(t.rlike("(?U)\\d"), _collapsed(t, "."))
        .otherwise(F.coalesce(_spelt(t), _collapsed(t)))
    )
    return F.when((entity_type == "DATETIME") & (year != ""), year).when(entity_type == "QUANTITY", quantity).otherwise(_collapsed(t))
