"""Label maps of foreign detectors, and identifier roles."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Which entity type each label of a foreign scheme means.
ONTONOTES = {
    "PERSON": "PERSON",
    "ORG": "ORG",
    "GPE": "LOC", "LOC": "LOC", "FAC": "LOC",
    "DATE": "DATETIME", "TIME": "DATETIME",
    "QUANTITY": "QUANTITY", "CARDINAL": "QUANTITY", "MONEY": "QUANTITY", "PERCENT": "QUANTITY", "ORDINAL": "QUANTITY",
    "NORP": "DEM",
    "LAW": "MISC", "EVENT": "MISC", "PRODUCT": "MISC", "WORK_OF_ART": "MISC", "LANGUAGE": "MISC",
}
CONLL = {"PER": "PERSON", "ORG": "ORG", "LOC": "LOC", "MISC": "MISC"}
PRESIDIO = {"PERSON": "PERSON", "LOCATION": "LOC", "ORGANIZATION": "ORG", "DATE_TIME": "DATETIME", "NRP": "DEM", "CASE_NUMBER": "CODE"}
# The role of each entity type.
ROLES = {
    "PERSON": "DIRECT", "ORG": "DIRECT", "CODE": "DIRECT", "MISC": "DIRECT",
    "DATETIME": "QUASI", "LOC": "QUASI", "DEM": "QUASI", "QUANTITY": "QUASI",
}
#: Least score of a span that a scoring analyser proposes.
MIN_SCORE = 0.4


def lookup(key: Column, values: dict[str, str]) -> Column:
    """The value of a key, null if there is none."""
    return F.try_element_at(F.create_map(*map(F.lit, chain.from_iterable(values.items()))), key)


def mapped(spans: Column, labels: dict[str, str], text: Column | None = None, min_score: float | None = None) -> Column:
    """Spans of foreign labels (start, end, label, text or score) as predicted spans; unmapped labels
    and low scores are dropped. text: the document, if the spans' texts are to be cut from it."""
    kept = spans if min_score is None else F.filter(spans, lambda s: s["score"] >= min_score)
    typed = F.transform(
        kept,
        lambda s: F.struct(
            s["start"].alias("start"),
            s["end"].alias("end"),
            lookup(s["label"], labels).alias("entity_type"),
            (s["text"] if text is None else F.substring(text, s["start"] + 1, s["end"] - s["start"])).alias("text"),
        ),
    )
    return F.filter(typed, lambda s: s["entity_type"].isNotNull())


def role(entity_type: Column, override: Column | None = None) -> Column:
    """An override that isn't null, else the type's role; unknown types are DIRECT."""
    return F.coalesce(*([override] if override is not None else []), lookup(entity_type, ROLES), F.lit("DIRECT"))
