"""Span detection: pattern recognisers, pluggable detectors, merging, overlaps and roles.

Everything here is a column expression on one document, so detection is a narrow stage without a
shuffle. Detectors are functions from a text column to an array of predicted spans; a model runs
behind the same interface as an Arrow function.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from hushgrain.functions.generalise import CITY_COUNTRY, DEM_BROADER
from hushgrain.functions.labels import MIN_SCORE, PRESIDIO, mapped, role
from hushgrain.functions.text import apart, empty, find_all, overlaps, sorted_by, without_overlaps
from hushgrain.operators.coref import extend
from hushgrain.schema import PREDICTED, SPAN, SPANS

Detector = Callable[[Column], Column]

# The recognisers in order of precedence, with what a text must hold to match at all.
RECOGNISERS = (
    ("case_number", "\\b(?:Application|App\\.?|Case)\\s+[Nn]o\\.?\\s*\\d{1,7}/\\d{2,4}\\b", "CODE", "/"),
    ("nhs_number", "\\b\\d{3}[\\s\\-]?\\d{3}[\\s\\-]?\\d{4}\\b", "CODE", None),
    ("iban", "\\b[A-Z]{2}\\d{2}[\\s\\-]?(?:[A-Z0-9]{4}[\\s\\-]?){2,7}[A-Z0-9]{1,4}\\b", "CODE", None),
    ("email", "\\b[\\w._%+\\-]+@[\\w.\\-]+\\.[A-Za-z]{2,}\\b", "MISC", "@"),
    ("phone", "(?:\\+\\d{1,3}\\s?)?(?:\\(\\d{1,4}\\)\\s?|\\d{1,4}[\\s\\-]?)\\d{3,4}[\\s\\-]?\\d{3,4}\\b", "MISC", None),
)
#: Score of a case number that the analyser's own recogniser finds.
CASE_NUMBER_SCORE = 0.85
#: Order of sources when spans start together and are equally long.
SOURCE_ORDER = ("regex", "ner", "coref", "manual")


def span(found: Column, entity_type: Column, source: str, confidence: float | None) -> Column:
    """A pipeline span from a struct with start, end and text."""
    return F.struct(
        found["start"].alias("start"),
        found["end"].alias("end"),
        entity_type.alias("entity_type"),
        found["text"].alias("text"),
        F.lit("DIRECT").alias("identifier_role"),
        F.lit(source).alias("source"),
        F.lit(confidence).cast("double").alias("confidence"),
        F.lit(0).alias("generalization_level"),
        F.lit(None).cast("string").alias("replacement"),
    ).cast(SPAN)


def recognise(text: Column, name: str) -> Column:
    """All matches of one recogniser. Texts that can't match aren't searched."""
    _, pattern, _, needed = next(r for r in RECOGNISERS if r[0] == name)
    possible = text.contains(needed) if needed else text.rlike("(?U)\\d{3}|\\d{2}[\\s\\-]?[A-Z0-9]{4}")
    return F.when(possible, find_all(text, pattern)).otherwise(empty("array<struct<start:int,end:int,text:string>>"))


def regex_pass(text: Column, recognisers: tuple[str, ...] | None = None) -> Column:
    """Spans of all recognisers, sorted; of overlapping ones the earlier recogniser's stays."""
    found = [_typed(recognise(text, name), kind) for name, _, kind, _ in RECOGNISERS if recognisers is None or name in recognisers]
    return sorted_by(without_overlaps(F.concat(*found), SPANS), lambda s: s["start"])


def _typed(found: Column, kind: str) -> Column:
    return F.transform(found, lambda m: span(m, F.lit(kind), "regex", 1.0))


def merge(ner: Column, regex: Column) -> Column:
    """Regex spans, and the NER spans that overlap none of them, by start."""
    free = F.filter(ner, lambda n: ~F.exists(regex, lambda r: overlaps(n, r)))
    return sorted_by(F.concat(regex, free), lambda s: s["start"])


def dedupe(spans: Column) -> Column:
    """Of overlapping spans the one that starts first stays; then the longest; then by source."""
    rank = F.create_map(*[x for i, s in enumerate(SOURCE_ORDER) for x in (F.lit(s), F.lit(i))])
    ordered = sorted_by(spans, lambda s: s["start"], lambda s: s["start"] - s["end"], lambda s: F.coalesce(F.try_element_at(rank, s["source"]), F.lit(len(SOURCE_ORDER))))
    return without_overlaps(ordered, SPANS)


def as_pipeline(predicted: Column, source: str = "ner") -> Column:
    """Predicted spans as pipeline spans; null is none."""
    return F.transform(F.coalesce(predicted, empty(f"array<{PREDICTED}>")), lambda p: span(p, p["entity_type"], source, None))


def with_roles(spans: Column, override: Callable[[Column], Column] | None = None) -> Column:
    """override: a function of the span that returns a role or null."""
    return F.transform(spans, lambda s: s.withField("identifier_role", role(s["entity_type"], override(s) if override else None)))


def detect_spans(docs: DataFrame, detector: Detector | None = None, use_regex: bool = True, use_coref: bool = True, override: Callable[[Column], Column] | None = None) -> DataFrame:
    """docs (with text) and `spans`: detector, recognisers, merging, coreference, overlaps, roles. A
    null or empty text has none. Narrow; each step that runs Python is a column of its own."""
    text = F.coalesce("text", F.lit(""))
    found = docs.withColumn("_ner", as_pipeline(detector(text)) if detector else empty(SPANS))
    found = found.withColumn("_regex", regex_pass(text) if use_regex else empty(SPANS))
    found = found.withColumn("_merged", merge(F.col("_ner"), F.col("_regex")))
    spans = F.col("_merged")
    if use_coref:
        found = found.withColumn("_merged", apart(F.col("_merged")))
        found = found.withColumn("_merged", extend(F.col("text"), F.col("_merged")))
    return found.withColumn("spans", with_roles(dedupe(F.col("_merged")), override)).drop("_ner", "_regex", "_merged")


def unmapped(spans: Column) -> tuple[Column, Column]:
    """Spans with an entity type, and spans without one."""
    return F.filter(spans, lambda s: s["entity_type"].isNotNull()), F.filter(spans, lambda s: s["entity_type"].isNull())


# Detectors


def patterns(*kinds: tuple[str, str]) -> Detector:
    """(pattern, entity type) pairs; overlapping spans of later pairs are dropped."""

    def run(text: Column) -> Column:
        def typed(pattern: str, kind: str) -> Column:
            return F.transform(find_all(text, pattern), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.lit(kind).alias("entity_type"), m["text"].alias("text")))

        found = F.concat(*[typed(p, k) for p, k in kinds])
        return sorted_by(without_overlaps(found, f"array<{PREDICTED}>"), lambda s: s["start"])

    return run


def _any_of(words) -> str:
    names = sorted(words, key=lambda w: (-len(w), w))
    return "\\b(?i:" + "|".join(w.replace(".", "\\.") for w in names) + ")\\b"


def rule_detector() -> Detector:
    """Titles with names, firms, places, demographic terms, dates, ages and amounts. It stands in
    for a model and makes no claim to a model's quality."""
    name = "\\p{Lu}\\p{Ll}+"
    return patterns(
        (f"\\b(?:Mr|Mrs|Ms|Miss|Dr|Prof|Sir|Lord|Lady)\\.? {name}(?: {name})*", "PERSON"),
        (f"\\b(?:{name} )+(?:Ltd|Limited|Inc|Corp|plc|LLP|GmbH|Court|Tribunal|Ministry)\\b", "ORG"),
        ("\\b(?:\\d{1,2} (?:January|February|March|April|May|June|July|August|September|October|November|December) )?(?:1[5-9]\\d{2}|20\\d{2})\\b", "DATETIME"),
        ("\\b\\d{1,3}[ -]years?[ -]old\\b|[£€$]\\d[\\d,.]*\\d", "QUANTITY"),
        (_any_of(CITY_COUNTRY), "LOC"),
        (_any_of(DEM_BROADER), "DEM"),
    )


def analyser(propose: Callable[[Column], Column] | None = None, case_numbers: bool = True, min_score: float = MIN_SCORE) -> Detector:
    """A scoring analyser in the PRESIDIO scheme: propose returns array<struct<start, end, label,
    score>>. case_numbers adds a recogniser of case numbers with a fixed score."""

    def run(text: Column) -> Column:
        kind = "array<struct<start:int,end:int,label:string,score:double>>"
        found = propose(text).cast(kind) if propose else empty(kind)
        if case_numbers:
            own = F.transform(recognise(text, "case_number"), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.lit("CASE_NUMBER").alias("label"), F.lit(CASE_NUMBER_SCORE).alias("score")))
            found = F.concat(found, own)
        return sorted_by(mapped(found, PRESIDIO, text, min_score), lambda s: s["start"])

    return run


def model_detector(load: Callable[[], Callable[[str], list[tuple[int, int, str, str]]]]) -> Detector:
    """A detector in Python. load() is called once in each worker and returns text -> spans; a text
    on which it fails has no spans."""
    kept: dict = {}
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("entity_type", pa.string()), ("text", pa.string())]))

    @arrow_udf(f"array<{PREDICTED}>")
    def run(texts: pa.Array) -> pa.Array:
        import logging

        if "model" not in kept:
            kept["model"] = load()
        out = []
        for x in texts.to_pylist():
            try:
                found = kept["model"](x) if x else []
            except Exception:
                logging.getLogger("hushgrain").exception("a detector failed; the document has no spans of it")
                found = []
            out.append([{"start": a, "end": b, "entity_type": t, "text": w} for a, b, t, w in found])
        return pa.array(out, kind)

    return run


def spans_table(docs: DataFrame, spans: DataFrame, model: str, name: str = "predicted") -> DataFrame:
    """docs with the spans that a table (doc_id, model, spans) holds for one model."""
    own = spans.where(F.col("model") == model).select("doc_id", F.col("spans").alias(name))
    return docs.join(own, "doc_id", "left")


def located(text: str, needles: list[tuple[str, str]]) -> list[tuple[int, int, str, str]]:
    """Spans of curated (needle, type) pairs for fixtures: the first place of each that is free and
    doesn't touch a letter or digit. Needles that have none are left out."""
    out: list[tuple[int, int, str, str]] = []
    for needle, kind in needles:
        at = text.find(needle) if needle else -1
        while at >= 0:
            end = at + len(needle)
            alone = not (at and text[at - 1].isalnum()) and not (end < len(text) and text[end].isalnum())
            if alone and not any(at < b and end > a for a, b, _, _ in out):
                out.append((at, end, kind, needle))
                break
            at = text.find(needle, at + 1)
    return sorted(out)


_REGISTRY: dict[str, Callable[[str | None], Detector]] = {"rules": lambda _: rule_detector()}


def register(name: str, make: Callable[[str | None], Detector]) -> None:
    """make takes a model's name or path, or None."""
    _REGISTRY[name] = make


def detector(*names: str, model: str | None = None) -> Detector:
    """The first of some detectors, by name, that is registered and whose library is installed; raises if
    none is. model: which of the detector's models."""
    missing = []
    for n in names:
        if n not in _REGISTRY:
            missing.append(f"{n}: unknown")
            continue
        try:
            return _REGISTRY[n](model)
        except ImportError as e:
            missing.append(f"{n}: {e}")
    raise KeyError(f"no detector ({'; '.join(missing)}); there are {sorted(_REGISTRY)}")
