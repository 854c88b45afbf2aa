"""Schemas of documents, mentions, spans and result tables."""

from __future__ import annotations

from pyspark.sql import types as T

ENTITY_TYPES = ("PERSON", "ORG", "LOC", "DATETIME", "QUANTITY", "CODE", "DEM", "MISC")
#: Pseudo-type of totals over all entity types.
ALL = "_ALL"

MENTION = "struct<start_offset:int,end_offset:int,entity_type:string,span_text:string,identifier_type:string,entity_id:string>"
#: An annotated document: one row for each annotator.
ANNOTATED = f"doc_id string, annotator_id string, split string, text string, entity_mentions array<{MENTION}>"
#: What a detector returns.
PREDICTED = "struct<start:int,end:int,entity_type:string,text:string>"
#: A span within a pipeline.
SPAN = "struct<start:int,end:int,entity_type:string,text:string,identifier_role:string,source:string,confidence:double,generalization_level:int,replacement:string>"
SPANS = f"array<{SPAN}>"
#: One row of the prediction cache: a model's spans of a document, in the model's order.
CACHE = f"doc_id string, model string, spans array<{PREDICTED}>"
RESULTS = "model string, mode string, entity_type string, precision double, recall double, f1 double, tp bigint, fp bigint, fn bigint"


def struct(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)
