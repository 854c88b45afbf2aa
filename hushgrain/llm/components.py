"""Connected components of a table of links, by alternating large-star and small-star steps.

Every step is a grouped minimum (combined before the shuffle) and an equi-join, whose skewed side
Spark may split; no vertex's neighbours are gathered in one task. Each round is cut from its
lineage by a written table, so a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushgrain.llm.runtime import drop, table


def _to_least(pairs: DataFrame) -> DataFrame:
    """(u, v) -> (v, least of u and its neighbours v), and (u, that least)."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(least, "u")


def components(links: DataFrame) -> DataFrame:
    """links: (u, v), both long, no nulls. Returns (node, label): label is the least node of its
    component. Nodes without links don't occur. Converges in about log2(longest path) rounds."""
    edges = table(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _to_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _to_least(large)
        own = small.select("u", F.col("m").alias("v"))
        others = small.select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = table(own.unionByName(others).where("u <> v").distinct(), "links")
        mark = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop(edges)
        edges = new
        if mark == before:
            break
        before = mark
    roots = edges.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("label"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots)
