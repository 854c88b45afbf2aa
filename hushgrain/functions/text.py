"""Column functions on text and on arrays of spans. Offsets are code points, ends exclusive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_MARK = "\u0001"
#: What a mark that is already in a text becomes: one character as well, so that no offset moves.
_STAND_IN = "\u0002"
#: Parts of a text that one fold goes over.
_BLOCK = 256
FOUND = "array<struct<start:int,end:int,text:string>>"


def empty(kind: str) -> Column:
    return F.array().cast(kind)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often use needs it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def find_all(text: Column, pattern: str) -> Column:
    """All matches of a pattern, leftmost first, as array<struct<start, end, text>>.

    Matches are put between marks and the text is split there, so every second part is a match. Lengths
    are added up in blocks of _BLOCK parts, which start from the blocks' own sums: a fold that appends to
    an array copies it each time, so none runs over more than a block. The pattern is read with Unicode
    classes; it may have no capturing group and may not match nothing.
    """
    marked = F.regexp_replace(F.translate(text, _MARK, _STAND_IN), f"(?U)(?:{pattern})", f"{_MARK}$0{_MARK}")
    none = F.struct(F.lit(0).cast("int").alias("at"), empty(FOUND).alias("out"))

    def grow(acc: Column, p: Column) -> Column:
        end = (acc["at"] + F.length(p["text"])).cast("int")
        found = F.concat(acc["out"], F.array(F.struct(acc["at"].alias("start"), end.alias("end"), p["text"].alias("text"))))
        return F.struct(end.alias("at"), F.when(p["hit"], found).otherwise(acc["out"]).alias("out"))

    def block(parts: Column, start: Column) -> Column:
        return F.aggregate(parts, F.struct(start.cast("int").alias("at"), empty(FOUND).alias("out")), grow, lambda acc: acc["out"])

    def in_blocks(parts: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / _BLOCK).cast("int")), lambda k: F.slice(parts, k * _BLOCK + 1, F.lit(_BLOCK)))
        sums = F.transform(blocks, lambda x: F.aggregate(x, F.lit(0), lambda n, p: n + F.length(p["text"])))
        begun = F.aggregate(sums, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])
        return F.flatten(F.zip_with(blocks, begun, block))

    parts = F.transform(F.split(marked, _MARK, -1), lambda p, i: F.struct(p.alias("text"), (i % 2 == 1).alias("hit")))
    return let(parts, lambda x: F.when(F.size(x) <= _BLOCK, F.aggregate(x, none, grow, lambda acc: acc["out"])).otherwise(in_blocks(x)))


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, "(?U)^\\s+|\\s+$", "")


def blank(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike("(?U)^\\s*$")


def overlaps(a: Column, b: Column) -> Column:
    """Touching spans don't overlap."""
    return (a["start"] < b["end"]) & (a["end"] > b["start"])


def sorted_by(spans: Column, *keys) -> Column:
    """A stable sort of an array of structs by functions of its elements."""
    keyed = F.transform(spans, lambda s, i: F.struct(*[k(s).alias(f"k{n}") for n, k in enumerate(keys)], i.alias("i"), s.alias("s")))
    return F.transform(F.array_sort(keyed), lambda x: x["s"])


def without_overlaps(spans: Column, kind: str) -> Column:
    """Keeps each span that overlaps none kept before it."""
    return F.aggregate(spans, empty(kind), lambda acc, s: F.when(F.exists(acc, lambda x: overlaps(x, s)), acc).otherwise(F.concat(acc, F.array(s))))


def splice(text: Column, spans: Column) -> Column:
    """The text with each span's replacement in its place; a null replacement leaves the span as it
    is. spans: sorted by start, without overlaps."""

    def put(own: Column) -> Column:
        def piece(s: Column, i: Column) -> Column:
            before = F.coalesce(F.get(own, i - 1)["end"], F.lit(0))
            return F.concat(F.substring(text, before + 1, s["start"] - before), F.coalesce(s["replacement"], F.substring(text, s["start"] + 1, s["end"] - s["start"])))

        last = F.coalesce(F.get(own, F.size(own) - 1)["end"], F.lit(0))
        return F.concat(F.array_join(F.transform(own, piece), ""), F.substring(text, last + 1, F.length(text)))

    return let(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["replacement"].alias("replacement"))), put)


def context(text: Column, start: Column, end: Column, width: int = 60) -> Column:
    """The span with up to width characters on either side."""
    first = F.greatest(F.lit(0), start - width)
    return F.substring(text, first + 1, end + width - first)


def apart(column: Column) -> Column:
    """The same values, in a column that Spark doesn't fold into the expressions that use it. A Python
    function must not have nested higher-order functions among its arguments: Spark then fails to
    take it out of the expression. The condition always holds, but isn't deterministic to Spark."""
    return F.when(F.rand(0) + 1 > 0, column)
