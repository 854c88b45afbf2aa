"""Letters of pseudonym tokens, honorifics, and the way back from tokens to names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hushgrain.functions.text import find_all, splice

# Honorifics without their full stops.
HONORIFICS = ("mr", "mrs", "ms", "miss", "dr", "prof", "lord", "lady", "sir", "dame", "rev", "fr")
#: Letters of the greatest long.
_MOST_LETTERS = 14
TOKEN = "\\[[A-Z]+_[A-Z]+\\]"


def letters_of(index: int) -> str:
    """0 A, 25 Z, 26 AA: bijective base 26."""
    if index < 0:
        raise ValueError("an index may not be negative")
    out, rest = [], index + 1
    while rest:
        rest, digit = divmod(rest - 1, 26)
        out.append(chr(65 + digit))
    return "".join(reversed(out))


def letters(index: Column) -> Column:
    """letters_of as an expression, for any long; null if the index is null or negative."""
    step = lambda x: F.struct(F.concat(F.chr((F.lit(65) + F.pmod(x["left"], F.lit(26))).cast("long")), x["out"]).alias("out"), (F.floor(x["left"] / 26) - 1).alias("left"))
    begun = F.struct(F.lit("").alias("out"), index.cast("long").alias("left"))
    done = F.aggregate(F.sequence(F.lit(1), F.lit(_MOST_LETTERS)), begun, lambda acc, _: F.when(acc["left"] >= 0, step(acc)).otherwise(acc), lambda acc: acc["out"])
    return F.when(index >= 0, done)


def without_honorifics(form: Column) -> Column:
    """Words without leading honorifics; the form itself if nothing is left."""
    names = "|".join(HONORIFICS)
    words = F.regexp_replace(F.regexp_replace(form, "(?U)^\\s+|\\s+$", ""), "(?U)\\s+", " ")
    left = F.regexp_replace(words, f"(?iU)^(?:(?:{names})[.,]*(?: |$))+", "")
    return F.when(left == "", form).otherwise(left)


def is_word_part(needle: Column, haystack: Column) -> Column:
    """Whether needle is haystack or stands in it at word boundaries."""
    quoted = F.concat(F.lit("(?U)\\b"), F.regexp_replace(needle, "(?U)([^\\w\\s])", "\\\\$1"), F.lit("\\b"))
    return (needle == haystack) | ((needle != "") & (haystack != "") & F.regexp_like(haystack, quoted))


def restore(text: Column, vault: Column) -> Column:
    """Each known token becomes its name, once; unknown tokens stay. vault: map<token, name>."""
    return splice(text, F.transform(find_all(text, TOKEN), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.try_element_at(vault, m["text"]).alias("replacement"))))
