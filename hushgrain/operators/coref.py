"""Further mentions of people and organisations by shorter forms of their names."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql.functions import arrow_udf

from hushgrain.functions.tokens import HONORIFICS
from hushgrain.schema import SPANS

# Words too general to stand for a name.
GENERIC_ORG = frozenset((
    "ltd", "limited", "inc", "incorporated", "corp", "corporation",
    "co", "company", "plc", "llp", "llc", "gmbh", "ag", "sa", "bv",
    "holdings", "group", "international", "global", "industries",
    "the", "and", "of", "for", "&",
    "court", "tribunal", "council", "commission", "office", "ministry",
    "department", "agency", "association", "union", "federation",
))
GENERIC_PERSON = frozenset((
    "the", "and", "of", "a", "an", "his", "her", "their", "him", "she",
    "he", "they", "it", "its",
))
TITLES = ("Mr", "Mrs", "Ms", "Miss", "Dr")
MIN_LENGTH, CONFIDENCE = 3, 0.7
_TITLED = frozenset(HONORIFICS)


def bare(name: str) -> str:
    """A name without leading honorifics; the name itself if nothing is left."""
    words = name.split()
    first = next((i for i, w in enumerate(words) if w.lower().rstrip(".,") not in _TITLED), len(words))
    return " ".join(words[first:]) or name


def _distinctive(word: str, generic: frozenset[str]) -> bool:
    return len(word) >= MIN_LENGTH and word[0].isupper() and word.lower() not in generic


def short_forms(name: str, entity_type: str) -> list[str]:
    """Shorter forms of a name of two words or more, the longest first; without repeats."""
    words = bare(name).split()
    if len(words) < 2:
        return []
    if entity_type == "PERSON":
        surname = words[-1]
        forms = [w for w in (words[0], surname) if _distinctive(w, GENERIC_PERSON)]
        if _distinctive(surname, frozenset()):
            forms += [f"{title}{dot} {surname}" for title in TITLES for dot in ("", ".")]
    elif entity_type == "ORG":
        forms = [w for w in words if _distinctive(w, GENERIC_ORG)][:1]
        if len(words) > 2 and not GENERIC_ORG & {w.lower() for w in words[:2]}:
            forms.append(" ".join(words[:2]))
    else:
        return []
    return sorted(dict.fromkeys(forms), key=lambda f: -len(f))


def further_mentions(text: str, known: list[tuple[int, int, str, str]]) -> list[tuple[int, int, int]]:
    """(start, end, which known span it refers to) for each short form that stands alone in text.
    known: (start, end, entity type, text), in the order in which their forms are tried."""
    taken = [(a, b) for a, b, _, _ in known]
    out = []
    for parent, (_, _, kind, name) in enumerate(known):
        for form in short_forms(name, kind):
            if form not in text:
                continue
            for m in re.finditer(rf"\b{re.escape(form)}\b", text):
                a, b = m.span()
                if not any(a < y and b > x for x, y in taken):
                    taken.append((a, b))
                    out.append((a, b, parent))
    return out


def extend(text: Column, spans: Column) -> Column:
    """Spans and the further mentions of those that are people or organisations, by start. The scan
    depends on what it has found before, so it is one Arrow function."""

    @arrow_udf(SPANS)
    def run(texts: pa.Array, lists: pa.Array) -> pa.Array:
        out = []
        for x, own in zip(texts.to_pylist(), lists.to_pylist()):
            own = own or []
            more = further_mentions(x or "", [(s["start"], s["end"], s["entity_type"], s["text"]) for s in own])
            new = [own[p] | {"start": a, "end": b, "text": x[a:b], "source": "coref", "confidence": CONFIDENCE, "generalization_level": 0, "replacement": None} for a, b, p in more]
            out.append(sorted(own + new, key=lambda s: s["start"]))
        return pa.array(out, lists.type)

    return run(text, spans)
