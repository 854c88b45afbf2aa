"""Reversible pseudonyms: the same token for all forms of a name within a document."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from hushgrain.functions.text import find_all, splice
from hushgrain.functions.tokens import letters, letters_of
from hushgrain.operators.coref import bare


def _part_of(a: str, b: str) -> bool:
    return a == b or bool(a and b and re.search(rf"\b{re.escape(a)}\b", b))


@dataclass
class Pseudonyms:
    """One document's tokens. A new form takes the token of the first known form of its type that it
    is a part of, or that is a part of it, honorifics and case aside; else it gets the next token.
    The vault holds the longest form of each token, the earliest of equally long ones."""

    vault: dict[str, str] = field(default_factory=dict)
    forms: dict[str, dict[str, tuple[str, str]]] = field(default_factory=dict)  # type -> form -> (bare form, token)
    minted: dict[str, int] = field(default_factory=dict)

    def token(self, entity_type: str, form: str) -> str:
        form = form.strip()
        if not form:
            raise ValueError("a name may not be empty")
        known = self.forms.setdefault(entity_type, {})
        if form in known:
            found = known[form][1]
        else:
            key = bare(form).lower()
            found = next((t for other, t in known.values() if _part_of(key, other) or _part_of(other, key)), None)
            if found is None:
                index = self.minted.get(entity_type, 0)
                self.minted[entity_type] = index + 1
                found = f"[{entity_type}_{letters_of(index)}]"
            known[form] = key, found
        if len(form) > len(self.vault.get(found, "")):
            self.vault[found] = form
        return found


_ENTRY = "struct<token:string,original:string>"
RESULT = f"struct<tokens:array<string>,vault:array<{_ENTRY}>>"


def pseudonyms(spans: Column) -> Column:
    """For an array of spans of one document, in order: the token of each DIRECT span (null for
    others) and the vault's entries. Blank names have no token."""
    entry = pa.list_(pa.struct([("token", pa.string()), ("original", pa.string())]))

    @arrow_udf(RESULT)
    def run(lists: pa.Array) -> pa.Array:
        tokens, vaults = [], []
        for own in lists.to_pylist():
            p = Pseudonyms()
            tokens.append([p.token(s["entity_type"], s["text"]) if s["identifier_role"] == "DIRECT" and s["text"].strip() else None for s in own or []])
            vaults.append([{"token": t, "original": o} for t, o in p.vault.items()])
        return pa.StructArray.from_arrays([pa.array(tokens, pa.list_(pa.string())), pa.array(vaults, entry)], names=["tokens", "vault"])

    return run(spans)


def vault_table(redacted: DataFrame) -> DataFrame:
    """(doc_id, token, original) of redacted documents; to be kept apart from their texts."""
    return redacted.select("doc_id", F.explode("vault").alias("v")).select("doc_id", "v.token", "v.original")


def vault_map(vaults: DataFrame) -> DataFrame:
    """(doc_id, vault as a map) of a vault table."""
    return vaults.groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("token", "original")))).alias("vault"))


def slots(names: Column, vault: Column, kinds: tuple[str, ...] = ("PERSON", "ORG")) -> Column:
    """map<slot, token> for answers written in slots such as PERSON_A. names: array<struct<text,
    entity_type>> in order of appearance; the tokens that they have in the vault (array of entries,
    whatever their case) take a type's letters in the order in which they first appear."""
    token = lambda n: F.try_element_at(F.transform(F.filter(vault, lambda v: F.lower(v["original"]) == F.lower(n["text"])), lambda v: v["token"]), F.lit(1))

    def of(kind: str) -> Column:
        found = F.array_distinct(F.array_compact(F.transform(F.filter(names, lambda n: n["entity_type"] == kind), token)))
        return F.transform(found, lambda t, i: F.struct(F.concat(F.lit(f"{kind}_"), letters(i)).alias("key"), t.alias("value")))

    return F.map_from_entries(F.concat(*map(of, kinds)))


def filled(template: Column, slot_map: Column) -> Column:
    """A template with each {SLOT} replaced by its token, or by the slot in brackets if it has none."""
    found = find_all(template, "\\{[A-Z]+_[A-Z]+\\}")
    name = lambda m: F.substring(m["text"], F.lit(2), F.length(m["text"]) - 2)
    put = lambda m: F.coalesce(F.try_element_at(slot_map, name(m)), F.concat(F.lit("["), name(m), F.lit("]")))
    return splice(template, F.transform(found, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), put(m).alias("replacement"))))
