"""Command line: redact one document or a folder of them, and restore names from a vault."""

from __future__ import annotations

import argparse
import json
import os
import sys
from collections.abc import Iterator
from contextlib import nullcontext
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushgrain.functions.tokens import restore
from hushgrain.operators import adapters, detect, redact, risk  # noqa: F401 (adapters register their detectors)
from hushgrain.sources import readers, writers


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="hushgrain", description="Redact identifying information in text.")
    commands = top.add_subparsers(dest="command", required=True)
    r = commands.add_parser("redact", help="redact a text file, a folder of them, or - for standard input")
    r.add_argument("file")
    r.add_argument("--variant", choices=("lite", "pro"), default="lite")
    r.add_argument("--ner", default="rules", help="a registered detector (rules, spacy, hf, finetuned), or none; several, with commas: the first that is installed")
    r.add_argument("--ner-model", help="name or path of the detector's model")
    r.add_argument("--no-regex", action="store_true")
    r.add_argument("--no-coref", action="store_true")
    r.add_argument("--k-target", type=int, default=5)
    r.add_argument("--max-iterations", type=int, default=5)
    r.add_argument("--mosaic-haystack", default="empty", help="annotated documents (JSON lines), tab for those in TAB_PATH, or empty")
    r.add_argument("--pseudonymise", "--pseudonymize", action="store_true")
    r.add_argument("--vault-out", help="write the vault here; implies --pseudonymise")
    r.add_argument("--json", action="store_true", help="print results as JSON")
    b = commands.add_parser("restore", help="put names back into a text")
    b.add_argument("file")
    b.add_argument("--vault", required=True)
    return top


def documents(spark: SparkSession, file: str) -> DataFrame:
    if file == "-":
        return spark.createDataFrame([("stdin", sys.stdin.read())], "doc_id string, text string")
    return readers.text_files(spark, file, "*")


def haystack(spark: SparkSession, named: str) -> DataFrame:
    if named == "empty":
        return spark.createDataFrame([], "signature array<struct<entity_type:string,value:string>>, cnt long")
    path = os.environ.get("TAB_PATH", "") if named == "tab" else named
    if not path:
        raise SystemExit("--mosaic-haystack tab needs the annotated documents' path in TAB_PATH")
    return risk.haystack(readers.annotated(spark, path))


def run_redact(spark: SparkSession, args: argparse.Namespace) -> Iterator[str]:
    """The lines to print, one document after another; writes the vault beside if asked to."""
    pseudonymise = args.pseudonymise or bool(args.vault_out)
    found = None if args.ner == "none" else detect.detector(*args.ner.split(","), model=args.ner_model)
    docs = detect.detect_spans(documents(spark, args.file), found, not args.no_regex, not args.no_coref)
    if args.variant == "pro":
        done = redact.pro(docs, haystack(spark, args.mosaic_haystack), args.k_target, args.max_iterations, pseudonymise)
        audit = redact.pro_audit(done, args.k_target, args.max_iterations, pseudonymise)
        order = ("phase", "pos")
    else:
        done = redact.lite(docs, pseudonymise)
        audit = redact.lite_audit(done, pseudonymise)
        order = ("seq",)
    names = ("start", "end", "entity_type", "original_text", "action", "rationale", "iteration", "replacement")
    entries = audit.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*order, *names))).alias("e"))
    entries = entries.select("doc_id", F.transform("e", lambda e: F.struct(*[e[n].alias(n) for n in names])).alias("audit"))
    rows = done.join(entries, "doc_id", "left").orderBy("doc_id").select("*", writers.as_json("audit").alias("as_json")).toLocalIterator()
    with Vaults(args.vault_out) if args.vault_out else nullcontext() as vaults:
        for r in rows:
            if args.variant == "pro":
                print(f"{r.doc_id}: k {r.mosaic_risk_initial} -> {r.mosaic_risk_final}, {r.iterations_used} iterations, {'converged' if r.converged else 'not converged'}", file=sys.stderr)
            if vaults:
                vaults.add(r.doc_id, {v.token: v.original for v in r.vault})
            yield r.as_json if args.json else r.redacted_text


class Vaults:
    """A JSON file of vaults, written one by one: the vault of a single document, or an object of vaults by
    document."""

    def __init__(self, path: str):
        self.path, self.n, self.first = path, 0, None

    def __enter__(self) -> Vaults:
        self.file = open(self.path, "w", encoding="utf-8")
        return self

    def add(self, doc_id: str, vault: dict[str, str]) -> None:
        own = f"{json.dumps(doc_id, ensure_ascii=False)}: {json.dumps(vault, ensure_ascii=False, indent=2)}"
        if self.n == 0:
            self.first = own, vault
        elif self.n == 1:
            self.file.write("{\n" + self.first[0] + ",\n" + own)
        else:
            self.file.write(",\n" + own)
        self.n += 1

    def __exit__(self, *_) -> None:
        self.file.write(json.dumps(self.first[1] if self.n else {}, ensure_ascii=False, indent=2) if self.n < 2 else "\n}")
        self.file.close()


def run_restore(spark: SparkSession, args: argparse.Namespace) -> Iterator[str]:
    vault = json.loads(Path(args.vault).read_text(encoding="utf-8"))
    if not isinstance(vault, dict):
        raise SystemExit("a vault is a JSON object")
    entries = F.from_json(F.lit(json.dumps(vault)), "map<string,string>")
    return (r[0] for r in documents(spark, args.file).orderBy("doc_id").select(restore(F.col("text"), entries)).toLocalIterator())


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("hushgrain").getOrCreate()
    for line in (run_redact if args.command == "redact" else run_restore)(spark, args):
        print(line)
    return 0


if __name__ == "__main__":
    sys.exit(main())
