"""Every query with SQL against that SQL, on the smallest tables; and what the driver needs."""

import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from hushgrain.plans import oracles
from hushgrain.plans.queries import QUERIES

ROOT = Path(__file__).resolve().parent.parent
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def shown(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    text = lambda v: "NULL" if v is None or v is pd.NaT or v is pd.NA or v != v else f"{v:.6f}" if isinstance(v, float) else str(v)
    return sorted(tuple(text(v) for v in row) for row in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(__spark_entry__.oracle_sql()))
def test_query_is_its_sql(spark, duck, name):
    got, want = __spark_entry__.queries()[name](spark, SF).toPandas(), duck.sql(__spark_entry__.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert shown(got) == shown(want)


def test_all_queries_have_sql():
    assert set(QUERIES) == set(oracles.SQL)


def test_strategies_agree_with_their_parts(spark):
    both = {(r.strategy, r.mode): (r.tp, r.fp, r.fn) for r in QUERIES["combiner_comparison"](spark, SF).collect()}
    alone = {(f"{r.model}_alone", r.mode): (r.tp, r.fp, r.fn) for n in ("eval_exact", "eval_partial") for r in QUERIES[n](spark, SF).collect() if r.entity_type == "_ALL"}
    assert alone.items() <= both.items() and len(both) == 14
    assert len({tp + fn for tp, _, fn in both.values()}) == 1


def test_coreference_raises_recall(spark):
    got = {r.label: r for r in QUERIES["mention_recall_coref"](spark, SF).collect()}
    assert got["coref"].n_mentions == got["baseline"].n_mentions and got["coref"].micro_recall > got["baseline"].micro_recall


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 200


def test_without_the_llm_subpackage(tmp_path):
    copy = tmp_path / "repo"
    subprocess.run(["cp", "-r", str(ROOT), str(copy)], check=True)
    subprocess.run(["rm", "-rf", str(copy / "hushgrain/llm"), str(copy / "tests/llm"), str(copy / "corpus_pipeline.py")], check=True)
    env = {"PATH": os.environ["PATH"], "PYTHONPATH": str(copy)}
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and 'lite_redact' in q and not any(x.startswith('op') for x in q); assert set(e.oracle_sql()) == set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=copy, env=env, check=True)
    tests = ["tests/test_functions.py", "tests/test_operators.py", "-k", "not stream and not command"]
    subprocess.run([sys.executable, "-m", "pytest", "-x", "-q", *tests], cwd=copy, env=env, check=True)
