"""SimHash, kNN join and URL rules against brute force, and their edge cases."""

import math
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from hushgrain.llm import components, knn, queries, simhash, url_rules

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
DATA = "/root/testdata/sf0.001"


def plain_fingerprint(text, k=3):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    """doc_id -> least doc_id reachable over fingerprints at 3 bits or fewer."""
    least = {i: d for i, (d, _) in enumerate(rows)}
    changed = True
    while changed:
        changed = False
        for i, (_, a) in enumerate(rows):
            for j, (_, b) in enumerate(rows):
                if (a ^ b).bit_count() <= 3 and least[j] < least[i]:
                    least[i] = least[j]
                    changed = True
    return {rows[i][0]: d for i, d in least.items()}


TEXTS = ["", None, " \n\t", "One", "ONE", "one two", "a b c", "A  b\nc", "a b c d e", "é È ß\u00a0x y z", "x" * 5000, "w " * 3000 + "end", "ÀB ab\x0bcd ef gh", "one two three four five six seven eight nine ten " * 9, "one two three four five six seven eight nine ten " * 9 + "x"]


def test_fingerprints_and_components(spark):
    texts = TEXTS * 2
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in simhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
    want = [(i, plain_fingerprint(t)) for i, t in enumerate(texts)]
    assert {d: r.fp % (1 << 64) for d, r in got.items()} == dict(want)
    assert {d: r.component_id for d, r in got.items()} == plain_components(want)


def test_near_duplicates_query(spark):
    got = {r.doc_id: r for r in queries.op5_simhash_trie(spark, DATA).collect()}
    docs = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    want = [(r.doc_id, plain_fingerprint(r.text)) for r in docs]
    assert {d: r.fingerprint for d, r in got.items()} == {d: f"{x:016x}" for d, x in want}
    assert {d: r.component_id for d, r in got.items()} == plain_components(want)


@pytest.mark.parametrize("hot_rows", [20_000, 30, 5, 1])
def test_links_with_and_without_hot_buckets(spark, hot_rows):
    rng = random.Random(3)
    centres = [rng.getrandbits(64) for _ in range(6)]
    values = {c ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(4))) & (1 << 64) - 1 for c in centres for _ in range(40)}
    values |= {rng.getrandbits(64) for _ in range(60)} | {0, (1 << 64) - 1, 7}
    signed = [v - (1 << 64) if v >> 63 else v for v in sorted(values)]
    frame = spark.createDataFrame([(v,) for v in signed], "fp long")
    got = {r.node: r.label for r in components.components(simhash.links(frame, 3, hot_rows)).collect()}
    want = plain_components([(v, v % (1 << 64)) for v in sorted(signed)])
    assert {v: got.get(v, v) for v in signed} == want


def test_a_hot_block_is_split_until_it_is_small(spark):
    """Many fingerprints of one block value, whose next bits are alike as well."""
    rng = random.Random(8)
    values = {0xABCD << 48 | (0b110011 << 42) | rng.getrandbits(30) for _ in range(400)}
    values |= {v ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64) for v in list(values)[:150]}
    signed = [v - (1 << 64) if v >> 63 else v for v in sorted(values)]
    frame = spark.createDataFrame([(v,) for v in signed], "fp long")
    got = {r.node: r.label for r in components.components(simhash.links(frame, 3, 20, batch_rows=50)).collect()}
    assert {v: got.get(v, v) for v in signed} == plain_components([(v, v % (1 << 64)) for v in sorted(signed)])


def test_near_duplicates_edges(spark):
    empty = simhash.near_duplicates(spark.createDataFrame([], DOCS))
    assert empty.count() == 0
    rows = [(None, "a b c d", "x"), (4, "a b c d", "y"), (4, "a b c d", "y"), (9, None, "z")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, fp string")  # fp: a clashing name
    got = sorted((r.doc_id or -1, r.component_id) for r in simhash.near_duplicates(frame).collect())
    assert got == [(-1, 4), (4, 4), (4, 4), (9, 9)]


def test_components_of_a_long_path(spark):
    n = 300
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001), (5, 5)], "u long, v long")
    got = {r.node: r.label for r in components.components(edges).collect()}
    assert got == {**{i: 0 for i in range(n + 1)}, 1000: 1000, 1001: 1000}


def brute_knn(rows, is_query, k):
    own = []
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            own.append((i, [math.floor(1024 * float(x)) for x in v]))
    out = set()
    for q, a in own:
        if is_query(q):
            scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in own if i != q)[:k]
            out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)}
    return out


@pytest.mark.parametrize("pivots,block,shard", [(1, 1024, 50_000), (8, 2, 30), (16, 1, 7)])
def test_knn_against_brute_force(spark, pivots, block, shard):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(np.float32(rng.normal(size=(150, 6)) * (1 + rng.integers(0, 3, (150, 1)))))]
    rows += [(200 + i, list(rows[i][1])) for i in range(30)]  # ties
    rows += [(300, None), (301, [None] * 6), (302, [float("nan")] * 6), (303, [1.0] * 5 + [float("inf")]), (None, [1.0] * 6), (310, [0.5, -0.5]), (320, [])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("v", F.lit(1)).withColumn("d", F.lit("x"))
    got = knn.search(frame, F.col("vec_id") % 10 == 0, 10, n_pivots=pivots, query_block=block, shard_rows=shard)
    assert {tuple(r) for r in got.collect()} == brute_knn(rows, lambda i: i % 10 == 0, 10)


def test_knn_edges(spark):
    schema = "vec_id long, embedding array<float>"
    assert knn.search(spark.createDataFrame([], schema), F.col("vec_id") % 100 == 0).count() == 0
    few = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [3.0, 0.0])]
    got = knn.search(spark.createDataFrame(few, schema), F.col("vec_id") == 0)
    assert {tuple(r) for r in got.collect()} == brute_knn(few, lambda i: i == 0, 10)
    twice = [(0, [1.0]), (0, [1.0]), (5, [2.0]), (5, [2.0])]
    got = sorted(tuple(r) for r in knn.search(spark.createDataFrame(twice, schema), F.col("vec_id") == 0).collect())
    assert got == [(0, 1, 5, 1024 * 2048), (0, 2, 5, 1024 * 2048)]


def test_knn_of_ids_repeated_more_than_k_times(spark):
    vectors = np.random.default_rng(11).normal(size=(60, 6))  # of one length, so that distances tell scores
    vectors = np.float32(vectors / np.linalg.norm(vectors, axis=1, keepdims=True))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    rows += [rows[0]] * 300 + [(10, [x + 0.001 for x in rows[10][1]])] * 30
    rows[10] = (11, rows[10][1])
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = knn.search(frame, F.col("vec_id") % 10 == 0, 10, n_pivots=400, query_block=1, shard_rows=50)
    assert {tuple(r) for r in got.collect()} == brute_knn(rows, lambda i: i % 10 == 0, 10)


@pytest.mark.parametrize("times", [2, 11, 15])
@pytest.mark.parametrize("n", [20, 30, 500])
def test_knn_of_queries_repeated(spark, times, n):
    rng = np.random.default_rng(n * times)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(np.float32(rng.normal(size=(n, 5))))]
    rows[3] = (3, [40.0] * 5)  # one vector of greatest norm
    rows += [r for r in rows if r[0] % 10 == 0] * (times - 1)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = knn.search(frame, F.col("vec_id") % 10 == 0, 10, n_pivots=16, query_block=4, shard_rows=40)
    assert {tuple(r) for r in got.collect()} == brute_knn(rows, lambda i: i % 10 == 0, 10)


def test_knn_scores_beyond_doubles_and_longs(spark):
    for big, clipped in ((2.0**18, False), (2.0**40, True)):
        rows = [(i, [big + i * 2.0**-8, -big * (i % 3), 1.0 + i]) for i in range(30)]
        frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        got = {tuple(r) for r in knn.search(frame, F.col("vec_id") % 10 == 0, 10, n_pivots=4).collect()}
        most = (1 << 63) - 1
        own = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows]
        want, beyond = set(), False
        for q, a in own:
            if q % 10 == 0:
                exact = [(sum(x * y for x, y in zip(a, b)), i) for i, b in own if i != q]
                beyond |= any(abs(s) > most for s, _ in exact)
                best = sorted((-max(-most, min(most, s)), i) for s, i in exact)[:10]
                want |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(best)}
        assert got == want and beyond == clipped


def test_knn_copies_are_few_where_rows_lie_apart(spark):
    rng = np.random.default_rng(3)
    v = np.repeat(rng.normal(size=(12, 16)), 40, axis=0) + 0.01 * rng.normal(size=(480, 16))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    frame = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "vec_id long, embedding array<double>")
    n = {r.q: r.n for r in knn.copies(frame, F.col("vec_id") % 20 == 0, query_block=2).collect()}
    assert n[True] == 24 and n[False] < 480 * 2


def test_urls_are_cut_and_ruled(spark):
    rows = [
        ("https://WWW.Example.COM/en/7?x=1#y", "www.example.com", "/en/7", "example.com/en/7", "allow"),
        ("http://a.com/en/9", "a.com", "/en/9", "com/en/", "block"),
        ("http://notexample.com/en/7", "notexample.com", "/en/7", "com/en/", "block"),
        ("x://example.net/de/81#q", "example.net", "/de/81", "example.net/de/8", "block"),
        ("x://m.example.net/de/9", "m.example.net", "/de/9", "net/de/", "allow"),
        ("ftp://É.Org/es/", "É.org", "/es/", "org/es/", "block"),
        ("http://org?/es/", "org", "", None, "allow"),
        ("no scheme", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("a://b://c/d", "b:", "//c/d", None, "allow"),
        ("://", "", "", None, "allow"),
    ]
    frame = spark.createDataFrame([(i, r[0], "h") for i, r in enumerate(rows)], "page_id long, url string, host string")
    none = spark.createDataFrame([], "antecedent array<string>, support_count long, confidence double")
    got = {r.page_id: tuple(r)[1:4] + (r.verdict,) for r in url_rules.judge(frame, none).collect()}
    assert got == {i: r[1:] for i, r in enumerate(rows)}


def accepted(bad, n, base, least, z=3.29):
    p = bad / n
    return p >= least and (p + z * z / (2 * n) - z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n) > base


def plain_rules(rows, least, count=20):
    """All combinations of any size that are rules, of (tokens, bad) rows: bad rows and confidence."""
    from itertools import combinations

    n, bad = {}, {}
    often = {t for t in {t for x, _ in rows for t in x} if sum(b for x, b in rows if t in x) >= count}
    for x, b in rows:
        own = sorted(set(x) & often)
        for c in (c for k in range(1, len(own) + 1) for c in combinations(own, k)):
            n[c], bad[c] = n.get(c, 0) + 1, bad.get(c, 0) + b
    base = sum(b for _, b in rows) / len(rows)
    return {c: (bad[c], bad[c] / n[c]) for c in n if bad[c] >= count and accepted(bad[c], n[c], base, least)}


def blocked(rules, rows):
    return [any(set(r) <= set(x) for r in rules) for x, _ in rows]


def test_url_rules_are_mined(spark):
    pages = [(i, f"http://{'win' if i % 3 == 0 else 'good'}.site.com/{'promo' if i % 2 == 0 else 'news'}/{i}") for i in range(240)]
    labels = [(i, 0 if i % 6 == 0 else 1, 0) for i in range(200)] + [(0, None, None)]
    p = spark.createDataFrame(pages, "page_id long, url string")
    labelled = url_rules.labelled(p, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    mined = url_rules.mine(labelled, min_confidence=0.8)
    kept = {tuple(r.antecedent) for r in url_rules.without_redundant(mined.collect())}
    assert kept == {("h:win", "p:promo")}
    got = {r.page_id: r.mined_bad for r in url_rules.judge(p, mined, {}).collect()}
    assert got == {i: i % 6 == 0 for i, _ in pages}
    assert url_rules.mine(labelled.limit(0)).count() == 0


@pytest.mark.parametrize("broadcast", [100_000, 0])
@pytest.mark.parametrize("most", [0, 12])
def test_rules_of_any_size(spark, monkeypatch, most, broadcast):
    """Level by level and by FP-growth, matched by the index and by the join."""
    monkeypatch.setattr(url_rules, "RULES_BROADCAST", broadcast)
    rng = random.Random(5)
    rows = []
    for i in range(600):
        own = ["h:com", *(t for t in "abcdefg" if rng.random() < 0.75)]
        bad = int({"a", "b", "c", "d", "e"} <= set(own) and rng.random() < 0.97 or rng.random() < 0.1 or ({"f", "g"} <= set(own) and "a" not in own and rng.random() < 0.9))
        rows.append((own, bad))
    want = plain_rules(rows, 0.9)
    assert max(map(len, want)) > 3 and not all(len(c) <= 3 for c in want if not any(set(x) < set(c) for x in want))
    frame = spark.createDataFrame(rows, "tokens array<string>, bad int")
    mined = url_rules.mine(frame, min_confidence=0.9, max_items=most)
    got = {tuple(r.antecedent): (r.support_count, r.confidence) for r in mined.collect()}
    assert got.items() <= want.items() if most == 0 else got == want
    assert blocked(got, rows) == blocked(want, rows)
    judged = url_rules.with_mined(frame.withColumn("i", F.monotonically_increasing_id()), mined).orderBy("i").collect()
    assert [(r.tokens, r.mined_bad) for r in judged] == [(x, b) for (x, _), b in zip(rows, blocked(want, rows))]


def test_long_urls_and_their_sql(spark, tmp_path):
    """URLs of 20 tokens and more; the query and its SQL agree where rules are found."""
    import duckdb

    rng = random.Random(6)
    pages, labels = [], []
    for i in range(500):
        rare = [f"s{i}x{k}".translate(str.maketrans("0123456789", "abcdefghij")) for k in range(14)]
        tell = [t for t in ("win", "promo", "free", "x") if rng.random() < 0.5]
        bad = {"win", "promo"} <= set(tell) or {"free", "x"} <= set(tell) and rng.random() < 0.8
        pages.append((i, f"http://h{i}.example.org/fr/{'/'.join(tell + rare)}?a={i}&b=2", "h"))
        labels += [(i, int(not bad), 0)] * (1 + i % 2)
    pages += [(0, pages[0][1], "again"), (None, None, None), (900, "http://example.com/en/7", ""), (901, "http://new.net/win/promo", "")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = queries.op2_url_rules(spark, str(tmp_path))
    con = duckdb.connect()
    for t in ("pages", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = con.sql(f"SELECT page_id, host, path, rule, verdict FROM ({queries.ORACLE_SQL['op2_url_rules']})").fetchall()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    assert got.where("rule is null and verdict = 'block'").count() > 50


def test_url_edges(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    none = url_rules.mine(url_rules.labelled(pages, spark.createDataFrame([], "doc_id long, quality int, toxic int")))
    assert none.count() == 0 and url_rules.judge(pages, none).count() == 0
    twice = spark.createDataFrame([(1, "http://a.com/en/", "x", "y")] * 2, "page_id long, url string, host string, tokens string")
    assert [r.verdict for r in url_rules.judge(twice, none).collect()] == ["block", "block"]
