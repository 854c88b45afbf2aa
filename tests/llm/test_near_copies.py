"""Near copies of the pipeline's third stage against brute force."""

import random
import re

import numpy as np

import corpus_pipeline
from hushgrain.llm import near_copies

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def plain_shingles(text, k=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def plain_kept(rows):
    """Least doc_id of each component of pairs at 0.8 or more."""
    sets, label = [plain_shingles(t) for _, t in rows], list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if len(a & b) * 5 >= len(a | b) * 4 and label[i] != label[j]:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    return sorted(min(d for (d, _), x in zip(rows, label) if x == y) for y in set(label))


def stage(spark, rows):
    frame = spark.createDataFrame([(d, t, "en", "s", None) for d, t in rows], DOCS)
    return corpus_pipeline.near_dedup(spark, frame, "")


def test_pairs_about_the_threshold(spark):
    rng = random.Random(4)
    texts = [[f"w{rng.randrange(5000)}" for _ in range(rng.choice((12, 30, 100, 300)))] for _ in range(40)]
    for words in texts[:40]:
        for share in (0.005, 0.02, 0.03, 0.05, 0.1):
            texts.append([f"x{rng.randrange(5000)}" if rng.random() < share else w for w in words])
    for _ in range(60):  # each a step further: a chain whose ends are far apart
        texts.append([w if rng.random() < 0.99 else "y" for w in texts[-1]])
    line = [f"c{i}" for i in range(20)]  # a common line that makes no copies
    texts += [line + [f"z{rng.randrange(5000)}" for _ in range(15)] for _ in range(40)]
    rows = list(enumerate(map(" ".join, texts)))
    rng.shuffle(rows)
    assert sorted(r.doc_id for r in stage(spark, rows).collect()) == plain_kept(rows)


def test_cells_find_spanning_links():
    rng = np.random.default_rng(2)
    for trial in range(60):
        base = rng.integers(0, 1 << 60, 40)
        sets = [np.unique(np.where(rng.random(40) < rng.choice((0.02, 0.1, 0.2)), rng.integers(0, 1 << 60, 40), base)) for _ in range(25)]
        sets += [np.empty(0, np.int64), np.empty(0, np.int64), sets[0]]
        n = len(sets)
        side = np.array([k % 2 for k in range(n)]) if trial % 2 else np.zeros(n, int)
        label = np.array([k - k % 3 if trial % 3 == 0 else k for k in range(n)])
        similar = lambda a, b: len(a & b) * 5 >= len(a | b) * 4
        own = [set(x.tolist()) for x in sets]
        true = [(a, b) for a in range(n) for b in range(a) if similar(own[a], own[b])]
        found = near_copies.cell_links(np.arange(n), label, sets, side)
        assert {(b, a) for a, b in true} >= set(found)

        def parts(pairs):
            of = label.copy()
            for a, b in pairs:
                of[of == of[a]] = of[b]
            return of

        want = parts([(a, b) for a, b in true if side[a] != side[b] or not trial % 2])
        got = parts(found)
        assert all((want[a] == want[b]) == (got[a] == got[b]) for a in range(n) for b in range(a))


def test_large_groups_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "BLOCK", 7)
    rng = random.Random(6)
    base = [f"w{i}" for i in range(120)]
    texts = [" ".join(w if rng.random() > share else f"x{rng.randrange(10**6)}" for w in base) for share in (0.01, 0.02, 0.03, 0.04, 0.06) for _ in range(40)]
    rows = list(enumerate(texts))
    assert sorted(r.doc_id for r in stage(spark, rows).collect()) == plain_kept(rows)


def test_short_texts_are_linked_by_their_shingles_only(spark):
    a = "one two three four five six seven eight nine ten eleven twelve"
    b = a.replace("twelve", "dozen").replace("one", "uno")
    rows = [(1, a), (2, b), (3, a.upper()), (4, "a b"), (5, "a b"), (6, "a c"), (7, ""), (8, None)]
    assert sorted(r.doc_id for r in stage(spark, rows).collect()) == [1, 2, 4, 6, 7]


def test_every_row_counts_by_itself(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, a), (2, a), (2, b), (3, c), (3, c), (None, c), (None, b + " "), (None, "alone " + a[::-1]), (None, "alone " + a[::-1])]
    got = sorted((r.doc_id or 0, r.text) for r in stage(spark, rows).collect())
    assert got == sorted([(1, a), (2, b), (3, c), (0, "alone " + a[::-1])])


def test_buckets_are_shared_at_the_threshold():
    rng = random.Random(9)
    for _ in range(300):
        common = [rng.getrandbits(64) for _ in range(80)]
        a, b = (np.array([*common, *(rng.getrandbits(64) for _ in range(10))], np.uint64) for _ in range(2))
        assert (near_copies.buckets(a) == near_copies.buckets(b)).any()
