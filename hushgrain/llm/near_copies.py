"""Near copies by five-word shingles: SimHash links, completed down to a similarity of 0.8.

A document is the set of its five-word shingles (of all its words, if it has fewer). Two documents
are linked if the Jaccard similarity of their sets is 0.8 or more, counted on the shingles
themselves. Exact copies (equal words, by a 128-bit digest) are one class, which its least row stands
for; only classes are compared.

Candidates come from two sources. First the trie self-join of `simhash` over 64-bit fingerprints of
the same shingles, at max_bits or fewer differing bits: it joins close copies, the bulk of large
groups, with fingerprints alone. At a similarity of 0.8 some 10 of 64 bits differ, which no trie or
block scheme finds without comparing nearly all pairs; so the rest comes from BANDS buckets, each
named by ROWS MinHash values: a pair at 0.8 shares none with a probability of 4e-7, one at 0.9 with
5e-16. Buckets whose members the first links have already joined cost nothing more.

Buckets that still hold several components are first thinned: each row is compared with one other, the
least row of a bucket with which it shares most buckets. What is still mixed is compared whole, in
cells: a bucket's members are dealt to blocks of BLOCK rows, and each pair of blocks is a task's work,
which counts common shingles over an index of the cell and returns a spanning forest of its links. So
no pairs are written or joined, however many members of a bucket are nearly, but not quite, similar.

Only texts of candidates are shuffled. Nulls and ties: texts without words are copies of each other;
every row counts by itself, whatever its id, and repeated rows are copies. Of a component the row
with the least id stays (nulls last; equal ids by a hash of the text, equal texts by the row's
place). An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from hushgrain.llm import simhash
from hushgrain.llm.components import components
from hushgrain.llm.runtime import drop, small_or_not, table, tidy
from hushgrain.llm.worker import each, release

SHINGLE = 5
#: Least similarity of a link, as a fraction.
SIMILAR = (4, 5)
BANDS, ROWS = 48, 6
#: Rows of a block of a bucket; a cell has two blocks.
BLOCK = 256
_PORTION = 1024
_DRAWN = np.random.default_rng(7).integers(0, 1 << 32, (2, BANDS * ROWS), dtype=np.uint32)
_TIMES, _PLUS = _DRAWN[0] | np.uint32(1), _DRAWN[1]


def shingles(text: str | None) -> set[bytes]:
    """The shingles of lower-cased (A-Z) words, joined by a space."""
    words = text.encode().lower().split() if text else []
    k = min(SHINGLE, len(words))
    return {b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)} if k else set()


def buckets(hashes: np.ndarray) -> np.ndarray:
    """The bucket of each band, of the hashes of a set's shingles."""
    hashes = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32)
    least = np.full(BANDS * ROWS, (1 << 32) - 1, np.uint32)
    for i in range(0, len(hashes), _PORTION):
        np.minimum(least, (hashes[i : i + _PORTION, None] * _TIMES + _PLUS).min(axis=0), out=least)
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        out = (out ^ column) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def sketch(text: str | None) -> tuple[int, int, int, int, np.ndarray]:
    """Two halves of the words' digest, fingerprint, number of distinct shingles, buckets."""
    from xxhash import xxh3_128_intdigest

    words = text.encode().lower().split() if text else []
    hashes = simhash.shingle_hashes(words, SHINGLE)
    digest = xxh3_128_intdigest(b" ".join(words))
    own = np.unique(hashes)
    high, low = (x - (1 << 64) if x >> 63 else x for x in (digest >> 64, digest & ((1 << 64) - 1)))
    return high, low, simhash.majority(hashes), len(own), buckets(own)


def sketches(text: Column) -> Column:
    """Struct of what sketch returns."""

    @arrow_udf("struct<high:long,low:long,fp:long,n:long,buckets:array<long>>")
    def run(texts: pa.Array) -> pa.Array:
        release()
        *numbers, found = zip(*map(sketch, each(texts))) if len(texts) else ([], [], [], [], [])
        flat = pa.array(np.concatenate(found) if found else np.empty(0, np.int64))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * BANDS), flat)
        return pa.StructArray.from_arrays([*(pa.array(x, pa.int64()) for x in numbers), lists], names=["high", "low", "fp", "n", "buckets"])

    return run(text)


def similar(a: set[bytes], b: set[bytes]) -> bool:
    common = len(a & b)
    return common * SIMILAR[1] >= (len(a) + len(b) - common) * SIMILAR[0]


def _confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """pairs (u, v) of rows of texts (row, text) that are similar."""

    @arrow_udf("boolean")
    def run(left: pa.Array, right: pa.Array) -> pa.Array:
        release()
        out, last, own = [], None, None
        for a, b in zip(each(left), each(right)):
            if own is None or a != last:
                last, own = a, shingles(a)
            out.append(similar(own, shingles(b)))
        return pa.array(out, pa.bool_())

    pairs = table(pairs.distinct(), "pairs")
    named = table(pairs.select(F.explode(F.array("u", "v")).alias("row")).distinct(), "named")
    texts = table(texts.join(small_or_not(named), "row", "left_semi"), "texts")
    side = lambda name: texts.select(F.col("row").alias(name), F.col("text").alias(f"text_{name}"))
    both = pairs.join(side("u"), "u").join(side("v"), "v")
    out = table(both.where(run("text_u", "text_v")).select("u", "v"), "similar")
    drop(pairs, named, texts)
    return out


def _labelled(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """nodes (row, ...) with the label of their component under links."""
    labels = table(components(links).withColumnRenamed("node", "row"), "labels")
    return nodes.join(small_or_not(labels), "row", "left").withColumn("label", F.coalesce("label", "row"))


def _sets(text: Column) -> Column:
    """Sorted hashes of the distinct shingles."""

    @arrow_udf("array<long>")
    def run(texts: pa.Array) -> pa.Array:
        release()
        found = [np.unique(simhash.shingle_hashes(x.encode().lower().split() if x else [], SHINGLE)) for x in each(texts)]
        ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found).view(np.int64) if found else np.empty(0, np.int64)))

    return run(text)


def cell_links(rows: np.ndarray, label: np.ndarray, sets: list[np.ndarray], side: np.ndarray) -> list[tuple[int, int]]:
    """Links (u, v) that join the components of a cell's similar rows. label: components so far. side:
    block of each row; rows of different blocks are compared, or all, if there is one block."""
    size = np.array(list(map(len, sets)), np.int64)
    owner = np.repeat(np.arange(len(sets)), size)
    _, code = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(code, kind="stable")
    held = owner[order]  # by shingle, who holds it
    start = np.searchsorted(code[order], np.arange(code.max() + 2 if len(code) else 1))
    first = np.cumsum(size) - size
    two = side.min() != side.max()
    _, parent = np.unique(label, return_inverse=True)
    most = np.bincount(parent).argmax()  # of two different components one isn't this one
    less, more = SIMILAR
    out = []
    for x in np.flatnonzero(parent != most).tolist():
        others = parent != parent[x]
        if two:
            others &= side != side[x]
        if not others.any():
            continue
        own = code[first[x] : first[x] + size[x]]
        n = start[own + 1] - start[own]
        at = np.repeat(start[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        common = np.bincount(held[at], minlength=len(sets))
        for y in np.flatnonzero(others & (common * more >= (size + size[x] - common) * less)).tolist():
            if parent[x] != parent[y]:
                out.append((int(min(rows[x], rows[y])), int(max(rows[x], rows[y]))))
                parent[parent == parent[y]] = parent[x]
    return out


def _compared(members: DataFrame, texts: DataFrame) -> DataFrame:
    """members: (bucket, row, label, rows: how many the bucket has). Links within buckets."""
    named = table(members.select("row").distinct(), "named")
    sets = table(texts.join(small_or_not(named), "row", "left_semi").select("row", _sets(F.col("text")).alias("hashes")), "sets")
    blocks = F.ceil(F.col("rows") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("row"), blocks).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), blocks - 1), lambda k: F.struct(F.least(k, own).alias("i"), F.greatest(k, own).alias("j")))
    dealt = members.select("bucket", "row", "label", own.alias("side"), F.explode(pairs).alias("cell")).join(sets, "row")

    def run(batches):
        last, held = None, []

        def done():
            rows, label, side, sets_ = zip(*held)
            found = cell_links(np.array(rows), np.array(label), list(sets_), np.array(side))
            if found:
                u, v = zip(*found)
                yield pa.record_batch({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

        for b in batches:
            bucket, i, j, row, label, side = (b.column(k).to_pylist() for k in range(6))
            ends, flat = b.column(6).offsets.to_numpy(), b.column(6).values.to_numpy(zero_copy_only=False)
            for k, cell in enumerate(zip(bucket, i, j)):
                if cell != last and held:
                    yield from done()
                    held = []
                last = cell
                held.append((row[k], label[k], side[k], flat[ends[k] : ends[k + 1]].copy()))
        if held:
            yield from done()

    keys = ["bucket", F.col("cell.i").alias("i"), F.col("cell.j").alias("j")]
    cells = dealt.select(*keys, "row", "label", "side", "hashes").repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    out = table(cells.mapInArrow(run, "u long, v long").distinct(), "similar")
    drop(named, sets)
    return out


def links(nodes: DataFrame, texts: DataFrame, max_bits: int = 3) -> DataFrame:
    """nodes: (row, fp, n, buckets), a written table, one row for each class; texts: (row, text). Returns
    links (u, v) whose components are those of all similar pairs that a fingerprint or bucket joins."""
    first_of = table(nodes.groupBy("fp").agg(F.min("row").alias("first")), "prints")
    near = table(simhash.links(first_of.select("fp"), max_bits), "near")
    end = lambda x: first_of.select(F.col("fp").alias(x), F.col("first").alias(f"{x}_row"))
    close = near.join(end("u"), "u").join(end("v"), "v").select(F.col("u_row").alias("u"), F.col("v_row").alias("v"))
    same = nodes.join(first_of, "fp").where("row <> first").select(F.col("first").alias("u"), F.col("row").alias("v"))
    found = _confirmed(close.unionByName(same), texts)

    tidy(nodes.sparkSession)
    dealt = nodes.select("row", F.explode("buckets").alias("bucket"))
    shared = table(dealt.groupBy("bucket").agg(F.count("*").alias("rows"), F.min("row").alias("pivot")).where("rows > 1"), "shared")
    members = table(dealt.join(small_or_not(shared), "bucket"), "members")
    labelled = _labelled(members, found)
    own = labelled.where("row = pivot").select("bucket", F.col("label").alias("own"))
    apart = labelled.join(own, "bucket").where("label <> own").groupBy("row", "pivot").agg(F.count("*").alias("common"))
    best = apart.groupBy("row").agg(F.max_by("pivot", F.struct("common", -F.col("pivot"))).alias("pivot"))
    found = table(found.unionByName(_confirmed(best.select(F.least("pivot", "row").alias("u"), F.greatest("pivot", "row").alias("v")), texts)), "found")

    tidy(nodes.sparkSession)
    labelled = table(_labelled(members, found), "labelled")
    mixed = table(labelled.groupBy("bucket").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a <> b").select("bucket"), "mixed")
    still = table(labelled.join(small_or_not(mixed), "bucket", "left_semi").select("bucket", "row", "label", "rows"), "still")
    out = table(found.unionByName(_compared(still, texts)), "found")
    drop(first_of, near, shared, members, found, labelled, mixed, still)
    return out


def without_copies(docs: DataFrame, max_bits: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, one of each component of near copies."""
    tidy(docs.sparkSession)
    own = table(docs.select(F.struct("*").alias("doc"), F.monotonically_increasing_id().alias("row")), "rows")
    text, key = F.col("doc").getField(text_col), F.col("doc").getField(id_col)
    rows = table(own.select("row", key.alias("id"), F.xxhash64(text).alias("hash"), sketches(text).alias("s")).select("row", "id", "hash", "s.*"), "sketches")
    same = [F.first(c).alias(c) for c in ("fp", "n", "buckets")]  # equal in a class
    classes = rows.groupBy("high", "low").agg(F.min("row").alias("row"), *same)
    nodes = table(classes, "classes")
    joined = links(nodes.select("row", "fp", "n", "buckets"), own.select("row", text.alias("text")), max_bits)
    tidy(docs.sparkSession)
    label_of = table(_labelled(nodes.select("high", "low", "row"), joined).select("high", "low", "label"), "labels")
    of = rows.select("row", "id", "hash", "high", "low").join(label_of, ["high", "low"])
    of = table(of.select("row", "id", "hash", "label"), "copies")
    keep = of.groupBy("label").agg(F.min(F.struct(F.col("id").isNull(), "id", "hash", "row")).getField("row").alias("kept"))
    dropped = table(of.join(keep, "label").where("row <> kept").select("row"), "dropped")
    return own.join(small_or_not(dropped), "row", "left_anti").select(*[F.col("doc").getField(c).alias(c) for c in docs.columns])
