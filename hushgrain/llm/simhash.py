"""Near duplicates by SimHash: fingerprints of word shingles, linked by a binary-trie self-join.

A sorted array of fingerprints is a binary trie: a node is a range, its children the two parts of
that range. The join walks pairs of nodes together from the top bit down, adds a bit to a pair's
error whenever the two sides take different branches, and drops the pair once the error exceeds
the budget. To spread the work, fingerprints are dealt out by each of budget + 1 blocks of bits
(two that link agree on one block at least) and one trie is built for each block's value. A value
with very many fingerprints is split into pairs of its next trie nodes, those within the budget
only, and so on until no pair has many. Only distinct fingerprints are joined, and a task returns a spanning forest of its links, so
nothing grows with the square of a group.

Nulls and ties: a null text or one without words has fingerprint 0; rows with a null doc_id get a
fingerprint and their fingerprint's component; repeated doc_ids are judged row by row. An empty
table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from hushgrain.llm.components import components
from hushgrain.llm.runtime import small_or_not, table
from hushgrain.llm.worker import each, release

_PORTION = 1 << 18


def shingle_hashes(words: list[bytes], shingle: int) -> np.ndarray:
    """XXH64 (seed 42) of each shingle, repeats included; of all words, if there are fewer."""
    from xxhash import xxh64_intdigest as h

    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    joined = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
    starts, ends = np.concatenate(([0], ends[:-1])), ends - 1
    k = min(shingle, n)
    starts, ends = starts[: n - k + 1].tolist(), ends[k - 1 :].tolist()
    return np.fromiter((h(joined[a:b], 42) for a, b in zip(starts, ends)), np.uint64, len(starts))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes, as a signed integer; 0 of none."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _PORTION):
        bits = np.unpackbits(hashes[i : i + _PORTION].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes)).view(">i8")[0])


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64-bit SimHash of the shingles of lower-cased (A-Z) words, as a signed integer."""
    words = text.encode().lower().split() if text else []  # of bytes: only ASCII case and space
    return majority(shingle_hashes(words, shingle))


def fingerprints(text: Column, shingle: int = 3) -> Column:
    @arrow_udf("long")
    def run(texts: pa.Array) -> pa.Array:
        release()
        return pa.array([fingerprint(x, shingle) for x in each(texts)], pa.int64())

    return run(text)


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int8)


class _Forest:
    """Labels of rows under the links found so far; a label is the least row of its tree."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self._changes()

    def _changes(self) -> None:
        self.changes = np.concatenate(([0], np.cumsum(self.label[1:] != self.label[:-1]))) if len(self.label) else np.zeros(0, np.int64)

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        label = self.label
        while True:
            a, b = label[i], label[j]
            if not (differ := a != b).any():
                break
            i, j, a, b = i[differ], j[differ], a[differ], b[differ]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while (label[label] != label).any():
                label[:] = label[label]
        self._changes()

    def one_tree(self, alo, ahi, blo, bhi) -> np.ndarray:
        c = self.changes
        return (c[ahi - 1] == c[alo]) & (c[bhi - 1] == c[blo]) & (self.label[alo] == self.label[blo])


def trie_forest(values: np.ndarray, roots: list[np.ndarray], depth: int, budget: int, frontier: int = 1 << 18, leaf: int = 64) -> np.ndarray:
    """Links of values (uint64, ascending within each range) at `budget` or fewer differing bits.

    roots: arrays a_lo, a_hi, b_lo, b_hi, used of node pairs to start from, all at `depth`, with the
    bits that already differ. Returns for each value the least position that it is linked with,
    directly or over others, by those node pairs.
    """
    forest, ones = _Forest(len(values)), {}
    stack = [(depth, roots)]
    while stack:
        d, pairs = stack.pop()
        alo, ahi, blo, bhi, used = pairs
        keep = (ahi > alo) & (bhi > blo) & (used <= budget)
        keep &= ~((alo == blo) & (ahi - alo == 1))
        pairs = [x[keep] for x in pairs]
        if len(pairs[0]):
            open_ = ~forest.one_tree(*pairs[:4])
            pairs = [x[open_] for x in pairs]
        n = len(pairs[0])
        if not n:
            continue
        if n > frontier:
            stack += [(d, [x[frontier:] for x in pairs]), (d, [x[:frontier] for x in pairs])]
            continue
        alo, ahi, blo, bhi, used = pairs
        small = ((ahi - alo) * (bhi - blo) <= leaf) | (d >= 64)
        if small.any():
            la, lb, lo_a, lo_b = (ahi - alo)[small], (bhi - blo)[small], alo[small], blo[small]
            size = la * lb
            ends = np.cumsum(size)
            of = np.repeat(np.arange(len(size)), size)
            at = np.arange(ends[-1]) - (ends - size)[of]
            i, j = lo_a[of] + at // lb[of], lo_b[of] + at % lb[of]
            near = (i != j) & (_popcount(values[i] ^ values[j]) <= budget)
            forest.link(i[near], j[near])
        big = ~small
        if big.any():
            alo, ahi, blo, bhi, used = (x[big] for x in pairs)
            if d not in ones:
                ones[d] = np.concatenate(([0], np.cumsum((values >> np.uint64(63 - d)) & np.uint64(1), dtype=np.int64)))
            c = ones[d]
            am, bm = ahi - (c[ahi] - c[alo]), bhi - (c[bhi] - c[blo])
            own = alo == blo
            other = ~own  # of a node with itself, one of the two mixed pairs is enough
            stack.append(
                (
                    d + 1,
                    [
                        np.concatenate((alo, am, alo, am[other])),
                        np.concatenate((am, ahi, am, ahi[other])),
                        np.concatenate((blo, bm, bm, blo[other])),
                        np.concatenate((bm, bhi, bhi, bm[other])),
                        np.concatenate((used, used, used + 1, used[other] + 1)),
                    ],
                )
            )
    return forest.label


def _join_groups(group: np.ndarray, side: np.ndarray, depth: np.ndarray, used: np.ndarray, value: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (value, value) of whole groups, given with all their rows. A group is a trie node
    with itself (side 2) or a pair of nodes (sides 0 and 1), at a depth, with the bits that differ."""
    order = np.lexsort((value, side, group))
    group, side, depth, used, value = (x[order] for x in (group, side, depth, used, value))
    lo = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    hi = np.append(lo[1:], len(group))
    middle = lo + np.add.reduceat(side == 0, lo) if len(lo) else lo
    own = side[lo] == 2
    roots = [lo, np.where(own, hi, middle), np.where(own, lo, middle), hi, used[lo]]
    u, v = [], []
    for d in np.unique(depth[lo]).tolist():
        label = trie_forest(value, [x[depth[lo] == d] for x in roots], d, budget)
        i = np.flatnonzero(label != np.arange(len(label)))
        u.append(value[i])
        v.append(value[label[i]])
    return np.concatenate(u), np.concatenate(v)


def _split(rows: DataFrame, max_bits: int, cell: int) -> DataFrame:
    """Rows of groups, dealt to the pairs of child nodes within the budget, `cell` bits deeper."""
    own = F.shiftrightunsigned(F.expr("shiftleft(value, depth)"), 64 - cell).bitwiseAND(F.lit((1 << cell) - 1)).cast("int")
    masks = F.array(*[F.struct(F.lit(m).alias("m"), F.lit(m.bit_count()).alias("bits")) for m in range(1 << cell) if m.bit_count() <= max_bits])

    def child(x: Column) -> Column:
        other = own.bitwiseXOR(x["m"])
        right = (F.col("side") == 1) | ((F.col("side") == 2) & (own > other))  # of a node with itself, the lesser child is on the left
        side = F.when((F.col("side") == 2) & (x["m"] == 0), 2).when(right, 1).otherwise(0)
        pair = F.concat_ws(".", F.when(right, other).otherwise(own), F.when(right, own).otherwise(other))
        return F.struct(F.concat_ws("/", "path", pair).alias("path"), side.alias("side"), (F.col("used") + x["bits"]).alias("used"))

    children = F.transform(F.filter(masks, lambda x: F.col("used") + x["bits"] <= max_bits), child)
    dealt = rows.withColumn("x", F.explode(children))
    return dealt.select("bucket", F.col("x.path").alias("path"), (F.col("depth") + cell).alias("depth"), F.col("x.side").alias("side"), F.col("x.used").alias("used"), "value", "block")


def links(classes: DataFrame, max_bits: int = 3, hot_rows: int = 20_000, cell: int = 6, batch_rows: int = 200_000) -> DataFrame:
    """classes: distinct fingerprints (fp long). Returns links (u, v) whose components are those of
    all pairs at max_bits or fewer differing bits. No task gets a group of more than hot_rows
    fingerprints, unless they can't be told apart."""
    blocks = max_bits + 1
    width = min(16, 64 // blocks)
    step = 64 // blocks

    def rotated(k: int) -> Column:
        fp = F.col("fp")
        return fp if not k else F.shiftleft(fp, k * step).bitwiseOR(F.shiftrightunsigned(fp, 64 - k * step))

    dealt = classes.select(F.explode(F.array(*[F.struct(F.lit(k).alias("block"), rotated(k).alias("value")) for k in range(blocks)])).alias("x")).select("x.*")
    bucket = F.col("block").cast("long") * (1 << width) + F.shiftrightunsigned("value", 64 - width)
    rows = dealt.select(bucket.alias("bucket"), F.lit("").alias("path"), F.lit(width).alias("depth"), F.lit(2).alias("side"), F.lit(0).alias("used"), "value", "block")
    keyed = None
    for depth in range(width, 65, cell):
        sizes = rows.groupBy("bucket", "path").agg(F.count("*").alias("n"), F.min("side").alias("a"), F.max("side").alias("z"))
        lone = (F.col("a") == F.col("z")) & (F.col("a") < 2)  # a pair of which one node is empty
        hot = table(sizes.where(lone | (F.col("n") > hot_rows)).select("bucket", "path", lone.alias("lone")), "hot")
        if hot.isEmpty() or depth + cell > 64:
            break
        marked = rows.join(small_or_not(hot), ["bucket", "path"], "left")  # rows(hot) <= rows / hot_rows, and pairs
        cold = marked.where("lone is null").drop("lone")
        keyed = cold if keyed is None else keyed.unionByName(cold)
        rows = table(_split(marked.where("not lone"), max_bits, cell), "split")
    keyed = rows if keyed is None else keyed.unionByName(rows)

    def run(batches):
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= batch_rows:
                whole = pa.Table.from_batches(held)
                key = whole.select(["bucket", "path"])
                last = key.slice(n - 1).to_pylist()[0]
                same = pc.and_(pc.equal(key["bucket"], last["bucket"]), pc.equal(key["path"], last["path"]))
                first = pc.index(same, True).as_py()  # the last group may go on
                if first:
                    yield from done(whole.slice(0, first))
                held, n = whole.slice(first).combine_chunks().to_batches(), n - first
        if n:
            yield from done(pa.Table.from_batches(held))

    def done(rows_: pa.Table):
        number = lambda c: rows_[c].to_numpy().astype(np.int64)
        path = pa.concat_arrays(rows_["path"].chunks).dictionary_encode()
        _, group = np.unique(np.stack([number("bucket"), path.indices.to_numpy().astype(np.int64)]), axis=1, return_inverse=True)
        value, block = number("value").view(np.uint64), number("block")
        u, v = [], []
        for k in np.unique(block).tolist():
            of = block == k
            x, y = _join_groups(group.ravel()[of], *(number(c)[of] for c in ("side", "depth", "used")), value[of], max_bits)
            back = np.uint64(k * step % 64), np.uint64((64 - k * step) % 64)
            u += [(x >> back[0]) | (x << back[1]) if k else x]
            v += [(y >> back[0]) | (y << back[1]) if k else y]
        u, v = np.concatenate(u).view(np.int64), np.concatenate(v).view(np.int64)
        if len(u):
            yield pa.record_batch({"u": u, "v": v})

    return keyed.repartition("bucket", "path").sortWithinPartitions("bucket", "path").mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 3, id_col: str = "doc_id", text_col: str = "text", hot_rows: int = 20_000) -> DataFrame:
    """doc_id, fp (long), component_id: the least doc_id that is linked with the row's fingerprint,
    directly or over others."""
    fps = table(docs.select(F.col(id_col).alias("doc_id"), fingerprints(F.col(text_col), shingle).alias("fp")), "fps")
    classes = table(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    labels = components(links(classes, max_bits, hot_rows))
    known = labels.join(classes, F.col("node") == F.col("fp")).select("fp", "first", "label")
    least = known.groupBy("label").agg(F.min("first").alias("component_id"))
    linked = known.join(least, "label").select("fp", "component_id")
    of = table(classes.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id")), "of")
    return fps.join(of, "fp").select("doc_id", "fp", "component_id")
