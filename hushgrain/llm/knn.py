"""Exact top-k search by inner product: Voronoi kNN join.

Vectors are turned to integers, floor(1024 x), and scores are integer inner products. One more
coordinate, sqrt(M^2 - |v|^2) for data and 0 for queries (M: the greatest norm), makes the largest
inner product the least Euclidean distance. Queries and data are then grouped by their nearest
pivot. Small summaries, a few numbers for each pivot, bound the distance at which the queries of
each pivot have found their k neighbours; neighbouring pivots with few queries form one group. A
data row goes only to the groups that its distance to its own pivot doesn't rule out. Each cell (a
block of a query group, a shard of its data) is solved by matrix products, and the cells' best k are
merged.

Pivots grow with the root of the rows, up to 1,024. A block holds query_block queries, as many as a
task's memory allows, since each block that may need a data row costs a copy of it: at most
queries / query_block copies of a row and rows / shard_rows copies of a query. Blocks are solved in
parts, so the matrix of scores stays small.

Scores are exact: products of integers are formed in doubles where no sum can reach 2^53, in 64-bit
integers where none can reach 2^62, and in unbounded integers beyond; a score outside the range of
long counts as that range's end.

Nulls and ties: vectors that are null or hold null or non-finite components take no part, nor do
rows with a null id; shorter vectors count as padded with zeros; equal scores go to the smaller
vec_id. Rows that bear a query's own id are not its candidates, however many; repeated rows of other
ids are candidates each; a repeated query is answered once (of different vectors, the least one). An
empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hushgrain.llm.runtime import table

SCALE = 1024


def integers(vector: Column) -> Column:
    """floor(1024 x) of each component, or null if the vector takes no part."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.when(vector.isNotNull() & ~odd, F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE)))


def _matrix(lists: pa.Array, dim: int) -> np.ndarray:
    """Rows of int64, padded with zeros."""
    n, flat, sizes = len(lists), lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False)
    if (sizes == dim).all():
        return flat.reshape(n, dim)
    out = np.zeros((n, dim), np.int64)
    out[np.arange(dim)[None, :] < sizes[:, None]] = flat
    return out


def _augmented(v: np.ndarray, top: float, query: bool) -> np.ndarray:
    x = v.astype(np.float64)
    extra = np.zeros(len(x)) if query else np.sqrt(np.maximum(top - np.einsum("ij,ij->i", x, x), 0.0))
    return np.column_stack([x, extra])


def _nearest(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = np.maximum((x * x).sum(1)[:, None] - 2 * x @ pivots.T + (pivots * pivots).sum(1)[None, :], 0.0)
    j = d.argmin(1)
    return j, np.sqrt(((x - pivots[j]) ** 2).sum(1))


def _scores(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    most = float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * max(1, q.shape[1])
    if most < 2.0**53:
        return (q.astype(np.float64) @ v.astype(np.float64).T).astype(np.int64)
    if most < 2.0**62:
        return q.astype(np.int64) @ v.astype(np.int64).T
    return np.clip(q.astype(object) @ v.astype(object).T, -_BEYOND, _BEYOND).astype(np.int64)


def _groups(asked: dict[int, tuple[int, float]], apart: np.ndarray, query_block: int) -> tuple[dict[int, int], list[int]]:
    """Neighbouring pivots go together up to query_block queries: the group of each, and their
    numbers of queries."""
    group, sizes, left, at = {}, [], np.array(sorted(asked), np.int64), None
    while len(left):
        k = 0 if at is None else int(np.argmin(apart[at, left]))
        at = int(left[k])
        left = np.delete(left, k)
        n = asked[at][0]
        if not sizes or sizes[-1] + n > query_block:
            sizes.append(0)
        sizes[-1] += n
        group[at] = len(sizes) - 1
    return group, sizes


class _Best:
    """The k best candidates of some queries (ids, vectors), by score, then by the smaller id."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.score = self.other = None

    def add(self, ids: np.ndarray, v: np.ndarray) -> None:
        score = _scores(self.vectors, v)
        others = self.ids[:, None] != ids[None, :]
        if self.score is None:
            empty = [np.empty(0, np.int64)] * len(self.ids)
            self.score, self.other, self.worst = list(empty), list(empty), [None] * len(self.ids)
            rows = range(len(self.ids))
        else:
            top = np.where(others, score, -_BEYOND).max(axis=1)
            rows = [r for r, x in enumerate(top.tolist()) if self.worst[r] is None or x >= self.worst[r]]
        for r in rows:
            own = np.flatnonzero(others[r])
            s, i = np.concatenate([self.score[r], score[r][own]]), np.concatenate([self.other[r], ids[own]])
            if len(s) > self.k:
                kth = np.partition(s, len(s) - self.k)[len(s) - self.k]
                c = np.flatnonzero(s >= kth)
                c = c[np.lexsort((i[c], -s[c]))][: self.k]
                s, i = s[c], i[c]
            self.score[r], self.other[r] = s, i
            self.worst[r] = s.min() if len(s) >= self.k else None

    def rows(self) -> pa.RecordBatch | None:
        if self.score is None:
            return None
        return pa.record_batch({"query_id": np.repeat(self.ids, [len(x) for x in self.score]), "vec_id": np.concatenate(self.other), "score": np.concatenate(self.score)})


#: The ends of long, without its least value.
_BEYOND = int(np.iinfo(np.int64).max)


def _theta(reach: np.ndarray, ids: np.ndarray, k: int) -> float:
    """The (k + 1)-th least of the least reach of each id: besides the query's own id, k others lie
    within it."""
    order = np.lexsort((reach, ids))
    ids, reach = ids[order], reach[order]
    least = reach[np.concatenate(([True], ids[1:] != ids[:-1]))] if len(ids) else reach
    return float(np.partition(least, k)[k]) if len(least) > k else np.inf


def pivots_for(rows: int) -> int:
    return int(min(1024, max(64, rows**0.5 / 4)))


def search(rows: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", n_pivots: int | None = None, query_block: int = 16_384, shard_rows: int = 50_000) -> DataFrame:
    """query_id, rank, vec_id, score: for each query (a row for which is_query holds) the k best of
    all rows but its own. n_pivots bounds the sample of pivots and the summaries (n_pivots * (k + 1)
    distances; by default pivots_for(rows)); query_block and shard_rows bound a cell."""
    schema = "query_id long, rank int, vec_id long, score long"
    cells, solve = _join(rows, is_query, k, id_col, vector_col, n_pivots, query_block, shard_rows)
    if cells is None:
        return rows.sparkSession.createDataFrame([], schema)
    found = cells.repartition("cell").sortWithinPartitions("cell", F.desc("q")).mapInArrow(solve, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def copies(rows: DataFrame, is_query: Column, **options) -> DataFrame:
    """(q, n): how many copies of data rows (q false) and of queries (q true) the join shuffles."""
    cells, _ = _join(rows, is_query, **{"k": 10, "id_col": "vec_id", "vector_col": "embedding", "n_pivots": None, "query_block": 16_384, "shard_rows": 50_000} | options)
    return cells.groupBy("q").count().withColumnRenamed("count", "n")


def _join(rows: DataFrame, is_query: Column, k: int, id_col: str, vector_col: str, n_pivots: int | None, query_block: int, shard_rows: int):
    """The table of cells, one row for each copy of a row or query (None if there are no rows), and the function that
    solves them, given by cell, queries first."""
    own = rows.select(F.col(id_col).cast("long").alias("id"), integers(F.col(vector_col)).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")).where("id is not null and v is not null")
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    most = F.max(F.coalesce(F.array_max(F.transform("v", lambda x: F.abs(x.cast("double")))), F.lit(0.0)))
    size = own.agg(F.count("*"), F.max(norm), F.max(F.size("v")), most).first()
    if not size[0]:
        return None, None
    top, dim = float(size[1]), int(size[2])
    kind = "int" if size[3] < 2**31 else "long"
    own = own.withColumn("v", F.col("v").cast(f"array<{kind}>"))
    n_pivots = n_pivots or pivots_for(size[0])
    drawn = own.orderBy(F.xxhash64("id"), "id").limit(n_pivots).select("v").collect()  # the bounded sample
    pivots = np.zeros((len(drawn), dim + 1))
    for i, r in enumerate(drawn):
        pivots[i, : len(r.v)] = r.v
    pivots[:, dim] = np.sqrt(np.maximum(top - (pivots * pivots).sum(1), 0.0))
    pivots = np.unique(pivots, axis=0)
    p = len(pivots)

    def place(query: bool):
        def run(batches):
            for b in batches:
                j, d = _nearest(_augmented(_matrix(b.column(1), dim), top, query), pivots)
                yield pa.record_batch([*b.columns, pa.array(j, pa.int32()), pa.array(d)], names=["id", "v", "j", "d"])

        return run

    placed_schema = f"id long, v array<{kind}>, j int, d double"
    placed = table(own.select("id", "v").mapInArrow(place(False), placed_schema), "placed")
    queries_ = own.where("q").groupBy("id").agg(F.min("v").alias("v"))  # repeated ids are asked once
    queries_ = table(queries_.mapInArrow(place(True), placed_schema), "queries")

    # Summaries. The k + 1 least distances of each pivot, of different ids, are found in the tasks
    # first: rows that bear a query's own id aren't candidates, however many they are.
    def least(batches):
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            ids, j, d = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy()
            for x in np.unique(j).tolist():
                i, e = ids[j == x], d[j == x]
                if x in best:
                    i, e = np.concatenate([best[x][0], i]), np.concatenate([best[x][1], e])
                order = np.argsort(e, kind="stable")
                first = np.sort(np.unique(i[order], return_index=True)[1])[: k + 1]  # each id's least
                best[x] = i[order[first]], e[order[first]]
        for x, (i, e) in best.items():
            yield pa.record_batch({"j": pa.array([x] * len(e), pa.int32()), "id": i, "d": e})

    nearest = placed.select("id", "j", "d").mapInArrow(least, "j int, id long, d double").groupBy("j", "id").agg(F.min("d").alias("d"))
    near = nearest.groupBy("j").agg(F.slice(F.sort_array(F.collect_list(F.struct("d", "id"))), 1, k + 1).alias("d")).collect()
    asked = {r[0]: (r[1], r[2]) for r in queries_.groupBy("j").agg(F.count("*"), F.max("d")).collect()}
    near_pivot = np.array([r.j for r in near for _ in r.d], np.int64)
    near_id = np.array([of for r in near for _, of in r.d], np.int64)
    near_d = np.array([d for r in near for d, _ in r.d], np.float64)
    apart = np.sqrt(np.maximum((pivots * pivots).sum(1)[:, None] + (pivots * pivots).sum(1)[None, :] - 2 * pivots @ pivots.T, 0.0))
    slack = 1e-6 * (1.0 + np.sqrt(top))
    bound = np.full((p, p), np.inf)  # bound[i, j]: a data row of j nearer to its pivot isn't needed by queries of i
    for i, (_, far) in asked.items():
        theta = _theta(far + apart[i, near_pivot] + near_d, near_id, k)
        bound[i] = apart[i] - far - theta - slack
    group, size_of = _groups(asked, apart, query_block)
    needs = [bound[[i for i in asked if group[i] == g]].min(axis=0) for g in range(len(size_of))]
    blocks = np.array([-(-n // query_block) for n in size_of], np.int64)
    shards = max(1, -(-size[0] // shard_rows))

    def mixed(ids: np.ndarray) -> np.ndarray:
        return ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64)

    def spread(batches):
        """A copy of each data row for each cell that needs it."""
        for b in batches:
            ids, v, j, d = b.column(0).to_numpy(), b.column(1), b.column(2).to_numpy(), b.column(3).to_numpy()
            for g, need in enumerate(needs):
                at = np.flatnonzero(d >= need[j])
                for block in range(blocks[g]):
                    if len(at):
                        cell = (g * 1_000_000 + block) * np.int64(1_000_000) + mixed(np.arange(len(at)) + ids[at]) % shards
                        yield pa.record_batch({"cell": cell, "q": np.zeros(len(at), bool), "id": ids[at], "v": v.take(pa.array(at))})

    def ask(batches):
        """A copy of each query for each shard of its block."""
        for b in batches:
            ids, v, j = b.column(0).to_numpy(), b.column(1), b.column(2).to_numpy()
            g = np.array([group[x] for x in j.tolist()], np.int64)
            base = (g * 1_000_000 + mixed(ids) % blocks[g]) * np.int64(1_000_000)
            for s in range(shards):
                yield pa.record_batch({"cell": base + s, "q": np.ones(len(ids), bool), "id": ids, "v": v})

    def solve(batches):
        """Rows come by cell, queries first."""
        cell, ids, vectors, parts = None, [], [], None

        def out():
            for x in parts or ():
                if (rows_ := x.rows()) is not None:
                    yield rows_

        for b in batches:
            cells, q, i = b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_numpy()
            v = _matrix(b.column(3), dim)
            edges = np.flatnonzero(np.concatenate(([True], (cells[1:] != cells[:-1]) | (q[1:] != q[:-1]))))
            for a, z in zip(edges.tolist(), [*edges[1:].tolist(), len(cells)]):
                if cells[a] != cell:
                    yield from out()
                    cell, ids, vectors, parts = cells[a], [], [], None
                if q[a]:
                    ids.append(i[a:z])
                    vectors.append(v[a:z])
                elif ids:
                    if parts is None:
                        own_ids, own_vectors = np.concatenate(ids), np.concatenate(vectors)
                        parts = [_Best(own_ids[x : x + _PART], own_vectors[x : x + _PART], k) for x in range(0, len(own_ids), _PART)]
                    for x in parts:
                        x.add(i[a:z], v[a:z])
        yield from out()

    shape = f"cell long, q boolean, id long, v array<{kind}>"
    return placed.mapInArrow(spread, shape).unionAll(queries_.mapInArrow(ask, shape)), solve


#: Queries of a cell that are multiplied at once.
_PART = 1024
