"""Exact top-k inner-product search with a KD-tree per shard.

Components are made whole numbers, floor(1024 x), so that scores are exact. Vectors are dealt by a hash of their id into
shards of SHARD_ROWS at most, and every query visits every shard: a join in which a task holds one shard, as KD-trees
(median splits of the widest dimension, tight boxes), and queries stream past it in batches. Each query first dives to
its most promising leaf, then boxes are visited, the better child first, for the queries whose bound - the inner product
with the box's best corner - still reaches their k-th score. One shard in SEED_SHARE goes first; the k-th score that a
query has there bounds what it looks for in all others. Nothing passes through the driver but one count.

Defined results: null ids, null vectors and vectors with a null or non-finite component take no part; rows that share
the query's id count as its own and are no candidates; equal queries count once; vectors are held against those of
their own length only; ties go to the smaller id; with fewer candidates than k all are returned; scores beyond 64 bits
are cut to that range.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.session import materialise

SCALE = 1024
EVERY = 100
K = 10
SHARD, LEAF = 8192, 64  # rows of a tree and of a leaf
SHARD_ROWS = 65_536  # of all trees of a shard; fewer where there are few rows, so that there are shards enough to go round
LEAST_ROWS, SHARDS = 2048, 64
SEED_SHARE = 64
_LOW = -(1 << 63)


def whole_numbers(ids: pa.Array, col: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """Ids and integer vectors of the rows that take part."""
    col = col.cast(pa.large_list(pa.float64()))
    keep = pc.and_(pc.is_valid(ids), pc.is_valid(col))
    ids, col = ids.filter(keep), col.filter(keep)
    size = pc.list_value_length(col).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = col.flatten().to_numpy(zero_copy_only=False)  # null components become NaN
    at = np.concatenate(([0], np.cumsum(size)))
    bad = np.concatenate(([0], np.cumsum(~np.isfinite(flat))))
    ok = (bad[at[1:]] == bad[at[:-1]]) & (size > 0)
    with np.errstate(invalid="ignore", over="ignore"):
        flat = np.floor(flat * SCALE)
    return ids.to_numpy()[ok], [flat[a:b] for a, b in zip(at[:-1][ok], at[1:][ok], strict=True)]


def products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact inner products, as 64-bit integers."""
    if q.size and v.size and np.abs(q).max() * np.abs(v).max() * q.shape[1] >= 2.0**53:
        big = np.array([[int(x) for x in r] for r in q], object) @ np.array([[int(x) for x in r] for r in v], object).T
        return np.clip(big, _LOW, (1 << 63) - 1).astype(np.int64)
    return (q @ v.T).astype(np.int64)


class Best:
    """The k best (score, id) of each query so far; the k-th score starts at `floor`."""

    def __init__(self, ids: np.ndarray, k: int, floor: np.ndarray) -> None:
        self.own, self.k, self.kth = ids, k, floor.copy()
        self.score = np.full((len(ids), k), _LOW, np.int64)
        self.id = np.full((len(ids), k), np.iinfo(np.int64).max, np.int64)
        self.filled = np.zeros((len(ids), k), bool)

    def add(self, some: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """score: (queries of some) x ids."""
        fits = (score >= self.kth[some, None]) & (ids[None, :] != self.own[some, None])
        hit = np.flatnonzero(fits.any(1))
        if not len(hit):
            return
        some, score, fits = some[hit], score[hit], fits[hit]
        s = np.concatenate((self.score[some], np.where(fits, score, _LOW)), 1)
        i = np.concatenate((self.id[some], np.broadcast_to(ids, score.shape)), 1)
        f = np.concatenate((self.filled[some], fits), 1)
        order = np.lexsort((i, ~s, ~f), axis=1)[:, : self.k]
        self.score[some], self.id[some], self.filled[some] = (np.take_along_axis(x, order, 1) for x in (s, i, f))
        full = self.filled[some, -1]
        self.kth[some[full]] = np.maximum(self.kth[some[full]], self.score[some[full], -1])


class KDTree:
    """Nodes in an array: box corners, children (-1 in leaves) and the range of rows."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray) -> None:
        order = np.arange(len(ids))
        self.low, self.high, self.child, self.range = [], [], [], []
        todo = [(0, len(ids), -1)]
        while todo:
            a, b, parent = todo.pop()
            node = len(self.range)
            if parent >= 0:
                self.child[parent].append(node)
            part = rows[order[a:b]]
            low, high = part.min(0), part.max(0)
            self.low.append(low)
            self.high.append(high)
            self.child.append([])
            self.range.append((a, b))
            wide = int((high - low).argmax())
            if b - a > LEAF and high[wide] > low[wide]:
                mid = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(part[:, wide], mid)]
                todo += [(a, a + mid, node), (a + mid, b, node)]
        self.low, self.high = np.array(self.low), np.array(self.high)
        self.ids, self.rows = ids[order], rows[order]

    def search(self, queries: np.ndarray, best: Best) -> None:
        up, down = np.maximum(queries, 0), np.minimum(queries, 0)
        # of every box for every query; widened by what rounding may take off
        bound = up @ self.high.T + down @ self.low.T
        bound += np.abs(bound) * 1e-12 + 1e-3
        leaves = np.array([n for n, c in enumerate(self.child) if not c])
        dive = leaves[bound[:, leaves].argmax(1)]
        for n in np.unique(dive):
            self._leaf(n, np.flatnonzero(dive == n), queries, best)
        stack = [(0, np.arange(len(queries)))]
        while stack:
            n, some = stack.pop()
            some = some[bound[some, n] >= best.kth[some]]
            if not len(some):
                continue
            if self.child[n]:
                order = sorted(self.child[n], key=lambda c: bound[some, c].sum())
                stack += [(c, some) for c in order]
            else:
                self._leaf(n, some[dive[some] != n], queries, best)

    def _leaf(self, n: int, some: np.ndarray, queries: np.ndarray, best: Best) -> None:
        a, b = self.range[n]
        for i in range(a, b, SHARD // 4) if b - a > SHARD // 4 else (a,):  # a large leaf holds equal vectors
            j = min(b, i + SHARD // 4)
            if len(some):
                best.add(some, products(queries[some], self.rows[i:j]), self.ids[i:j])


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds a name to each query that takes part: a digest of its whole numbers."""
    for batch in batches:
        keep, names = [], []
        for i in range(batch.num_rows):
            _, vecs = whole_numbers(batch.column("id").slice(i, 1), batch.column("embedding").slice(i, 1))
            if vecs:
                keep.append(i)
                names.append(xxhash.xxh3_128_digest(vecs[0].tobytes()))
        some = batch.take(pa.array(keep, pa.int64()))
        yield pa.RecordBatch.from_arrays([some.column("w"), some.column("id"), pa.array(names, pa.binary()), some.column("embedding")], ["w", "id", "q", "embedding"])


def _walk(k: int):
    """Rows sorted by (w, shard, side): a shard's vectors, then the queries; at most k results of the shard for each query."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: tuple[int, int] | None = None
        ids: list[np.ndarray] = []
        rows: list[np.ndarray] = []
        trees: list[KDTree] = []

        def plant() -> None:
            if rows:
                trees.append(KDTree(np.concatenate(ids), np.stack(rows)))
                ids.clear()
                rows.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            place = np.column_stack([batch.column(c).to_numpy() for c in ("w", "shard", "side")])
            edges = np.append(np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]).any(1)))), len(place)).tolist()
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                w, shard, side = place[a].tolist()
                if (w, shard) != at:
                    at = (w, shard)
                    ids.clear()
                    rows.clear()
                    trees.clear()
                part = batch.slice(a, b - a)
                if side == 0:
                    for i in range(0, part.num_rows, SHARD):
                        own, vecs = whole_numbers(part.column("id").slice(i, SHARD), part.column("embedding").slice(i, SHARD))
                        ids.append(own)
                        rows += vecs
                        if len(rows) >= SHARD:
                            plant()
                    continue
                plant()
                names, vecs = whole_numbers(part.column("id"), part.column("embedding"))
                best = Best(names, k, part.column("floor").fill_null(_LOW).to_numpy(zero_copy_only=False))
                for tree in trees:
                    tree.search(np.stack(vecs), best)
                q, r = np.nonzero(best.filled)
                yield pa.RecordBatch.from_arrays([part.column("q").take(pa.array(q)), pa.array(names[q]), pa.array(best.id[q, r]), pa.array(best.score[q, r])], ["q", "query_id", "vec_id", "score"])

    return step


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("q", "query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def search(vectors: DataFrame, queries: Column | None = None, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that `queries` chooses (every id divisible by EVERY) its k best others."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding")
    rows = rows.withColumn("w", F.size("embedding")).where("vec_id is not null and w > 0")
    wanted = F.coalesce(F.pmod("vec_id", F.lit(EVERY)) == 0 if queries is None else queries, F.lit(False))
    asked = rows.where(wanted).select("w", F.col("vec_id").alias("id"), "embedding").mapInArrow(_named, f"w int, id bigint, q binary, embedding {rows.schema['embedding'].dataType.simpleString()}")
    asked = materialise(spark, asked.dropDuplicates(["id", "q"]))
    n = rows.count()
    per_shard = min(SHARD_ROWS, max(LEAST_ROWS, -(-n // SHARDS)))
    shards = max(1, -(-n // per_shard))
    first = -(-shards // SEED_SHARE)  # shards that go first
    dealt = rows.select("w", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("side"), F.col("vec_id").alias("id"), F.lit(None).cast("binary").alias("q"), F.lit(None).cast("bigint").alias("floor"), "embedding")

    def visit(asked: DataFrame, a: int, b: int) -> DataFrame:
        """What the queries find in the shards from a to b - 1."""
        each = asked.withColumns({"side": F.lit(1), "shard": F.explode(F.sequence(F.lit(a), F.lit(b - 1)))}).select(dealt.columns)
        both = dealt.where(F.col("shard").between(a, b - 1)).unionByName(each)
        return both.repartition("w", "shard").sortWithinPartitions("w", "shard", "side").mapInArrow(_walk(k), "q binary, query_id bigint, vec_id bigint, score bigint")

    found = materialise(spark, _best(visit(asked.withColumn("floor", F.lit(None).cast("bigint")), 0, first), k))
    if first < shards:
        kth = found.where(F.col("rank") == k).select("q", F.col("query_id").alias("id"), F.col("score").alias("floor"))
        found = _best(found.drop("rank").unionByName(visit(asked.join(kth, ["q", "id"], "left"), first, shards)), k)
    return found.select("query_id", "rank", "vec_id", "score")
