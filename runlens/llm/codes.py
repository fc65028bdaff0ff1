"""Product codes of vectors: codebooks fitted by distributed integer sums, entries found in a kd-tree.

Components become whole numbers, floor(4096 x), so that every distance, sum and mean is exact and no order of adding them
matters. A vector is cut into PARTS equal parts, each with a codebook of ENTRIES entries. The codebooks (a few thousand
numbers, whatever the table's size) go to the tasks each round; a task builds a kd-tree over each codebook's entries and
walks it for a whole batch of parts at once: boxes whose bound exceeds a part's best distance are left out, boxes whose
bound equals it are still visited, so that of equally near entries the lower index is found. What comes back of a round
is a count and the sums of each entry from each task, added up by an aggregation.

Defined results: a vector that is null, empty, or holds a null or non-finite component takes no part, nor does one whose
length is no multiple of PARTS or differs from that of the first kept vector by (vec_id, vector), nor one with a component
of LARGEST or more (8192, before which distances stay whole in 64 bits). The first ENTRIES kept vectors in that order, null ids last, start the
codebooks; with fewer vectors codebooks are smaller; repeated rows each count; an entry that no part is nearest to stays.
Null labels are one label. An empty table has no rows and no codebooks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runlens.session import materialise

SCALE = 4096
PARTS, ENTRIES, ROUNDS = 8, 16, 6
LARGEST = 8192.0
LEAF = 2  # entries
BROADCAST_LABELS, SALTS = 1_000_000, 64
_FAR = np.iinfo(np.int64).max


class EntryTree:
    """A kd-tree over the entries of one codebook: tight boxes, median splits of the widest dimension."""

    def __init__(self, entries: np.ndarray) -> None:
        self.entries = entries
        self.low, self.high, self.child, self.own = [], [], [], []
        todo = [(np.arange(len(entries)), -1)]
        while todo:
            some, parent = todo.pop()
            node = len(self.own)
            if parent >= 0:
                self.child[parent].append(node)
            part = entries[some]
            low, high = part.min(0), part.max(0)
            self.low.append(low)
            self.high.append(high)
            self.child.append([])
            wide = int((high - low).argmax())
            split = len(some) > LEAF and high[wide] > low[wide]
            self.own.append(some[:0] if split else some)
            if split:
                order = some[np.argsort(part[:, wide], kind="stable")]
                todo += [(order[: len(order) // 2], node), (order[len(order) // 2 :], node)]

    def _bound(self, node: int, x: np.ndarray) -> np.ndarray:
        """Squared distance from each part to the box of a node."""
        off = np.maximum(np.maximum(self.low[node] - x, x - self.high[node]), 0)
        return (off * off).sum(1)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of the nearest entry of each part, the lower index among equals."""
        best, index = np.full(len(x), _FAR), np.zeros(len(x), np.int64)
        stack = [(0, np.arange(len(x)), np.zeros(len(x), np.int64))]
        while stack:
            node, some, bound = stack.pop()
            some = some[bound <= best[some]]
            if not len(some):
                continue
            for e in self.own[node].tolist():
                gap = x[some] - self.entries[e]
                d = (gap * gap).sum(1)
                take = (d < best[some]) | ((d == best[some]) & (e < index[some]))
                best[some[take]], index[some[take]] = d[take], e
            if self.child[node]:
                a, b = self.child[node]
                to_a, to_b = self._bound(a, x[some]), self._bound(b, x[some])
                near = to_a <= to_b
                # the nearer child of each part comes off the stack first
                stack += [(b, some[near], to_b[near]), (a, some[~near], to_a[~near]), (b, some[~near], to_b[~near]), (a, some[near], to_a[near])]
        return index, best


def whole_parts(col: pa.Array, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows take part, and their integer components, a row each."""
    col = col.cast(pa.large_list(pa.float64()))
    size = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    fits = np.flatnonzero(size == length)
    flat = col.take(pa.array(fits)).flatten().to_numpy(zero_copy_only=False).reshape(len(fits), length)
    with np.errstate(invalid="ignore"):
        good = (np.abs(flat) < LARGEST).all(1)  # neither NaN (null) nor infinite
    return fits[good], np.floor(flat[good] * SCALE).astype(np.int64)


def assign(parts: np.ndarray, trees: list[EntryTree]) -> tuple[np.ndarray, np.ndarray]:
    """Entries (rows x parts) and squared distances of vectors, a row each."""
    found = [t.nearest(x) for t, x in zip(trees, np.split(parts, len(trees), axis=1), strict=True)]
    return np.stack([i for i, _ in found], 1), np.stack([d for _, d in found], 1)


def first_entries(vectors: DataFrame, parts: int, entries: int) -> list[np.ndarray] | None:
    """Each part's first codebook: that part of the first kept vectors. What comes to the driver is `entries` vectors."""
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE))
    fine = F.forall("embedding", lambda x: F.coalesce((F.abs(x.cast("double")) < LARGEST) & ~F.isnan(x), F.lit(False)))
    kept = vectors.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & (F.pmod(F.size("embedding"), F.lit(parts)) == 0) & fine)
    order = [F.col("vec_id").asc_nulls_last(), F.col("embedding")]
    first = kept.select("vec_id", "embedding").orderBy(*order).limit(1).collect()
    if not first:
        return None
    length = len(first[0]["embedding"])
    rows = kept.where(F.size("embedding") == length).orderBy(*order).limit(entries).select(whole.alias("v")).collect()
    return np.split(np.array([r["v"] for r in rows], np.int64), parts, axis=1)


def _sums(books: list[np.ndarray]):
    """For each entry of each codebook that parts of the task's vectors are nearest to: how many, and their sums."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [EntryTree(b) for b in books]
        count = [np.zeros(len(b), np.int64) for b in books]
        total = [np.zeros_like(b) for b in books]
        for batch in batches:
            _, v = whole_parts(batch.column("embedding"), sum(b.shape[1] for b in books))
            index, _ = assign(v, trees)
            for p, x in enumerate(np.split(v, len(books), axis=1)):
                count[p] += np.bincount(index[:, p], minlength=len(books[p]))
                np.add.at(total[p], index[:, p], x)
        part, entry, n, sums = [], [], [], []
        for p, c in enumerate(count):
            for e in np.flatnonzero(c).tolist():
                part.append(p)
                entry.append(e)
                n.append(int(c[e]))
                sums.append(total[p][e].tolist())
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(n, pa.int64()), pa.array(sums, pa.list_(pa.int64()))], ["part", "entry", "n", "sums"])

    return step


def fit(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray] | None:
    """The codebooks (entries x components of a part), or None without vectors. A round is one pass over the vectors."""
    books = first_entries(vectors, parts, entries)
    if books is None:
        return None
    for _ in range(rounds):
        per_task = vectors.select("embedding").mapInArrow(_sums(books), "part int, entry int, n bigint, sums array<bigint>")
        each = per_task.select("part", "entry", "n", F.posexplode("sums").alias("i", "x"))
        new = each.groupBy("part", "entry", "i").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x"), F.sum("n").alias("n"))
        books = [b.copy() for b in books]
        for r in new.collect():  # parts x entries x components of a part
            books[r["part"]][r["entry"], r["i"]] = int(r["x"]) // r["n"]
    return books


def encode(vectors: DataFrame, books: list[np.ndarray] | None) -> DataFrame:
    """The rows that take part, with code (an entry's index for each part) and error (squared distances summed) in place of the vector."""
    keep = [c for c in vectors.columns if c not in ("embedding", "code", "error")]
    rows = vectors.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row"), "embedding")
    kind = T.StructType([rows.schema["row"], T.StructField("code", T.ArrayType(T.IntegerType())), T.StructField("error", T.LongType())])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [EntryTree(b) for b in books]
        for batch in batches:
            at, v = whole_parts(batch.column("embedding"), sum(b.shape[1] for b in books))
            index, gap = assign(v, trees)
            code = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * len(books), pa.int32()), pa.array(index.ravel(), pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("row").take(pa.array(at)), code, pa.array(gap.sum(1))], ["row", "code", "error"])

    if books is None:
        coded = rows.where("false").select("row", F.lit(None).cast("array<int>").alias("code"), F.lit(None).cast("bigint").alias("error"))
    else:
        coded = rows.mapInArrow(step, kind)
    return coded.select(*(F.col(f"row.`{c}`") for c in keep), "code", "error")


def decode(coded: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """The rows with the vectors that their codes stand for, as column `approx` of whole numbers."""
    entries = F.array(*(F.array(*(F.array(*(F.lit(int(x)) for x in e)) for e in b)) for b in books))
    approx = F.flatten(F.transform("code", lambda e, p: F.element_at(F.element_at(entries, p + 1), e + 1)))
    return coded.withColumn("approx", approx)


def digest(books: list[np.ndarray] | None) -> str:
    """sha256 of all components by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(x) for b in books or [] for x in b.ravel().tolist()).encode()).hexdigest()


def with_label_error(coded: DataFrame) -> DataFrame:
    """Adds label_error, the sum of `error` over equal labels. Sums are few and broadcast, or else met in salted parts."""
    sums = materialise(coded.sparkSession, coded.groupBy("label").agg(F.sum("error").alias("label_error")))
    labels = sums.count()
    named = sums.withColumnRenamed("label", "_label")
    if labels <= BROADCAST_LABELS:
        return coded.join(F.broadcast(named), F.col("label").eqNullSafe(F.col("_label"))).drop("_label")
    salted = named.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    own = coded.withColumn("_own", F.pmod(F.xxhash64("vec_id", "code", "error"), F.lit(SALTS)).cast("int"))
    return own.join(salted, (F.col("_own") == F.col("_salt")) & F.col("label").eqNullSafe(F.col("_label"))).drop("_label", "_salt", "_own")


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, label, code, error, label_error, codebooks_sha256) of every vector that takes part."""
    own = vectors.select("vec_id", "label", "embedding")
    books = fit(own, parts, entries, rounds)
    coded = materialise(own.sparkSession, encode(own, books))
    return with_label_error(coded).withColumn("codebooks_sha256", F.lit(digest(books)))
