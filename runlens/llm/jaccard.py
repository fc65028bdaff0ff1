"""Similarity join of documents on word shingles: count vectors, an R-tree over them, and an exact check.

A document's set is its distinct 4-word shingles. Shingles are hashed into groups; the counts by group are a point, and
the overlap of two sets is at most the sum of the smaller counts. Linked documents share shingles among the first
21 % + 1 of their sets, in an order that puts frequent shingles last; those that the same sets hold name one part of the
index, where they meet, so no document is held against the whole corpus. In each part an R-tree over the points (leaves
with boxes, joined leaf with leaf) leaves the pairs whose bound allows a link, and those are checked word by word.

Links are only looked for between components that are still apart, in rounds:
  1. each set with the hub (smallest member) of the parts where it shares most;
  2. each set with its best partners by the bound, in one part alone: the largest of its parts that still hold several;
  3. each component outside a part's main one with its best partners, in all parts that still hold several;
  4. all pairs the bound allows, in those parts where that left some out.
So a group of thousands of copies, which stands in dozens of parts, costs links in proportion to its size and not that
times its parts, and no link between components is lost.

Texts of the same words count as one set, told by a SHA-256 digest of those words. Parts list at most MEMBERS sets a row;
large ones are cut by size and into blocks of at most BLOCK sets that meet pairwise, each in a task group of its own. A
text that many pairs share is sent once for BESIDE of them. The order of shingles only steers the work: any order gives
the same links.

Defined results: null, empty and blank texts have an empty set (0 shingles) and are their own component; a text of one
to three words is a set of one; repeated rows are linked like any copies; a row of null id gets the component of its
copies (null if there are none); an empty table gives an empty result. Extra columns take no part. Shingles are counted
by 63-bit hashes, links by the words themselves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runlens.llm.components import components
from runlens.llm.spans import LOWER, HashTable, buffer_of, byte_class, find_words, hash_spans, mix, runs_of, texts_of
from runlens.session import discard, materialise

WORDS = 4
SHARE = 85  # per cent: linked if 100 * overlap >= SHARE * union
WORD = byte_class(outside=" \t\n\r\f\v")
FREQUENT = 1000  # a shingle is frequent from one in so many documents on
MOST_FREQUENT = 500_000  # of them steer the order; the bound of what is broadcast
BLOCK, LEAF = 512, 32
MEMBERS = 1024  # of a part in one row
PARTNERS = 4
BESIDE = 64  # pairs that a shared text is sent for at once
COUNTED = 1 << 20  # shingles that are counted together
NAME_BYTES = 8
BROADCAST_ROWS = 1_000_000
MEET = 16  # of a set of n, 1 + n // MEET indexed shingles at least stand in a linked set's index too
_K = np.uint64(0x9E3779B97F4A7C15)


def shingles(h: np.ndarray, first: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of texts, given their words' hashes, and the text of each."""
    n = np.diff(first)
    owner = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(h)) - np.repeat(first[:-1], n)
    whole = n[owner] >= words
    at = np.flatnonzero(whole & (place + words <= n[owner]))
    out = np.zeros(len(at), np.uint64)
    for k in range(words):
        out = out * _K + h[at + k]
    short = np.flatnonzero((n > 0) & (n < words))
    rest = np.zeros(len(short), np.uint64)
    for k in range(words - 1):
        has = n[short] > k
        rest[has] = rest[has] * _K + h[first[short[has]] + k]
    rest += n[short].astype(np.uint64)
    return mix(np.concatenate((out, rest))), np.concatenate((owner[at], short))


def _sets(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, words: int, frequent: HashTable | None) -> tuple[np.ndarray, np.ndarray]:
    h, owner = shingles(hash_spans(buf, starts, ends), first, words)
    key = h >> np.uint64(1)
    if frequent is not None and frequent.n:
        key |= (frequent.find(key) >= 0).astype(np.uint64) << np.uint64(63)
    order = np.lexsort((key, owner))
    key, owner = key[order], owner[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
    key, owner = key[new], owner[new]
    return key, np.searchsorted(owner, np.arange(len(first)))


def sets_of(col: pa.LargeStringArray, words: int, frequent: HashTable | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of each text in ascending order, and where each text's begin. A key is a shingle's hash, frequent ones with the highest bit set."""
    buf, at = buffer_of(col)
    buf = LOWER[buf]
    return _sets(buf, *find_words(buf, at, WORD), words, frequent)


def _digests(buf: np.ndarray, at: np.ndarray, ends: np.ndarray, first: np.ndarray) -> list[bytes]:
    """A digest of each text's words with one blank between them."""
    keep = WORD[buf]
    inner = np.ones(len(ends), bool)
    inner[first[1:][first[1:] > first[:-1]] - 1] = False  # no blank after a text's last word
    keep[ends[inner]] = True
    plain = buf.copy()
    plain[ends[inner]] = 32
    upto = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(keep, out=upto[1:])
    raw, cut = plain[keep].tobytes(), upto[at].tolist()
    return [hashlib.sha256(raw[a:b]).digest()[:16] for a, b in zip(cut[:-1], cut[1:], strict=True)]


def digest_of(words: list[bytes]) -> bytes:
    """The same for one text."""
    return hashlib.sha256(b" ".join(words)).digest()[:16]


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()  # bytes: A-Z alone are lowered, ASCII white space alone parts words


def groups_for(n: int) -> int:
    """Groups of the count vector of a set of n: powers of two, so that a finer vector folds into a coarser one. Linked sets have as many, or one twice as many."""
    return min(1 << 16, max(64, 1 << max(n - 1, 0).bit_length()))


_SHIFT = np.array([0, 2, 4, 6], np.uint8)
_OPEN = (np.arange(256, dtype=np.uint8)[:, None] >> _SHIFT) & 3


def pack(key: np.ndarray) -> bytes:
    """The count vector of a set: counts up to 3 in two bits each, after what the larger ones exceed it by (4 bytes)."""
    groups = groups_for(len(key))
    counts = np.bincount((key & np.uint64(groups - 1)).astype(np.int64), minlength=groups)
    low = np.minimum(counts, 3).astype(np.uint8)
    return int(len(key) - low.sum(dtype=np.int64)).to_bytes(4, "little") + np.bitwise_or.reduce(low.reshape(-1, 4) << _SHIFT, axis=1).tobytes()


def unpack(vec: bytes) -> tuple[int, np.ndarray]:
    """(excess, counts)"""
    return int.from_bytes(vec[:4], "little"), _OPEN[np.frombuffer(vec, np.uint8, offset=4)].ravel()


def unpack_all(vecs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The same for vectors of one length, a row for each."""
    raw = np.frombuffer(b"".join(vecs), np.uint8).reshape(len(vecs), -1)
    return np.ascontiguousarray(raw[:, :4]).view("<u4").ravel().astype(np.int64), _OPEN[raw[:, 4:]].reshape(len(vecs), -1)


def fold(v: np.ndarray, groups: int) -> np.ndarray:
    """Vectors (rows, or one) in fewer groups."""
    n = v.shape[-1]
    return v if n == groups else v.reshape(*v.shape[:-1], -1, groups).sum(-2, dtype=np.uint8 if n <= 64 * groups else np.uint16)


def first_keys(n: np.ndarray, share: int) -> np.ndarray:
    """How many keys of a set are indexed: two linked sets share 1 + m // MEET of these, m being the smaller size."""
    return np.where(n > 0, np.minimum(n, n * (100 - share) // 100 + 1 + n // MEET), 0)


def need(a: np.ndarray | int, b: np.ndarray | int, share: int):
    """The least overlap that links sets of these sizes."""
    return -(-share * (a + b) // (100 + share))


def _frequent(docs: DataFrame, words: int) -> np.ndarray:
    """Shingles found in about one of FREQUENT documents or more. Tasks report what they hold several times."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []
        seen = size = 0

        def report() -> pa.RecordBatch:
            names, n = np.unique(np.concatenate(keys), return_counts=True)
            some = n >= max(4, seen // FREQUENT)
            keys.clear()
            return pa.RecordBatch.from_arrays([pa.array(names[some].astype(np.int64)), pa.array(n[some].astype(np.int64))], ["h", "n"])

        for batch in batches:
            col = texts_of(batch.column("text"))
            for i, j in runs_of(col):
                keys.append(sets_of(col.slice(i, j - i), words)[0])
                seen, size = seen + j - i, size + len(keys[-1])
                if size >= COUNTED:
                    yield report()
                    seen = size = 0
        if keys:
            yield report()

    total = docs.count()
    found = docs.select("text").mapInArrow(count, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= max(16, total // FREQUENT))
    return found.orderBy(F.desc("n"), "h").limit(MOST_FREQUENT).select("h").toArrow().column(0).to_numpy().astype(np.uint64)


SKETCH = "doc_id bigint, n bigint, fp bigint, digest binary, vec binary, keys array<bigint>"


def _sketch(docs: DataFrame, words: int, share: int) -> DataFrame:
    """Per row: doc_id, n (set size), digest (of the words), fp (names it), vec (count vector), keys (the first of the set)."""
    held, name_bytes = docs.sparkSession.sparkContext.broadcast(_frequent(docs, words)), NAME_BYTES

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = HashTable()
        if len(held.value):
            frequent.add(held.value, np.arange(len(held.value)))
        for batch in batches:
            col, ids = texts_of(batch.column("text")), batch.column("doc_id")
            for i, j in runs_of(col):
                buf, begins = buffer_of(col.slice(i, j - i))
                buf = LOWER[buf]
                starts, ends, words_at = find_words(buf, begins, WORD)
                digests = _digests(buf, begins, ends, words_at)
                key, at = _sets(buf, starts, ends, words_at, words, frequent)
                n = np.diff(at)
                fp = [int.from_bytes(d[:name_bytes], "little", signed=True) for d in digests]
                vecs = [pack(key[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                first = first_keys(n, share)
                rank = np.arange(len(key)) - np.repeat(at[:-1], n)
                some = rank < np.repeat(first, n)
                offsets = np.zeros(len(n) + 1, np.int32)
                np.cumsum(first, out=offsets[1:])
                keys = pa.ListArray.from_arrays(pa.array(offsets), pa.array(key[some].view(np.int64)))
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.array(n), pa.array(fp, pa.int64()), pa.array(digests, pa.binary()), pa.array(vecs, pa.binary()), keys], ["doc_id", "n", "fp", "digest", "vec", "keys"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(step, SKETCH)


def _named(sketch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The sketch with one fp for each digest, and the sets of rows with an id: (fp, digest, doc_id, n). Where two digests begin alike they are named anew."""
    spark, salt = sketch.sparkSession, 0
    while True:
        own = sketch.where("n > 0").groupBy("fp").agg(F.min("digest").alias("digest"), F.max("digest").alias("other"), F.min("doc_id").alias("doc_id"), F.max("n").alias("n"))
        own = materialise(spark, own)
        twice = own.where("digest <> other").select("fp", F.lit(True).alias("_t"))
        if twice.isEmpty():
            return sketch, own
        anew = F.when(F.col("_t"), F.xxhash64("digest", F.lit(salt))).otherwise(F.col("fp"))
        sketch = materialise(spark, sketch.join(twice, "fp", "left").withColumn("fp", anew).select(sketch.columns))
        salt += 1


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (h, fp): the sets that hold each key, if they are several; (part, m0, m1, members), m0 and m1 name the members.

    A key whose members all stand in one row is named by them, so that keys of the same members fall together. One that goes
    on in another row or may do so in another task is named by itself, and its rows are one part.
    """
    h, fp = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    first = True  # the task's first key may have begun in another task

    def rows(h: np.ndarray, fp: np.ndarray, cut: np.ndarray, open_: np.ndarray) -> pa.RecordBatch:
        """cut: where each row begins, and the end."""
        size = np.diff(cut)
        m0, m1 = (np.add.reduceat(mix(fp.view(np.uint64) ^ np.uint64(x)), cut[:-1]) for x in (0x51, 0xA7))
        part = np.where(open_, mix(h[cut[:-1]] ^ np.uint64(0xD6E8FEB86659FD93)), mix(m0 ^ mix(m1 + size.astype(np.uint64))))
        keep = (size > 1) | open_
        inside = np.repeat(keep, size)
        offsets = np.concatenate(([0], np.cumsum(size[keep]))).astype(np.int32)
        members = pa.ListArray.from_arrays(pa.array(offsets), pa.array(fp[inside]))
        return pa.RecordBatch.from_arrays([*(pa.array(x[keep].view(np.int64)) for x in (part, m0, m1)), members], ["part", "m0", "m1", "members"])

    for batch in _and_end(batches):
        if batch is not None:
            h = np.concatenate((h, batch.column("h").to_numpy().view(np.uint64)))
            fp = np.concatenate((fp, batch.column("fp").to_numpy()))
        if not len(h):
            continue
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (fp[1:] != fp[:-1])
        h, fp = h[new], fp[new]
        edge = np.append(np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))), len(h))
        size = np.diff(edge)
        last = len(size) - 1
        open_ = size > MEMBERS
        open_[0] |= first
        if batch is None:
            open_[last] = True
        else:
            # the last key waits for the next batch, except for whole rows of a long one
            wait = int(size[last]) - (int(size[last]) // MEMBERS * MEMBERS if size[last] > 2 * MEMBERS else 0)
            open_[last] |= wait < size[last]
        cuts, flags = [], []
        for k in np.flatnonzero(open_).tolist():
            a, b = int(edge[k]), int(edge[k + 1]) - (wait if batch is not None and k == last else 0)
            cuts += list(range(a, b, MEMBERS))
            flags += [True] * len(range(a, b, MEMBERS))
        upto = len(h) if batch is None else len(h) - wait
        plain = ~open_
        if batch is not None:
            plain[last] = False
        cut = np.concatenate((edge[:-1][plain], np.array(cuts, np.int64)))
        flag = np.concatenate((np.zeros(int(plain.sum()), bool), np.array(flags, bool)))
        order = np.argsort(cut, kind="stable")
        cut, flag = cut[order], flag[order]
        if len(cut):
            yield rows(h[:upto], fp[:upto], np.append(cut, upto), flag)
        if batch is not None:
            if upto > edge[last]:  # the rest of the last key belongs to a part that is open already
                first = True
            elif last:
                first = False
            h, fp = h[upto:], fp[upto:]


def _bounds(share: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of pairs (a, b) with sizes and count vectors of both: those that may be linked."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = batch.column("na").to_numpy(), batch.column("nb").to_numpy()
            va, vb = batch.column("va").to_pylist(), batch.column("vb").to_pylist()
            lens = np.array([[len(x), len(y)] for x, y in zip(va, vb, strict=True)], np.int64).reshape(-1, 2)
            ok = np.zeros(len(na), bool)
            for kind in np.unique(lens, axis=0):
                some = np.flatnonzero((lens == kind).all(1))
                (more_a, pa_), (more_b, pb_) = (unpack_all([v[i] for i in some]) for v in (va, vb))
                g = min(pa_.shape[1], pb_.shape[1])
                top = np.minimum(fold(pa_, g), fold(pb_, g)).sum(1, dtype=np.int64) + np.minimum(more_a, more_b)
                ok[some] = np.minimum(top, np.minimum(na[some], nb[some])) >= need(na[some], nb[some], share)
            yield batch.select(["a", "b"]).filter(pa.array(ok))

    return step


class RTree:
    """Points in leaves of LEAF by size and counts, each with a box; joined with another tree leaf by leaf."""

    def __init__(self, size: np.ndarray, points: np.ndarray, more: np.ndarray) -> None:
        spread = np.argsort(-points.std(0), kind="stable")[:3]
        self.order = np.lexsort((*(points[:, d] for d in spread), size))
        self.size, self.points, self.more = size[self.order], points[self.order], more[self.order]
        self.at = np.append(np.arange(0, len(size), LEAF), len(size))
        self.high = np.maximum.reduceat(self.points, self.at[:-1], axis=0)
        self.least, self.most, self.top_more = np.minimum.reduceat(self.size, self.at[:-1]), np.maximum.reduceat(self.size, self.at[:-1]), np.maximum.reduceat(self.more, self.at[:-1])

    def join(self, other: RTree, share: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(places in self, places in other, bound) of the pairs that a link is possible for, a pair of leaves at a time."""
        for i, (a, b) in enumerate(zip(self.at[:-1], self.at[1:], strict=True)):
            top = np.minimum(other.high, self.high[i]).sum(1, dtype=np.uint32) + np.minimum(other.top_more, self.top_more[i])
            top = np.minimum(top, np.minimum(other.most, self.most[i]))
            for j in np.flatnonzero(top >= need(self.least[i], other.least, share)):
                c, d = other.at[j], other.at[j + 1]
                bound = np.minimum(self.points[a:b, None, :], other.points[None, c:d, :]).sum(2, dtype=np.uint32) + np.minimum(self.more[a:b, None], other.more[None, c:d])
                bound = np.minimum(bound, np.minimum(self.size[a:b, None], other.size[None, c:d]))
                x, y = np.nonzero(bound >= need(self.size[a:b, None], other.size[None, c:d], share))
                if len(x):
                    yield self.order[a + x], other.order[c + y], bound[x, y]


def _pairs_of(fp: np.ndarray, root: np.ndarray, side: np.ndarray, n: np.ndarray, vecs: list[bytes], within: bool, share: int, partners: int, by_set: bool = True) -> tuple[np.ndarray, np.ndarray, bool]:
    """Pairs of different components in one block (`within`) or between two - with `partners`, only so many best ones of each set (or else component) outside the most common component - and whether any were left out."""
    _, one = np.unique(np.column_stack((fp, side)), axis=0, return_index=True)
    fp, root, side, n, vecs = fp[one], root[one], side[one], n[one], [vecs[i] for i in one]
    left = np.flatnonzero(side == 0)
    right = left if within else np.flatnonzero(side == 1)
    none = np.zeros(0, np.int64)
    if not len(left) or not len(right) or (root == root[0]).all():
        return none, none, False
    lens = np.array([len(v) for v in vecs])
    trees: dict[tuple[int, int, int], tuple[np.ndarray, RTree]] = {}

    def tree(which: int, own: np.ndarray, size: int, groups: int) -> tuple[np.ndarray, RTree | None]:
        if (which, size, groups) not in trees:
            rows = own[lens[own] == size]
            more, points = unpack_all([vecs[i] for i in rows]) if len(rows) else (none, np.zeros((0, groups)))
            trees[which, size, groups] = rows, RTree(n[rows], fold(points, groups), more) if len(rows) else None
        return trees[which, size, groups]

    found = []
    kinds = np.unique(lens).tolist()
    # vectors of one length meet, and those of the next: linked sets have no other
    for p, q in [(k, k) for k in kinds] + [x for k, m in zip(kinds[:-1], kinds[1:], strict=True) for x in ((k, m), (m, k))[: 1 if within else 2]]:
        groups = (min(p, q) - 4) * 4
        (xs, one), (ys, other) = tree(0, left, p, groups), tree(0 if within else 1, right, q, groups)
        if one is None or other is None:
            continue
        for x, y, bound in one.join(other, share):
            x, y = xs[x], ys[y]
            ok = root[x] != root[y]
            if ok.any():
                found.append(np.column_stack((x[ok], y[ok], bound[ok] * 1000 // (n[x[ok]] + n[y[ok]]))))
    if not found:
        return none, none, False
    x, y, good = np.concatenate(found).T
    keep = np.ones(len(x), bool)
    if partners:
        keep[:] = False
        names, often = np.unique(root, return_counts=True)
        for own in (x, y):
            some = np.flatnonzero(root[own] != names[often.argmax()])  # of any pair one at least
            whose = own if by_set else root[own]
            order = some[np.lexsort((-good[some], whose[some]))]
            rank = np.arange(len(order)) - np.searchsorted(whose[order], whose[order])
            keep[order[rank < partners]] = True
    return np.minimum(fp[x], fp[y])[keep], np.maximum(fp[x], fp[y])[keep], not keep.all()


def _pairs_in(share: int, partners: int, by_set: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Takes rows sorted by (part, x, y); gives the pairs (a, b) of each such group, and the part where pairs were left out. A group has at most two blocks, so what is held is bounded."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in _and_end(batches):
            if batch is not None:
                new = pa.Table.from_batches([batch])
                held = new if held is None else pa.concat_tables([held, new])
            if held is None or not held.num_rows:
                continue
            c = {k: held.column(k).to_numpy() for k in ("part", "x", "y", "fp", "root", "side", "n")}
            vecs = held.column("vec").to_pylist()
            change = np.zeros(held.num_rows, bool)
            change[0] = True
            for k in ("part", "x", "y"):
                change[1:] |= c[k][1:] != c[k][:-1]
            edges = np.append(np.flatnonzero(change), held.num_rows)
            if batch is not None:
                edges = edges[:-1]  # the last group may go on in the next batch
            found: list[np.ndarray] = []
            cut: list[int] = []
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                one, two, more = _pairs_of(c["fp"][a:b], c["root"][a:b], c["side"][a:b], c["n"][a:b], vecs[a:b], c["x"][a] == c["y"][a], share, partners, by_set)
                found.append(np.column_stack((one, two)))
                if more:
                    cut.append(int(c["part"][a]))
            held = held.slice(edges[-1]) if batch is not None else None
            pairs = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
            none = pa.nulls(len(pairs), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), none], ["a", "b", "cut"])
            if cut:
                none = pa.nulls(len(cut), pa.int64())
                yield pa.RecordBatch.from_arrays([none, none, pa.array(cut, pa.int64())], ["a", "b", "cut"])

    return find


def _and_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _shingle_rows(words: list[bytes], ids: dict[bytes, int], k: int) -> np.ndarray:
    """The distinct shingles of a text as rows of word numbers; `ids` gets what it lacks."""
    numbers = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.uint32, len(words))
    if len(numbers) < k:
        rows = np.full((min(1, len(numbers)), k), 0xFFFFFFFF, np.uint32)
        rows[:, : len(numbers)] = numbers
    else:
        rows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(numbers, k))
    return np.unique(rows.view(f"V{4 * k}").ravel())


def _match(words: int, share: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows sorted by (hub, block, side, fp): the hub's text, then those it is held against. Gives (a, b, linked)."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, done = None, None
        ids: dict[bytes, int] = {}
        own: np.ndarray | None = None
        for batch in batches:
            out: list[tuple[int, int, bool]] = []
            for hub, block, side, fp, digest, text in zip(*(batch.column(c).to_pylist() for c in ("hub", "block", "side", "fp", "digest")), batch.column("text"), strict=True):
                if (hub, block) != at:
                    at, own, done, ids = (hub, block), None, None, {}
                if fp == done:  # a repeated row
                    continue
                found = words_of(text.as_py())
                if digest_of(found) != digest:  # another text of the same id
                    continue
                done = fp
                rows = _shingle_rows(found, ids, words)
                if side == 0:
                    own = rows
                elif own is not None:
                    both = len(np.intersect1d(own, rows, assume_unique=True))
                    out.append((min(hub, fp), max(hub, fp), 100 * both >= share * (len(own) + len(rows) - both)))
            a, b, linked = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(linked, pa.bool_())], ["a", "b", "linked"])

    return step


def _held(df: DataFrame) -> DataFrame:
    """Broadcast if it has at most BROADCAST_ROWS narrow rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _checked(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, words: int, share: int) -> DataFrame:
    """(a, b, linked) of the distinct pairs (a, b), from whole texts. Of each pair the text that more pairs share stays; the other comes to it."""
    spark = docs.sparkSession
    often = pairs.select(F.explode(F.array("a", "b")).alias("fp")).groupBy("fp").count()
    known = materialise(spark, nodes.select("fp", "doc_id", "digest").join(often, "fp"))
    side = lambda name: known.select(F.col("fp").alias(name), F.col("count").alias(f"n{name}"))
    more = F.col("na") >= F.col("nb")
    led = pairs.join(side("a"), "a").join(side("b"), "b")
    led = led.select(F.when(more, F.col("a")).otherwise(F.col("b")).alias("hub"), F.when(more, F.col("b")).otherwise(F.col("a")).alias("fp"), F.greatest("na", "nb").alias("n"))
    led = materialise(spark, led.select("hub", F.pmod(F.xxhash64("fp"), F.ceil(F.col("n") / BESIDE)).cast("int").alias("block"), "fp"))
    ways = led.select("hub", "block", F.lit(0).alias("side"), F.col("hub").alias("fp")).distinct().unionByName(led.select("hub", "block", F.lit(1).alias("side"), "fp"))
    ways = materialise(spark, ways.join(known.drop("count"), "fp"))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(_held(ways), "doc_id").select("hub", "block", "side", "fp", "digest", "text")
    rows = rows.repartition("hub", "block").sortWithinPartitions("hub", "block", "side", "fp")
    done = materialise(spark, rows.mapInArrow(_match(words, share), "a bigint, b bigint, linked boolean"))
    discard(known, led, ways)
    return done


def _linked(docs: DataFrame, words: int, share: int) -> DataFrame:
    """As `link`, with the digest of the row's words."""
    spark = docs.sparkSession
    sketch, own = _named(materialise(spark, _sketch(docs, words, share)))
    full = sketch.where("n > 0")

    rows = full.select(F.explode("keys").alias("h"), "fp").repartitionByRange("h", "fp").sortWithinPartitions("h", "fp")
    parts = rows.mapInArrow(_groups, "part bigint, m0 bigint, m1 bigint, members array<bigint>")
    parts = parts.groupBy("part", "m0", "m1").agg(F.first("members").alias("members"), F.count("*").alias("w"))
    places = parts.select("part", "w", F.element_at("members", 1).alias("hub"), F.explode("members").alias("fp")).repartition("fp")
    near = places.groupBy("fp", "hub").agg(F.sum("w").alias("w"), F.collect_list("part").alias("parts"))  # no longer than a set's index
    best = F.max(F.when(F.col("hub") != F.col("fp"), F.struct("w", "hub")))["hub"]
    near = near.groupBy("fp").agg(F.sum("w").alias("shared"), best.alias("hub"), F.flatten(F.collect_list("parts")).alias("parts"))
    smaller = F.floor((F.col("n") * share + 99) / 100)  # the least size of a linked set
    nodes = materialise(spark, own.where("doc_id is not null").drop("other").join(near, "fp").where(F.col("shared") >= F.least(smaller, 1 + F.floor(smaller / MEET))))
    vectors = full.join(_held(nodes.select("fp")), "fp", "left_semi").select("fp", "n", "vec").dropDuplicates(["fp"])
    vectors = materialise(spark, vectors)

    side = lambda name: vectors.select(F.col("fp").alias(name), F.col("n").alias(f"n{name}"), F.col("vec").alias(f"v{name}"))
    stars = nodes.where("hub is not null").select(F.least("fp", "hub").alias("a"), F.greatest("fp", "hub").alias("b")).distinct()
    stars = stars.join(side("a"), "a").join(side("b"), "b").mapInArrow(_bounds(share), "a bigint, b bigint")
    stars = materialise(spark, stars)
    tested = _checked(docs, nodes, stars, words, share)
    discard(stars)
    roots = components(spark, tested.where("linked").select("a", "b"))

    step = np.log(100 / share) * (1 + 1e-9)  # sizes of linked sets are less than a step apart
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(float(step)))
    placed_all = nodes.select("fp", F.array_distinct("parts").alias("parts"), band.alias("band"))
    cut: DataFrame | None = None
    for one_part, partners in ((True, PARTNERS), (False, PARTNERS), (False, 0)):
        owned = placed_all.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "band", F.explode("parts").alias("group"))
        several = owned.groupBy("group").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count("*").alias("m")).where("r0 <> r1")
        several = materialise(spark, several.select("group", "m", (F.col("m") > BLOCK).alias("large")))
        owned = owned.join(several, "group")
        if one_part:
            owned = owned.groupBy("fp").agg(F.max(F.struct("m", "group", "large", "root", "band")).alias("p")).select("fp", "p.root", "p.band", "p.group", "p.large")
        own_part, by_size = F.array(F.xxhash64("group")), F.array(F.xxhash64("group", "band"), F.xxhash64("group", F.col("band") + 1))
        placed = owned.select("fp", "root", F.explode(F.when(F.col("large"), by_size).otherwise(own_part)).alias("part"))
        if cut is not None:  # elsewhere all pairs have been looked at
            placed = placed.join(cut, "part", "left_semi")
        placed = materialise(spark, placed)
        same = [F.bit_xor(F.xxhash64("fp")).alias("s0"), F.bit_xor(F.xxhash64("fp", F.lit(1))).alias("s1"), F.count("*").alias("m")]  # names the members
        by_root = placed.groupBy("part", "root").agg(*same)
        apart = by_root.groupBy("part").agg(F.count("*").alias("n"), F.max(F.struct("m", "root")).alias("main"), F.sum("m").alias("m"), *(F.bit_xor(c).alias(c) for c in ("s0", "s1"))).where("n > 1")
        apart = apart.groupBy("s0", "s1", "m").agg(F.min(F.struct("part", "main")).alias("p"))  # parts of the same members count once
        small, blocks = F.col("m") <= BLOCK, lambda n: F.ceil(n / BLOCK).cast("int")
        apart = apart.select("p.part", F.when(~small, F.col("p.main.root")).alias("main"), F.when(small, 1).otherwise(blocks(F.col("m") - F.col("p.main.m"))).alias("others"), F.when(small, 0).otherwise(blocks(F.col("p.main.m"))).alias("mains"))
        apart = materialise(spark, apart)
        left = placed.join(apart, "part")
        # the sets of a large part's main component meet those of others alone: blocks of others come first, and one of any two is such a block
        in_main = F.coalesce(F.col("root") == F.col("main"), F.lit(False))
        spread = lambda n: F.pmod(F.xxhash64("fp"), n).cast("int")
        left = left.withColumn("k", F.when(in_main, F.col("others") + spread(F.col("mains"))).otherwise(spread(F.col("others"))))
        left = left.withColumn("j", F.explode(F.sequence(F.lit(0), F.when(in_main, F.col("others")).otherwise(F.col("others") + F.col("mains")) - 1)))
        left = left.select("part", "fp", "root", F.least("k", "j").alias("x"), F.greatest("k", "j").alias("y"), (F.col("k") > F.col("j")).cast("int").alias("side"))
        left = left.join(vectors, "fp").repartition("part", "x", "y").sortWithinPartitions("part", "x", "y")
        found = materialise(spark, left.mapInArrow(_pairs_in(share, partners, one_part), "a bigint, b bigint, cut bigint"))
        pairs = found.where("a is not null").select("a", "b").distinct()
        pairs = materialise(spark, pairs.join(tested.select("a", "b"), ["a", "b"], "left_anti"))
        more = _checked(docs, nodes, pairs, words, share)
        spent = [several, placed, apart, pairs, tested, more, roots]
        tested = materialise(spark, tested.unionByName(more))
        roots = components(spark, tested.where("linked").select("a", "b"))
        if not one_part:
            spent += [cut] if cut is not None else []
            cut = materialise(spark, found.where("cut is not null").select(F.col("cut").alias("part")).distinct())
        discard(found, *spent)
        if not one_part and cut.isEmpty():
            break

    classes = full.groupBy("fp").agg(F.min("doc_id").alias("least")).join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    classes = materialise(spark, classes.select("fp", "least", F.coalesce("root", "fp").alias("root")))
    smallest = materialise(spark, classes.groupBy("root").agg(F.min("least").alias("component_id")))
    named = materialise(spark, classes.join(smallest, "root").select("fp", "component_id"))
    discard(own, nodes, vectors, tested, roots, cut, classes, smallest)
    out = sketch.select("doc_id", "n", "fp", "digest").join(named, "fp", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "digest")


def link(docs: DataFrame, words: int = WORDS, share: int = SHARE) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_shingles, component_id (the smallest doc_id reachable by links)."""
    return _linked(docs, words, share).drop("digest")


def keep_one(docs: DataFrame, words: int = WORDS, share: int = SHARE) -> DataFrame:
    """Of each component the row of its smallest doc_id stays, columns as they were; rows of null id or without words stay.

    Where rows of different texts share an id, only those go whose own text has a copy of smaller id.
    """
    spark = docs.sparkSession
    goes = materialise(spark, _linked(docs, words, share).where("doc_id <> component_id").select("doc_id", "digest").distinct())
    twice = materialise(spark, docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    single = goes.select("doc_id").distinct()
    repeated = not twice.isEmpty()
    kept = docs.join(_held(single.join(twice, "doc_id", "left_anti") if repeated else single), "doc_id", "left_anti")
    if repeated:

        def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                digests = pa.array([digest_of(words_of(t.as_py())) for t in batch.column("text")], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("id"), digests], ["row", "id", "digest"])

        again = kept.join(_held(twice), "doc_id", "left_semi").dropDuplicates()
        again = again.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").cast("bigint").alias("id"), "text")
        again = again.mapInArrow(named, T.StructType([again.schema["row"], T.StructField("id", T.LongType()), T.StructField("digest", T.BinaryType())]))
        again = again.join(_held(goes.withColumnRenamed("doc_id", "id")), ["id", "digest"], "left_anti")
        kept = kept.join(_held(twice), "doc_id", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
        kept = kept.unionByName(again.select(*(F.col(f"row.`{c}`") for c in docs.columns)))
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns))
