"""Ranked search with Fagin's threshold algorithm over packs of documents.

One pass over the texts writes packs: a forward index of up to PACK_POSTINGS postings, which holds of each document its
id, its number of terms and how often it holds each term of the queries' vocabulary. A pack turns its postings into
lists by term, sorted by impact - what an occurrence adds to a score before the term's weight. A query reads its lists
round-robin, a block of each at a time; every document it meets is scored whole by look-ups in the forward index; it stops when
the threshold - the score of a document that would stand at the present place of every list - falls strictly below its
k-th score, so that equal scores are all met and go to the smaller id. One pack in SEED_SHARE goes first; the k-th score
a query has there, and what a task has found in its earlier packs, bound what is looked for in the others.

Queries are taken in groups of about GROUP_CHARS characters: their terms, weights and floors are what tasks are sent; each group reads the
texts once. The weights come from counts over all documents.

Defined results: null texts have no terms; rows of null id take no part and count in no statistic; repeated rows are documents of their own; a
query's rows of one id are one query; null item ids are left out; terms that no document holds add nothing; an empty
table gives no rows.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runlens.llm.spans import LOWER, WordTable, buffer_of, byte_class, find_words, hash_spans, runs_of, texts_of
from runlens.session import discard, materialise

K = 50
PACK_POSTINGS, PACK_DOCS = 1_000_000, 65_536
GROUP_CHARS = 4_000_000
SEED_SHARE = 64
BLOCK = 32  # places of each list at first; doubled each turn
TERM = byte_class(inside="0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
PACKS = "part int, pack int, n_docs bigint, n_terms bigint, doc_ids array<bigint>, sizes array<bigint>, holds array<int>, terms array<int>, tfs array<int>"


def terms_of(col: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, starts and ends of all terms, and the index of the first term of each text."""
    buf, at = buffer_of(col)
    buf = LOWER[buf]
    return buf, *find_words(buf, at, TERM)


class Vocabulary:
    """Numbers of the queries' terms; a seed is chosen under which no two of them share a hash."""

    def __init__(self, terms: list[bytes]) -> None:
        size = np.fromiter(map(len, terms), np.int64, len(terms))
        buf, ends = np.frombuffer(b"".join(terms), np.uint8), np.cumsum(size)
        self.seed = -1
        while self.seed < 0 or len(np.unique(h)) < len(h):
            self.seed += 1
            h = hash_spans(buf, ends - size, ends, self.seed)
        self.table, self.n = WordTable(), len(terms)
        self.table.add(buf, ends - size, ends, h)

    def find(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of each term, negative where it is none of them."""
        return self.table.find(buf, starts, ends, hash_spans(buf, starts, ends, self.seed))


_built: dict[str, Vocabulary] = {}  # of this worker: the last one built


def _packer(held, key: str):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _built:
            _built.clear()
            _built[key] = Vocabulary(held.value)
        vocab, part, pack = _built[key], TaskContext.get().partitionId(), 0
        docs, terms = 0, 0
        parts: list[tuple[np.ndarray, ...]] = []

        def flush() -> pa.RecordBatch:
            names = ("doc_ids", "sizes", "holds", "terms", "tfs")
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
            lists = [pa.array([np.concatenate([p[i] for p in parts]) if parts else []], pa.list_(k)) for i, k in enumerate(kinds)]
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([pack], pa.int32()), pa.array([docs]), pa.array([terms]), *lists], ["part", "pack", "n_docs", "n_terms", *names])

        for batch in batches:
            ids, col = batch.column("doc_id").to_numpy(), texts_of(batch.column("text"))
            for i, j in runs_of(col):
                buf, starts, ends, first = terms_of(col.slice(i, j - i))
                size = np.diff(first)
                docs, terms = docs + int((size > 0).sum()), terms + int(size.sum())
                number = vocab.find(buf, starts, ends)
                doc = np.repeat(np.arange(j - i), size)
                key_, tf = np.unique(doc[number >= 0] * vocab.n + number[number >= 0], return_counts=True)
                holds = np.bincount(key_ // vocab.n, minlength=j - i)
                some = holds > 0
                parts.append((ids[i:j][some], size[some], holds[some], key_ % vocab.n, tf))
                if sum(len(p[3]) for p in parts) >= PACK_POSTINGS or sum(len(p[0]) for p in parts) >= PACK_DOCS:
                    yield flush()
                    pack, docs, terms = pack + 1, 0, 0
                    parts.clear()
        if docs:
            yield flush()

    return step


class Pack:
    """A pack's forward index, and its lists by term in falling order of impact."""

    def __init__(self, row: dict[str, np.ndarray], vocab: int, n: int, total: int) -> None:
        self.ids, self.vocab = row["doc_ids"], vocab
        m = 50 + (50 * row["sizes"] * n) // total
        doc = np.repeat(np.arange(len(self.ids)), row["holds"])
        term, tf = row["terms"].astype(np.int64), row["tfs"].astype(np.int64)
        self.impact = (1_000_000_000 * tf) // (1000 * tf + 20 * m[doc])
        self.key = doc * vocab + term  # ascending
        order = np.lexsort((-self.impact, term))
        self.doc, self.by_impact, self.term = doc[order], self.impact[order], term[order]

    def lists(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the lists of terms start and end."""
        return np.searchsorted(self.term, terms), np.searchsorted(self.term, terms, side="right")

    def score(self, docs: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Whole scores of documents, by look-ups of each of the terms."""
        want = docs[:, None] * self.vocab + terms
        at = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
        return np.where(self.key[at] == want, self.impact[at], 0) @ weights

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """(scores, ids) of the pack's k best with scores of at least `floor` and above 0."""
        begin, end = self.lists(terms)
        live = end > begin
        terms, weights, begin, end = terms[live], weights[live], begin[live], end[live]
        scores, ids, kth = np.zeros(0, np.int64), np.zeros(0, np.int64), max(floor, 1)
        seen = np.zeros(len(self.ids), bool)
        block, at = BLOCK, begin.copy()
        while len(terms):
            to = np.minimum(at + block, end)
            met = np.unique(np.concatenate([self.doc[a:b] for a, b in zip(at.tolist(), to.tolist(), strict=True)]))
            met = met[~seen[met]]
            seen[met] = True
            got = self.score(met, terms, weights)
            fit = got >= kth
            scores, ids = np.concatenate((scores, got[fit])), np.concatenate((ids, self.ids[met[fit]]))
            if len(scores) > k:
                best = np.lexsort((ids, -scores))[:k]
                scores, ids = scores[best], ids[best]
            if len(scores) == k:
                kth = max(kth, int(scores.min()))
            on = to < end
            threshold = int((weights * np.where(on, self.by_impact[np.maximum(to - 1, 0)], 0)).sum())
            if not on.any() or threshold < kth:
                break
            # an exhausted list adds nothing to what is unseen, but still to the score of what others show
            at, block = to, block * 2
        return scores, ids


def _visit(queries, k: int, vocab: int, n: int, total: int):
    """What the queries find in the packs of a task: at most k rows each, held across packs."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = queries.value
        held = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(asked)
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].values.to_numpy() for c in ("doc_ids", "sizes", "holds", "terms", "tfs")}
                if not len(row["doc_ids"]):
                    continue
                pack = Pack(row, vocab, n, total)
                for q, (_, terms, weights, floor) in enumerate(asked):
                    s, d = held[q]
                    new, ids = pack.search(terms, weights, k, max(floor, int(s.min()) if len(s) == k else 0))
                    s, d = np.concatenate((s, new)), np.concatenate((d, ids))
                    best = np.lexsort((d, -s))[:k]
                    held[q] = s[best], d[best]
        names = [a[0] for a in asked]
        count = [len(s) for s, _ in held]
        if sum(count):
            item = np.repeat(np.array(names, np.int64), count)
            yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(np.concatenate([d for _, d in held])), pa.array(np.concatenate([s for s, _ in held]))], ["item_id", "doc_id", "score"])

    return step


def _groups(items: DataFrame, group_chars: int) -> Iterator[dict[int, list[bytes]]]:
    """Distinct terms of each item, by groups of about group_chars characters; one group is on the driver at a time."""
    items = items.where("item_id is not null and text is not null").select(F.col("item_id").cast("bigint").alias("item_id"), "text")
    chars = items.agg(F.sum(F.length("text").cast("bigint")).alias("n")).first()["n"] or 0
    groups = max(1, -(-chars // group_chars))
    for g in range(groups):
        out: dict[int, dict[bytes, None]] = {}
        for r in items.where(F.pmod(F.xxhash64("item_id"), F.lit(groups)) == g).toLocalIterator():
            buf, starts, ends, _ = terms_of(pa.array([r["text"]], pa.large_string()))
            raw = buf.tobytes()
            out.setdefault(r["item_id"], {}).update((raw[a:b], None) for a, b in zip(starts.tolist(), ends.tolist(), strict=True))
        yield {i: list(t) for i, t in out.items() if t}


def weight(n: int, df: int) -> int:
    """Of a term that df of n documents hold."""
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _search_group(docs: DataFrame, items: dict[int, list[bytes]], k: int) -> DataFrame:
    spark, sc = docs.sparkSession, docs.sparkSession.sparkContext
    number = {t: i for i, t in enumerate(sorted({t for terms in items.values() for t in terms}))}
    held = sc.broadcast(list(number))
    packs = materialise(spark, docs.mapInArrow(_packer(held, uuid.uuid4().hex), PACKS))
    held.unpersist()
    sums = packs.agg(F.sum("n_docs").alias("n"), F.sum("n_terms").alias("t")).first()
    n, total = sums["n"] or 0, sums["t"] or 0
    # as many rows as the group has distinct terms, at most
    df = {r["term"]: r["n"] for r in packs.mapInArrow(_document_counts, "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toLocalIterator()}
    asked = []
    for item, terms in sorted(items.items()):
        known = sorted(number[t] for t in terms if number[t] in df)
        pairs = [(t, weight(n, df[t])) for t in known]
        asked.append((item, np.array([t for t, w in pairs if w > 0], np.int64), np.array([w for _, w in pairs if w > 0], np.int64)))

    def visit(some: DataFrame, floors: dict[int, int]) -> DataFrame:
        queries = sc.broadcast([(*q, floors.get(q[0], 0)) for q in asked])
        columns = some.select("doc_ids", "sizes", "holds", "terms", "tfs")
        return columns.mapInArrow(_visit(queries, k, len(number), n, total), "item_id bigint, doc_id bigint, score bigint")

    first = (F.col("pack") == 0) & (F.pmod("part", F.lit(SEED_SHARE)) == 0)
    found = materialise(spark, _best(visit(packs.where(first), {}), k))
    kth = {r["item_id"]: r["score"] for r in found.where(F.col("rank") == k).toLocalIterator()}  # one number a query of the group
    rest = visit(packs.where(~first), kth)
    out = materialise(spark, _best(found.drop("rank").unionByName(rest), k))
    discard(packs, found)
    return out


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many documents of the task's packs hold each term."""
    count = np.zeros(0, np.int64)
    for batch in batches:
        terms = batch.column("terms").flatten().to_numpy()
        new = np.bincount(terms, minlength=len(count)) if len(terms) else count * 0
        new[: len(count)] += count
        count = new
    some = np.flatnonzero(count)
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(count[some], pa.int64())], ["term", "n"])


def search(docs: DataFrame, items: DataFrame, k: int = K, group_chars: int = GROUP_CHARS) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents (doc_id, text) of the highest scores above 0 for each item (item_id, text)."""
    spark = docs.sparkSession
    rows = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    out = spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    for group in _groups(items, group_chars):
        if group:
            out = out.unionByName(_search_group(rows, group, k))
    return out
