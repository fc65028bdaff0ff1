"""Benchmark decontamination with a generalised suffix automaton.

Words are maximal runs of ASCII digits, ASCII letters and non-ASCII characters after lower-casing A-Z. The automaton
holds every word string of every item; a training text is streamed through it and the longest match ending at each
word is tracked. Where that match reaches `window` words, those words are hit; an item of fewer words is a window as a
whole. Only stretches whose neighbouring word pairs all occur in the benchmark are streamed: no window can lie elsewhere.
Pairs are told by hash, which may stream too much; what is streamed is told by bytes: a word is one of the automaton's
only if all its bytes agree.

Defined results: null or empty texts have no words and are never contaminated; items without words or without id take
no part; items that share an id count as one; repeated documents are each measured; extra columns pass through.

The items are read in shards of `shard_chars` characters, each broadcast and each with an automaton of its own (about 300
bytes for each distinct word string that may go on differently, some 100 MB a shard). A benchmark of one shard is one pass
over the documents. Beyond that a Bloom filter of all windows of all items (FILTER_BYTES at most) first tells apart the
documents that may hold one: the others are done, and they alone are written between two shards and meet every automaton.
So whatever the benchmark's size the documents are read twice, those without a window are written nowhere, one automaton
and one broadcast are held at a time, and nothing of the documents is shuffled. A filter too small for its windows lets
more documents through and changes no result.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runlens.llm.spans import LOWER, HashTable, WordTable, buffer_of, byte_class, find_words, hash_spans, mix, runs_of, texts_of
from runlens.session import discard, materialise

WINDOW = 13
WORD = byte_class("0123456789abcdefghijklmnopqrstuvwxyz")
SHARD_CHARS = 1_000_000
FILTER_BYTES = 128 << 20  # of the filter of a benchmark of several shards
FILTER_BITS = 32  # for each window, as long as that allows
PROBES = 6
COVERAGE = 20  # contaminated: n_hit * COVERAGE >= n_words


def _pairs(h: np.ndarray) -> np.ndarray:
    return mix(h[:-1] * np.uint64(3) + h[1:])


class Automaton:
    """Suffix automaton of several word-id strings; `ends` has the items whose window a state closes."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW) -> None:
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        col = pa.array([t for _, t in items], pa.large_string())
        buf, at = buffer_of(col)
        buf = LOWER[buf]
        starts, ends, first = find_words(buf, at, WORD)
        self.seed = 0
        while True:  # until no two words of the items share a hash
            hashes = hash_spans(buf, starts, ends, self.seed)
            known, spot = np.unique(hashes, return_index=True)
            self.vocab = WordTable()
            self.vocab.add(buf, starts[spot], ends[spot], known)
            ids = self.vocab.find(buf, starts, ends, hashes)
            if (ids >= 0).all():
                break
            self.seed += 1
        texts = [(name, ids[a:b].tolist()) for (name, _), a, b in zip(items, first[:-1], first[1:], strict=True) if b > a]
        self.least = min([window, *(len(x) for _, x in texts)])
        inner = np.ones(max(len(hashes) - 1, 0), bool)
        cut = first[1:-1]
        inner[cut[(cut > 0) & (cut < len(hashes))] - 1] = False
        pairs = np.unique(_pairs(hashes)[inner]) if len(hashes) > 1 else np.zeros(0, np.uint64)
        self.pairs = HashTable()
        self.pairs.add(pairs, np.zeros(len(pairs), np.int64))
        for _, x in texts:
            last = 0
            for w in x:
                last = self._extend(last, w)
        self.windows: dict[int, set[str]] = {}  # state of a window of full length -> items
        self.short: dict[tuple[int, int], set[str]] = {}  # (state, words) of a shorter item -> items
        for name, x in texts:
            state, long = 0, 0
            for w in x:
                state, long = self._step(state, long, w)
                if long >= window:
                    self.windows.setdefault(self._up(state, window), set()).add(name)
            if len(x) < window:
                self.short.setdefault((state, len(x)), set()).add(name)
        self.short_lens: dict[int, list[int]] = {}
        for state, n in self.short:
            self.short_lens.setdefault(state, []).append(n)

    def _extend(self, last: int, w: int) -> int:
        nxt, link, length = self.next, self.link, self.len
        if w in nxt[last]:
            q = nxt[last][w]
            return q if length[q] == length[last] + 1 else self._clone(last, w, q)
        cur = self._state(length[last] + 1)
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p < 0:
            link[cur] = 0
        else:
            q = nxt[p][w]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
        return cur

    def _state(self, length: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.len.append(length)
        return len(self.len) - 1

    def _clone(self, p: int, w: int, q: int) -> int:
        c = self._state(self.len[p] + 1)
        self.next[c], self.link[c] = dict(self.next[q]), self.link[q]
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = c
            p = self.link[p]
        self.link[q] = c
        return c

    def _step(self, state: int, long: int, w: int) -> tuple[int, int]:
        """The longest match that ends with w, given the one before it."""
        nxt = self.next
        while w not in nxt[state]:
            state = self.link[state]
            if state < 0:
                return 0, 0
            long = self.len[state]
        return nxt[state][w], long + 1

    def _up(self, state: int, n: int) -> int:
        """The state that holds the last n words of what this state matches."""
        while self.len[self.link[state]] >= n:
            state = self.link[state]
        return state

    def scan(self, ids: list[int], base: int) -> Iterator[tuple[int, int, set[str]]]:
        """Windows in a stretch of words: (first word, one past the last, items)."""
        state, long, whole = 0, 0, self.window
        for i, w in enumerate(ids, base + 1):
            state, long = self._step(state, long, w)
            if long >= whole:
                yield i - whole, i, self.windows[self._up(state, whole)]
            if self.short_lens:
                s = state
                while s > 0:
                    for n in self.short_lens.get(s, ()):
                        if n <= long and n <= self.len[s]:
                            yield i - n, i, self.short[s, n]
                    s = self.link[s]

    def match(self, h: np.ndarray, ids: Callable[[int, int], list[int]]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged ranges of hit words of a text, given its words' hashes, and the items found; ids(a, b): what the words a to b are in the vocabulary."""
        n, spans, found = len(h), [], set()
        if n < self.least:
            return spans, found
        if self.least == 1:
            ok = self.vocab.has(h)
            edge = np.flatnonzero(np.diff(np.concatenate(([False], ok, [False]))))
            runs = edge.reshape(-1, 2)
        else:
            ok = self.pairs.find(_pairs(h)) >= 0
            edge = np.flatnonzero(np.diff(np.concatenate(([False], ok, [False]))))
            runs = edge.reshape(-1, 2) + [0, 1]
        for a, b in runs[runs[:, 1] - runs[:, 0] >= self.least].tolist():
            for x, y, names in self.scan(ids(a, b), a):
                found |= names
                while spans and x <= spans[-1][1]:
                    x0, y0 = spans.pop()
                    x, y = min(x, x0), max(y, y0)
                spans.append((x, y))
        return spans, found


class WindowFilter:
    """A Bloom filter of the windows of items; `has` may say yes of a text that holds none, never no of one that does."""

    def __init__(self, chars: int, window: int = WINDOW) -> None:
        self.window = window
        self.lengths: set[int] = set()
        self.bytes = np.zeros(min(1 << max(8, (chars * FILTER_BITS // 16 - 1).bit_length()), FILTER_BYTES), np.uint8)  # a window for two characters at most

    def _places(self, keys: np.ndarray, probe: int) -> tuple[np.ndarray, np.ndarray]:
        at = (keys + np.uint64(probe) * ((keys >> np.uint64(32)) | np.uint64(1))) % np.uint64(8 * len(self.bytes))
        return (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8)

    def _strings(self, h: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(n, hash of the n words that begin at each place) for n up to the window."""
        now = mix(h)
        for n in range(1, min(self.window, len(h)) + 1):
            if n > 1:
                now = mix(now[:-1] * np.uint64(3) + h[n - 1 :])
            yield n, now

    def add(self, items: list[str]) -> None:
        buf, at = buffer_of(pa.array(items, pa.large_string()))
        buf = LOWER[buf]
        starts, ends, first = find_words(buf, at, WORD)
        sizes = np.diff(first)
        left = np.repeat(first[1:], sizes) - np.arange(len(starts))  # words from here to the end of the text
        whole = np.repeat(sizes, sizes)
        self.lengths |= {int(min(n, self.window)) for n in np.unique(sizes) if n}
        for n, keys in self._strings(hash_spans(buf, starts, ends, 0)):
            if n in self.lengths:
                own = left[: len(keys)]
                keys = keys[own >= n if n == self.window else (own == n) & (whole[: len(keys)] == n)]
                for probe in range(PROBES):
                    at_byte, bit = self._places(keys, probe)
                    np.bitwise_or.at(self.bytes, at_byte, bit)

    def has(self, h: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Of each text, given the hashes of all words and where each text's begin, whether it may hold a window."""
        sizes = np.diff(first)
        text = np.repeat(np.arange(len(sizes)), sizes)
        left = np.repeat(first[1:], sizes) - np.arange(len(h))
        out = np.zeros(len(sizes), bool)
        for n, keys in self._strings(h):
            if n in self.lengths:
                here = np.flatnonzero(left[: len(keys)] >= n)
                for probe in range(PROBES):
                    at_byte, bit = self._places(keys[here], probe)
                    here = here[(self.bytes[at_byte] & bit) > 0]
                out[text[here]] = True
        return out


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("string").alias("k"), F.col("text").alias("t"))


def _shards(items: DataFrame, parts: int) -> Iterator[list[tuple[str, str]]]:
    """Items in groups, those of one id together; the benchmark is read once, and the driver holds one group at a time but for its broadcast."""
    if parts == 1:
        yield [(r["k"], r["t"]) for r in items.toLocalIterator()]
        return
    dealt = items.withColumn("part", F.pmod(F.xxhash64("k"), F.lit(parts))).repartition(parts, "part").sortWithinPartitions("part")
    for _, rows in groupby(dealt.toLocalIterator(), key=lambda r: r["part"]):
        yield [(r["k"], r["t"]) for r in rows]


_STATE = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())]))),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("cut", T.StringType()),
])


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _without(text: str, spans: list[tuple[int, int]], starts: np.ndarray, ends: np.ndarray) -> str:
    """The text without the bytes from the first to the last word of each span."""
    raw, out, at = text.encode(), [], 0
    for a, b in spans:
        out.append(raw[at : starts[a]])
        at = ends[b - 1]
    return b"".join([*out, raw[at:]]).decode()


_built: dict[str, Automaton] = {}  # of this worker: the last one built


def _scanner(held, window: int, text: str, cut: bool):
    key = uuid.uuid4().hex

    def automaton() -> Automaton:
        if key not in _built:
            _built.clear()
            _built[key] = Automaton(held.value, window)
        return _built[key]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = automaton()
        for batch in batches:
            row, state = batch.column("row"), batch.column("state")
            col = texts_of(row.field(text))
            before_spans, before_items, cuts = state.field("spans").to_pylist(), state.field("items").to_pylist(), [None] * len(col)
            n_words = np.zeros(len(col), np.int64)
            for i, j in runs_of(col):
                part = col.slice(i, j - i)
                buf, at = buffer_of(part)
                buf = LOWER[buf]
                starts, ends, first = find_words(buf, at, WORD)
                h = hash_spans(buf, starts, ends, auto.seed)
                n_words[i:j] = np.diff(first)
                for k in range(j - i):
                    a, b = first[k], first[k + 1]
                    spans, found = auto.match(h[a:b], lambda x, y, a=a: auto.vocab.find(buf, starts[a + x : a + y], ends[a + x : a + y], h[a + x : a + y]).tolist())
                    if found:
                        before_spans[i + k] = _merge([*((x["a"], x["b"]) for x in before_spans[i + k]), *spans])
                        before_items[i + k] = sorted({*before_items[i + k], *found})
                    else:
                        before_spans[i + k] = [(x["a"], x["b"]) for x in before_spans[i + k]]
                    if cut and before_spans[i + k]:
                        cuts[i + k] = _without(part[k].as_py(), before_spans[i + k], starts[a:b] - at[k], ends[a:b] - at[k])
            kind = pa.struct([("a", pa.int64()), ("b", pa.int64())])
            spans = pa.array([[{"a": a, "b": b} for a, b in x] for x in before_spans], pa.list_(kind))
            yield pa.RecordBatch.from_arrays([row, pa.StructArray.from_arrays([pa.array(n_words), spans, pa.array(before_items, pa.list_(pa.string())), pa.array(cuts, pa.string())], ["n_words", "spans", "items", "cut"])], ["row", "state"])

    return step


def _sifter(held, text: str):
    """Adds whether a document may hold a window, and counts its words."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieve: WindowFilter = held.value
        for batch in batches:
            row = batch.column("row")
            col = texts_of(row.field(text))
            n_words, may = np.zeros(len(col), np.int64), np.zeros(len(col), bool)
            for i, j in runs_of(col):
                buf, at = buffer_of(col.slice(i, j - i))
                buf = LOWER[buf]
                starts, ends, first = find_words(buf, at, WORD)
                n_words[i:j] = np.diff(first)
                may[i:j] = sieve.has(hash_spans(buf, starts, ends, 0), first)
            yield pa.RecordBatch.from_arrays([row, pa.array(n_words), pa.array(may)], ["row", "n_words", "may"])

    return step


def matched(docs: DataFrame, benchmark: DataFrame, columns: list[str], window: int = WINDOW, shard_chars: int = SHARD_CHARS, text: str = "text", cut: bool = False) -> DataFrame:
    """(row, state): the given columns of each document as a struct, and its words, hit ranges and items."""
    spark, items = docs.sparkSession, _items(benchmark)
    chars = items.agg(F.sum(F.length("t")).alias("n")).first()["n"] or 0
    parts = max(1, -(-chars // shard_chars))
    none = lambda n: F.struct(n.cast("bigint").alias("n_words"), F.array().cast(_STATE["spans"].dataType).alias("spans"), F.array().cast("array<string>").alias("items"), F.lit(None).cast("string").alias("cut"))
    df = docs.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row"))
    done = None
    if parts > 1:
        sieve = WindowFilter(chars, window)
        for part in _shards(items, parts):
            sieve.add([t for _, t in part])
        sifted = df.mapInArrow(_sifter(spark.sparkContext.broadcast(sieve), text), T.StructType([df.schema["row"], T.StructField("n_words", T.LongType()), T.StructField("may", T.BooleanType())]))
        done = sifted.where("not may").select("row", none(F.col("n_words")).alias("state"))
        df = sifted.where("may").select("row")
    df, before, read = df.select("row", none(F.lit(0)).alias("state")), None, None  # read: the table that df is made from
    for part in _shards(items, parts):
        if before is not None:
            written = materialise(spark, df)
            before.unpersist()
            if read is not None:
                discard(read)
            df = read = written
        before = spark.sparkContext.broadcast(part)
        df = df.mapInArrow(_scanner(before, window, text, cut), T.StructType([df.schema["row"], T.StructField("state", _STATE)]))
    return df if done is None else df.unionByName(done)


def n_hit() -> F.Column:
    return F.aggregate("state.spans", F.lit(0).cast("bigint"), lambda n, s: n + s["b"] - s["a"])


def contaminated() -> F.Column:
    return (n_hit() > 0) & (n_hit() * COVERAGE >= F.col("state.n_words"))


def measure(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, items (sorted), spans (ranges of hit words) and contaminated."""
    df = matched(docs, benchmark, ["doc_id", "text"], window, shard_chars)
    return df.select("row.doc_id", "state.n_words", n_hit().alias("n_hit"), "state.items", "state.spans", contaminated().alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_chars: int = SHARD_CHARS, cut: bool = False) -> DataFrame:
    """Documents without those that the coverage rule calls contaminated; with `cut`, hit ranges leave the texts of the others."""
    df = matched(docs, benchmark, docs.columns, window, shard_chars, cut=cut).where(~contaminated())
    one = lambda c: F.coalesce(F.col("state.cut"), F.col("row.text")).alias(c) if cut and c == "text" else F.col(f"row.`{c}`")
    return df.select(*(one(c) for c in docs.columns))
