"""Token counts under a unigram vocabulary, with one forward pass over a trie of distinct pre-tokens.

A pre-token is a run of other than white space with the blank before it. Its best segmentation maximises the sum of its
pieces' scores, and the best score of a prefix depends on that prefix alone: the distinct pre-tokens of a stretch of
texts go into a trie, level by level, and each node - each shared prefix - is scored once, as the best of its ancestors'
scores plus that of the piece between. The node where a pre-token ends holds its count, which the worker remembers and
uses again where the bytes agree.

Pieces and their order come from a public vocabulary file, whose path is a parameter; the score of a piece is
-log(rank + 2), rank being its place in the file. A byte that no piece covers counts as one token at UNKNOWN. Ties go to
the longer last piece. Pre-tokens over LONG bytes are scored one by one, without the trie.

Defined results: null and empty texts have 0 tokens; repeated rows are each counted; extra columns pass through.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runlens.llm.spans import CLASH, WordTable, buffer_of, byte_class, find_words, hash_spans, runs_of, texts_of

UNKNOWN = -25.0
LONG = 96  # bytes
KEPT = 520_000  # pre-tokens a worker remembers; beyond that it starts anew
_WORD = byte_class(outside=" \t\n\r\f\v")


def pieces_of(path: str) -> dict[bytes, float]:
    """Pieces with scores. The word mark of the file becomes a blank; control and byte pieces are left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    return {name.replace("▁", " ").encode(): -math.log(rank + 2) for rank, name in enumerate(names)}


def count_one(word: bytes, pieces: dict[bytes, float], longest: int) -> int:
    """Tokens of one pre-token by the plain forward recurrence."""
    best, count = [0.0] * (len(word) + 1), [0] * (len(word) + 1)
    for i in range(1, len(word) + 1):
        score, at = best[i - 1] + UNKNOWN, i - 1
        for j in range(i - 1, max(-1, i - longest - 1), -1):
            s = pieces.get(word[j:i])
            if s is not None and best[j] + s >= score:
                score, at = best[j] + s, j
        best[i], count[i] = score, count[at] + 1
    return count[-1]


class Counter:
    """Counts tokens of texts; keeps what it learnt about pre-tokens."""

    def __init__(self, path: str) -> None:
        self.pieces = pieces_of(path)
        self.longest = max(map(len, self.pieces))
        self._link()
        self._forget()

    def _forget(self) -> None:
        self.known, self.counts = WordTable(), np.zeros(1 << 16, np.int64)

    def _link(self) -> None:
        """For every state of a text's end (its longest ending that begins a piece): the next state by byte, and the pieces that end there, longest first."""
        child: list[dict[int, int]] = [{}]
        score, depth = [np.nan], [0]
        for piece, value in self.pieces.items():
            at = 0
            for b in piece:
                to = child[at].get(b)
                if to is None:
                    to = child[at][b] = len(child)
                    child.append({})
                    score.append(np.nan)
                    depth.append(depth[at] + 1)
                at = to
            score[at] = value
        n = len(child)
        self.goto, self.score, self.size = np.zeros((n, 256), np.int32), np.array(score), np.array(depth)
        self.ends, self.shorter = np.zeros(n, np.int32), np.zeros(n, np.int32)  # the longest piece that ends here (0: none), and the one after it
        fail, todo = np.zeros(n, np.int32), [0]
        for at in todo:
            if at:
                self.goto[at] = self.goto[fail[at]]
                whole = not np.isnan(self.score[at])
                self.ends[at] = at if whole else self.ends[fail[at]]
                self.shorter[at] = self.ends[fail[at]] if whole else 0
            for b, to in child[at].items():
                fail[to] = self.goto[at, b] if at else 0
                self.goto[at, b] = to
                todo.append(to)

    def trie(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Counts of distinct pre-tokens, given as spans: one level of the trie after the other."""
        size = ends - starts
        deepest = int(size.max(initial=0))
        node, state = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        best, tokens = np.zeros((len(starts), deepest + 1)), np.zeros((len(starts), deepest + 1), np.int16)  # along each pre-token's path
        for depth in range(1, deepest + 1):
            live = np.flatnonzero(size >= depth)
            byte = buf[starts[live] + depth - 1]
            state[live] = self.goto[state[live], byte]
            _, one, back = np.unique(node[live] * 256 + byte, return_index=True, return_inverse=True)
            first = live[one]  # a pre-token for each node of this level
            top, from_ = np.full(len(one), -np.inf), np.full(len(one), depth - 1)
            some, piece = np.arange(len(one)), self.ends[state[first]]
            while True:
                on = piece > 0
                some, piece = some[on], piece[on]
                if not len(some):
                    break
                at = depth - self.size[piece]
                s = best[first[some], at] + self.score[piece]
                better = s > top[some]
                top[some[better]], from_[some[better]] = s[better], at[better]
                piece = self.shorter[piece]
            alone = best[first, depth - 1] + UNKNOWN > top
            top[alone], from_[alone] = best[first[alone], depth - 1] + UNKNOWN, depth - 1
            best[live, depth], tokens[live, depth] = top[back], (tokens[first, from_] + 1)[back]
            node[live] = back
        return tokens[np.arange(len(starts)), size].astype(np.int64)

    def count(self, col: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens and pre-tokens of each text."""
        tokens, words = np.zeros(len(col), np.int64), np.zeros(len(col), np.int64)
        for i, j in runs_of(col):
            buf, at = buffer_of(col.slice(i, j - i))
            starts, ends, first = find_words(buf, at, _WORD)
            h = hash_spans(buf, starts, ends)
            k = self.known.find(buf, starts, ends, h)
            new = np.flatnonzero(k == -1)
            if len(new):
                if self.known.n + len(new) > KEPT:
                    self._forget()
                    new = np.arange(len(h))
                names, spot = np.unique(h[new], return_index=True)
                self._learn(names, buf, starts[new[spot]], ends[new[spot]])
                k[new] = self.known.find(buf, starts[new], ends[new], h[new])
            count = self.counts[np.maximum(k, 0)]
            for x in np.flatnonzero(k == CLASH).tolist():  # its hash belongs to another pre-token
                count[x] = count_one(b" " + buf[starts[x] : ends[x]].tobytes(), self.pieces, self.longest)
            total = np.zeros(len(k) + 1, np.int64)
            np.cumsum(count, out=total[1:])
            tokens[i:j], words[i:j] = total[first[1:]] - total[first[:-1]], np.diff(first)
        return tokens, words

    def _learn(self, names: np.ndarray, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        size = ends - starts
        at = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size + 1, out=at[1:])
        flat = np.full(at[-1], 32, np.uint8)  # each with a blank before it
        inner = np.arange(at[-1]) - np.repeat(at[:-1], size + 1)
        body = inner > 0
        flat[body] = buf[(np.repeat(starts, size + 1) + inner - 1)[body]]
        counts = np.zeros(len(size), np.int64)
        short = np.flatnonzero(size < LONG)
        counts[short] = self.trie(flat, at[:-1][short], at[1:][short])
        for k in np.flatnonzero(size >= LONG).tolist():
            counts[k] = count_one(flat[at[k] : at[k + 1]].tobytes(), self.pieces, self.longest)
        n = self.known.n
        while n + len(names) > len(self.counts):
            self.counts = np.concatenate((self.counts, np.zeros_like(self.counts)))
        self.counts[n : n + len(names)] = counts
        self.known.add(buf, starts, ends, names)


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """One per worker and file. The path must exist on every executor, as the tokenizers' package does."""
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def count_tokens(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """The documents with n_tokens and n_pre_tokens (replacing columns of those names), a map without a shuffle."""
    keep = [c for c in docs.columns if c not in ("n_tokens", "n_pre_tokens")]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for batch in batches:
            row = batch.column("row")
            tokens, words = own.count(texts_of(row.field(text)))
            yield pa.RecordBatch.from_arrays([row, pa.array(tokens), pa.array(words)], ["row", "n_tokens", "n_pre_tokens"])

    df = docs.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row"))
    df = df.mapInArrow(step, T.StructType([df.schema["row"], T.StructField("n_tokens", T.LongType()), T.StructField("n_pre_tokens", T.LongType())]))
    return df.select(*(F.col(f"row.`{c}`") for c in keep), "n_tokens", "n_pre_tokens")
