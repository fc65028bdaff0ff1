"""SentencePiece encoding and decoding by a table of last tokens.

A byte-pair model merges, of all neighbours whose joined text is a piece, those of the best score first, the leftmost
among equals. What it makes of a prefix of a text ends in one certain token, and a token t may stand after a token u only
if the model makes exactly (u, t) of the two written together. So the table is filled from left to right: an automaton
names the pieces that end at a place, longest first; the one that fits the last token of the prefix before it is this
prefix's last token. Reading the table backwards from the end gives the ids. That takes one step for each byte, not a
queue of merges for each text. Whether two tokens fit is worked out once for each pair a worker meets.

Two characters that stand together in no piece are never merged: texts are cut there (before blanks; in words of more than
CUT bytes everywhere), each distinct stretch goes through the table once, and the worker remembers its ids, which are
used again only where the bytes agree. Stretches of a batch are worked on together, place by place; one of more than
LONG bytes alone.

Models: byte-pair ones whose normaliser is the identity, that put a blank before the text and keep extra blanks, and have
byte pieces for what no piece covers; others are refused. The file's path is a parameter and must exist on every executor.

Defined results: null and empty texts have no ids and decode to an empty text; repeated rows are each encoded; extra
columns pass through; columns named like the result are replaced; null ids decode like none.
"""

from __future__ import annotations

import codecs
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runlens.llm.spans import CLASH, HashTable, WordTable, buffer_of, hash_spans, mix, runs_of, texts_of

MARK = "▁"  # how a model writes a blank
CUT, LONG = 64, 256  # bytes
KEPT = 400_000  # stretches a worker remembers; beyond that it starts anew
PAIRS = 2_000_000  # pairs of tokens a worker remembers
TABLE = 1 << 21  # cells of the table at once


def _each_byte(error: UnicodeDecodeError) -> tuple[str, int]:
    return "�" * (error.end - error.start), error.end


codecs.register_error("runlens_each_byte", _each_byte)


class Model:
    """Pieces of a model file; piece k of the table is the k-th ordinary piece, from 1. Blanks stand for marks."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        size = lib.get_piece_size()
        plain = [i for i in range(size) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i))]
        names = {i: lib.id_to_piece(i) for i in range(size)}
        self.byte_id = np.full(256, -1, np.int32)
        for i in range(size):
            if lib.is_byte(i):
                self.byte_id[int(names[i][1:-1], 16)] = i
        if (self.byte_id < 0).any() or lib.normalize(" ﬁ  x ") != f"{MARK * 2}ﬁ{MARK * 2}x{MARK}":
            raise ValueError("only models with byte pieces, an identity normaliser and a blank before the text are supported")
        self.text = [""] + [names[i].replace(MARK, " ") for i in plain]
        self.score = {t: lib.get_score(i) for t, i in zip(self.text[1:], plain, strict=True)}
        self.id = np.array([0, *plain], np.int32)
        chars = {c for t in self.text for c in t}
        if not chars <= self.score.keys():
            raise ValueError("a character of a piece is no piece itself")
        self.size = np.array([len(t.encode()) for t in self.text], np.int64)
        self.beside = np.unique(np.array([ord(a) << 21 | ord(b) for t in self.text for a, b in zip(t, t[1:], strict=False)], np.int64))
        # of every id: the bytes it decodes to, and whether it is dropped
        self.out = [b""] * size
        for i in range(size):
            self.out[i] = b"" if lib.is_control(i) else lib.decode([i]).encode() if lib.is_unknown(i) else bytes([int(names[i][1:-1], 16)]) if lib.is_byte(i) else names[i].replace(MARK, " ").encode()
        self.ordinary = {*plain}
        self._link()
        self._known: dict[int, bool] = {}
        self._pairs = HashTable()

    def _link(self) -> None:
        """The automaton over bytes: the next state, the longest piece that ends in a state, and the next shorter one."""
        child: list[dict[int, int]] = [{}]
        whole = [0]
        for k, text in enumerate(self.text[1:], 1):
            at = 0
            for b in text.encode():
                to = child[at].get(b)
                if to is None:
                    to = child[at][b] = len(child)
                    child.append({})
                    whole.append(0)
                at = to
            whole[at] = k
        self.goto = np.zeros((len(child), 256), np.int32)
        self.ends, self.shorter = np.zeros(len(child), np.int32), np.zeros(len(self.text), np.int32)
        fail, todo = [0] * len(child), [0]
        for at in todo:
            if at:
                self.goto[at] = self.goto[fail[at]]
                self.ends[at] = whole[at] or self.ends[fail[at]]
                if whole[at]:
                    self.shorter[whole[at]] = self.ends[fail[at]]
            for b, to in child[at].items():
                fail[to] = int(self.goto[at, b]) if at else 0
                self.goto[at, b] = to
                todo.append(to)

    def merge(self, text: str) -> list[str]:
        """What the model makes of a text, merge by merge."""
        part, left, right = list(text), list(range(-1, len(text) - 1)), [*range(1, len(text)), -1]
        queue: list[tuple[float, int, int, int]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b >= 0 and (s := self.score.get(part[a] + part[b])) is not None:
                heapq.heappush(queue, (-s, a, b, len(part[a]) + len(part[b])))

        for i in range(len(text) - 1):
            offer(i, i + 1)
        while queue:
            _, a, b, n = heapq.heappop(queue)
            if not part[a] or not part[b] or len(part[a]) + len(part[b]) != n:
                continue
            part[a], part[b], right[a] = part[a] + part[b], "", right[b]
            if right[b] >= 0:
                left[right[b]] = a
            offer(left[a], a)
            offer(a, right[a])
        return [p for p in part if p]

    def fits(self, u: int, t: int) -> bool:
        """Whether piece t may follow piece u; u = 0: whether t may begin a text, or follow what no piece covers."""
        return self.merge(self.text[u] + self.text[t]) == ([self.text[u], self.text[t]] if u else [self.text[t]])

    def all_fit(self, u: np.ndarray, t: np.ndarray) -> np.ndarray:
        """`fits` of many pairs, remembered."""
        key = mix(u.astype(np.uint64) * np.uint64(len(self.text)) + t.astype(np.uint64))
        got = self._pairs.find(key)
        new = np.flatnonzero(got < 0)
        if len(new):
            names, one = np.unique(key[new], return_index=True)
            if self._pairs.n + len(names) > PAIRS:
                self._pairs = HashTable()
            some = new[one]
            self._pairs.add(names, np.fromiter((self.fits(a, b) for a, b in zip(u[some].tolist(), t[some].tolist(), strict=True)), np.int64, len(some)))
            got[new] = self._pairs.find(key[new])
        return got > 0

    def table(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A row for each stretch: at every end of a character its prefix's last piece, or minus the bytes of a character that no piece covers; 0 where none fits."""
        size = ends - starts
        deepest = int(size.max(initial=0))
        last, state = np.zeros((len(size), deepest + 1), np.int32), np.zeros(len(size), np.int64)
        began = np.zeros(len(size), np.int64)  # of the character that a place belongs to
        for depth in range(1, deepest + 1):
            live = np.flatnonzero(size >= depth)
            at = starts[live] + depth - 1
            byte = buf[at]
            lead = (byte & 0xC0) != 0x80
            began[live[lead]] = depth - 1
            state[live] = self.goto[state[live], byte]
            some = live[(size[live] == depth) | ((buf[np.minimum(at + 1, len(buf) - 1)] & 0xC0) != 0x80)]
            piece = self.ends[state[some]].astype(np.int64)
            bare = piece == 0
            last[some[bare], depth] = began[some[bare]] - depth
            some, piece = some[~bare], piece[~bare]
            while len(some):
                good = self.all_fit(np.maximum(last[some, depth - self.size[piece]], 0), piece)
                last[some[good], depth] = piece[good]
                some, piece = some[~good], self.shorter[piece[~good]].astype(np.int64)
                some, piece = some[piece > 0], piece[piece > 0]
        return last

    def backwards(self, last: np.ndarray, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all stretches in a row, and how many each has, from the table's rows."""
        at, live, n = ends - starts, np.arange(len(starts)), 0
        owner, turn, place, token = [], [], [], []
        live = live[at > 0]
        while len(live):
            tok = last[live, at[live]].astype(np.int64)
            at[live] -= np.where(tok > 0, self.size[np.maximum(tok, 0)], -tok)
            owner.append(live)
            turn.append(np.full(len(live), n))
            place.append(starts[live] + at[live])
            token.append(tok)
            live, n = live[at[live] > 0], n + 1
        if not owner:
            return np.zeros(0, np.int32), np.zeros(len(starts), np.int64)
        own, tok, spot = np.concatenate(owner), np.concatenate(token), np.concatenate(place)
        order = np.lexsort((-np.concatenate(turn), own))
        own, tok, spot = own[order], tok[order], spot[order]
        each = np.where(tok > 0, 1, -tok)
        upto = np.cumsum(each)
        ids = np.repeat(self.id[np.maximum(tok, 0)], each)
        raw = np.repeat(tok < 0, each)
        place_of = np.repeat(spot - (upto - each), each) + np.arange(len(ids))
        ids[raw] = self.byte_id[buf[place_of[raw]]]
        return ids, np.bincount(own, weights=each, minlength=len(starts)).astype(np.int64)

    def ids_alone(self, raw: bytes) -> list[int]:
        """Ids of one stretch of any length: the same table, one place after the other."""
        n, last, state, began = len(raw), [0] * (len(raw) + 1), 0, 0
        for i in range(1, n + 1):
            if raw[i - 1] & 0xC0 != 0x80:
                began = i - 1
            state = int(self.goto[state, raw[i - 1]])
            if i < n and raw[i] & 0xC0 == 0x80:
                continue
            p = int(self.ends[state])
            if not p:
                last[i] = began - i
                continue
            while p:
                u = max(last[i - int(self.size[p])], 0)
                key = u * len(self.text) + p
                good = self._known.get(key)
                if good is None:
                    if len(self._known) > PAIRS:
                        self._known.clear()
                    good = self._known[key] = self.fits(u, p)
                if good:
                    last[i] = p
                    break
                p = int(self.shorter[p])
            else:
                return self.ids_by_merges(raw)
        out, at = [], n
        while at:
            tok = last[at]
            if tok > 0:
                out.append(int(self.id[tok]))
                at -= int(self.size[tok])
            else:
                out += [int(self.byte_id[b]) for b in reversed(raw[at + tok : at])]
                at += tok
        return out[::-1]

    def ids_by_merges(self, raw: bytes) -> list[int]:
        """The plain way: used where no piece fits the table, which the public models never ask for."""
        number = {t: int(i) for t, i in zip(self.text[1:], self.id[1:].tolist(), strict=True)}
        return [i for t in self.merge(raw.decode()) for i in ([number[t]] if t in number else [int(self.byte_id[b]) for b in t.encode()])]

    def decode(self, ids: list[int]) -> str:
        """Pieces in a row without the blank before the text; bytes that are no character give a replacement character each."""
        k = 0
        while k < len(ids) and not self.out[ids[k]]:
            k += 1
        raw = b"".join(map(self.out.__getitem__, ids[k:]))
        if k < len(ids) and ids[k] in self.ordinary and raw[:1] == b" ":
            raw = raw[1:]
        return raw.decode("utf-8", "runlens_each_byte")


class Encoder:
    """Ids of texts; keeps what it learnt about stretches."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self._forget()

    def _forget(self) -> None:
        self.words, self.flat, self.used = WordTable(), np.zeros(1 << 16, np.int32), 0
        self.off, self.size = np.zeros(1 << 13, np.int64), np.zeros(1 << 13, np.int32)

    def stretches(self, buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where stretches start and end; together they are the whole texts."""
        blank = buf == 32
        begin = np.zeros(len(buf), bool)
        begin[1:] = blank[1:] & ~blank[:-1]
        begin[at[:-1][at[:-1] < len(buf)]] = True
        starts = np.flatnonzero(begin)
        ends = np.append(starts[1:], len(buf))
        cuts = []
        for i in np.flatnonzero(ends - starts > CUT).tolist():
            raw = buf[starts[i] : ends[i]]
            points = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32).astype(np.int64)
            apart = ~np.isin(points[:-1] << 21 | points[1:], self.model.beside)
            cuts.append(starts[i] + np.flatnonzero((raw & 0xC0) != 0x80)[1:][apart])
        if cuts:
            starts = np.sort(np.concatenate((starts, *cuts)))
            ends = np.append(starts[1:], len(buf))
        return starts, ends

    def _ids(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of stretches in a row and how many each has: a table for those of like sizes, long ones alone."""
        size = ends - starts
        order = np.argsort(size, kind="stable")
        short, i = int(np.searchsorted(size[order], LONG, side="right")), 0
        which, made, each = [], [], np.zeros(len(size), np.int64)

        def keep(some: np.ndarray, ids: np.ndarray, n: np.ndarray) -> None:
            which.append(some)
            made.append(ids)
            each[some] = n

        def alone(k: int, ids: list[int]) -> None:
            keep(np.array([k]), np.array(ids, np.int32), np.array([len(ids)]))

        while i < short:
            j = min(short, i + TABLE // (LONG + 1))
            some = order[i:j]
            last = self.model.table(buf, starts[some], ends[some])
            bad = (last[np.arange(len(some)), size[some]] == 0) & (size[some] > 0)
            good = some[~bad]
            keep(good, *self.model.backwards(last[~bad], buf, starts[good], ends[good]))
            for k in some[bad].tolist():
                alone(k, self.model.ids_by_merges(buf[starts[k] : ends[k]].tobytes()))
            i = j
        for k in order[short:].tolist():
            alone(k, self.model.ids_alone(buf[starts[k] : ends[k]].tobytes()))
        if not which:
            return np.zeros(0, np.int32), each
        spot = np.zeros(len(size), np.int64)  # of each stretch's ids among those made
        done = np.concatenate(which)
        spot[done] = np.cumsum(each[done]) - each[done]
        return np.concatenate(made)[np.arange(int(each.sum())) + np.repeat(spot - (np.cumsum(each) - each), each)], each

    def _learn(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, names: np.ndarray) -> None:
        ids, sizes = self._ids(buf, starts, ends)
        n, m = self.words.n, self.words.n + len(names)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        while m > len(self.off):
            self.off, self.size = (np.concatenate((x, np.zeros_like(x))) for x in (self.off, self.size))
        self.flat[self.used : self.used + len(ids)] = ids
        self.off[n:m], self.size[n:m] = self.used + np.cumsum(sizes) - sizes, sizes
        self.used += len(ids)
        self.words.add(buf, starts, ends, names)

    def encode(self, col: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where those of each text start (one more than texts)."""
        col = pc.replace_substring(col, MARK, " ")
        col = pc.if_else(pc.equal(col, ""), "", pc.binary_join_element_wise(pa.scalar("", pa.large_string()), col, pa.scalar(" ", pa.large_string())))
        out, sizes = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]
        for i, j in runs_of(col):
            buf, at = buffer_of(col.slice(i, j - i))
            if not len(buf):
                sizes.append(np.zeros(j - i, np.int64))
                continue
            starts, ends = self.stretches(buf, at)
            ids, each = self._look_up(buf, starts, ends)
            upto = np.concatenate(([0], np.cumsum(each)))
            out.append(ids)
            sizes.append(np.diff(upto[np.searchsorted(starts, at)]))
        return np.concatenate(out), np.cumsum(np.concatenate(sizes))

    def _look_up(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = hash_spans(buf, starts, ends)
        k = self.words.find(buf, starts, ends, h)
        new = np.flatnonzero(k == -1)
        if len(new):
            if self.words.n + len(new) > KEPT:
                self._forget()
                new = np.arange(len(h))
            names, one = np.unique(h[new], return_index=True)
            spot = new[one]
            self._learn(buf, starts[spot], ends[spot], names)
            k[new] = self.words.find(buf, starts[new], ends[new], h[new])
        clash = np.flatnonzero(k == CLASH)
        if len(clash):  # a hash that another stretch holds: all of this run without what is remembered
            return self._ids(buf, starts, ends)
        each = self.size[k].astype(np.int64)
        upto = np.cumsum(each)
        return self.flat[np.arange(int(each.sum())) + np.repeat(self.off[k] - (upto - each), each)], each


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per worker and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(Model(path))
    return _encoders[path]


def _mapped(df: DataFrame, reads: str, writes: str, kind: T.DataType, make) -> DataFrame:
    """`df` with the column `writes` (replacing one of that name) made of the column `reads`; a map without a shuffle."""
    keep = [c for c in df.columns if c != writes]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column("row")
            yield pa.RecordBatch.from_arrays([row, make(batch.column("read"))], ["row", "made"])

    row = F.struct(*(F.col(f"`{c}`") for c in keep)) if keep else F.struct(F.lit(0).alias("nothing"))
    plan = df.select(row.alias("row"), F.col(f"`{reads}`").alias("read"))
    plan = plan.mapInArrow(step, T.StructType([plan.schema["row"], T.StructField("made", kind)]))
    return plan.select(*(F.col(f"row.`{c}`") for c in keep), F.col("made").alias(writes))


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """The documents with their ids, an array of integers, in place of a column of that name."""

    def make(col: pa.Array) -> pa.Array:
        flat, at = encoder(path).encode(texts_of(col))
        return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat, pa.int32()))

    return _mapped(docs, text, ids, T.ArrayType(T.IntegerType()), make)


def decode(tokens: DataFrame, path: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """The rows with the text that their ids stand for, in place of a column of that name."""

    def make(col: pa.Array) -> pa.Array:
        model = encoder(path).model
        return pa.array([model.decode(x.as_py() or []) for x in col], pa.string())

    return _mapped(tokens, ids, text, T.StringType(), make)
