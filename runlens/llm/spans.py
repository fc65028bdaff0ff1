"""Words of a column of texts as arrays: byte classes find them, hashes name them, their bytes decide.

All of it works on the UTF-8 buffer of an Arrow column, so that no Python loop runs over words. Texts are
taken in runs of about CHUNK bytes, which bounds memory however many rows a batch has; a longer text stands alone and
takes about 20 times its bytes while it is worked on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

CHUNK = 1 << 19
FAR = 256  # bytes; what is longer is hashed and compared one by one
CLASH = -2  # a word whose hash another word holds
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)  # masks of the first k bytes


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(inside: str | None = None, outside: str = "", above: bool = True) -> np.ndarray:
    """256 booleans: the bytes of `inside`, or all but those of `outside`; with `above` also all bytes of non-ASCII characters."""
    out = np.zeros(256, bool) if inside is not None else np.ones(256, bool)
    for c in (inside or "").encode():
        out[c] = True
    for c in outside.encode():
        out[c] = False
    out[128:] = above
    return out


def texts_of(col: pa.Array | pa.ChunkedArray) -> pa.LargeStringArray:
    """Nulls become empty texts."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    return pc.fill_null(col.cast(pa.large_string()), "")


def buffer_of(col: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the offsets (one more than texts) of each."""
    _, offs, data = col.buffers()
    at = np.frombuffer(offs, np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), at - at[0]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def runs_of(col: pa.LargeStringArray) -> Iterator[tuple[int, int]]:
    """(from, to) of runs of rows whose texts hold about CHUNK bytes; a longer text stands alone."""
    _, at = buffer_of(col)
    i, n = 0, len(col)
    while i < n:
        j = int(np.searchsorted(at, at[i] + CHUNK, side="right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j
        i = j


def find_words(buf: np.ndarray, at: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the longest runs of bytes of the class, and the index of the first word of each text (one more than texts)."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    m = inside[buf]
    begins = at[:-1][at[:-1] < at[1:]]
    start = m.copy()
    start[1:] &= ~m[:-1]
    start[begins] = m[begins]
    end = m.copy()
    end[:-1] &= ~m[1:]
    last = begins[1:] - 1
    end[last] = m[last]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, at)


def _eights(buf: np.ndarray) -> np.ndarray:
    """From every place the eight bytes that follow, as one number; zeros stand past the end."""
    padded = np.zeros(len(buf) + 8, np.uint8)
    padded[: len(buf)] = buf
    return np.ndarray(len(buf) + 1, "<u8", padded, strides=(1,))


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash for the bytes of each span.

    Eight bytes at a time are taken in and mixed by a bijection: words of equal size up to eight bytes never share a hash.
    """
    size = ends - starts
    h = mix(size.astype(np.uint64) * _STEP + np.uint64(seed))
    if not len(size):
        return h
    view = _eights(buf)
    h = mix(h ^ (view[starts] & _FIRST[np.minimum(size, 8)]))
    more, done = np.flatnonzero((size > 8) & (size <= FAR)), 8
    while len(more):
        h[more] = mix((h[more] * _STEP) ^ (view[starts[more] + done] & _FIRST[np.minimum(size[more] - done, 8)]))
        done += 8
        more = more[size[more] > done]
    for i in np.flatnonzero(size > FAR).tolist():
        h[i] = xxhash.xxh3_64_intdigest(buf[starts[i] : ends[i]].tobytes(), seed)
    return h


def same_bytes(one: np.ndarray, at: np.ndarray, other: np.ndarray, there: np.ndarray, size: np.ndarray, view: np.ndarray | None = None) -> np.ndarray:
    """Whether spans of two buffers hold the same bytes; `at` and `there` are where they start, `size` is how long both are, `view` is _eights(other)."""
    out = np.ones(len(size), bool)
    if not len(size):
        return out
    a, b = _eights(one), _eights(other) if view is None else view
    left, done = np.flatnonzero(size <= FAR), 0
    while len(left):
        mask = _FIRST[np.minimum(size[left] - done, 8)]
        same = (a[at[left] + done] & mask) == (b[there[left] + done] & mask)
        out[left[~same]] = False
        done += 8
        left = left[same & (size[left] > done)]
    for i in np.flatnonzero(size > FAR).tolist():
        out[i] = one[at[i] : at[i] + size[i]].tobytes() == other[there[i] : there[i] + size[i]].tobytes()
    return out


def word_hashes(buf: np.ndarray, at: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the index of the first word of each text."""
    starts, ends, first = find_words(buf, at, inside)
    return hash_spans(buf, starts, ends), first


class HashTable:
    """From 64-bit hashes to small integers; arrays in, arrays out."""

    def __init__(self, bits: int = 12) -> None:
        self._bits, self.n = bits, 0
        self._clear()

    def _clear(self) -> None:
        self._keys, self._vals = np.zeros(1 << self._bits, np.uint64), np.full(1 << self._bits, -1, np.int32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The value of each hash, -1 where there is none."""
        mask = np.uint64((1 << self._bits) - 1)
        slot = (h & mask).astype(np.int64)
        out = self._vals[slot].astype(np.int64)
        open_ = np.flatnonzero((out >= 0) & (self._keys[slot] != h))
        slot = slot[open_]
        while len(open_):
            slot = (slot + 1) & int(mask)
            got = self._vals[slot]
            out[open_] = got
            go = (got >= 0) & (self._keys[slot] != h[open_])
            open_, slot = open_[go], slot[go]
        return out

    def add(self, h: np.ndarray, vals: np.ndarray) -> None:
        """Distinct new hashes with their values, none negative."""
        if (self.n + len(h)) * 2 > 1 << self._bits:
            live = self._vals >= 0
            keys, old = self._keys[live], self._vals[live]
            while (self.n + len(h)) * 2 > 1 << self._bits:
                self._bits += 1
            self._clear()
            self._put(keys, old)
        self._put(h, vals)
        self.n += len(h)

    def _put(self, h: np.ndarray, vals: np.ndarray) -> None:
        mask = (1 << self._bits) - 1
        slot = (h & np.uint64(mask)).astype(np.int64)
        left = np.arange(len(h))
        while len(left):
            free = self._vals[slot[left]] < 0
            want = left[free]
            _, one = np.unique(slot[want], return_index=True)
            won = want[one]
            self._keys[slot[won]], self._vals[slot[won]] = h[won], vals[won]
            left = np.setdiff1d(left, won, assume_unique=True)
            slot[left] = np.where(self._vals[slot[left]] >= 0, (slot[left] + 1) & mask, slot[left])


class WordTable:
    """From byte strings to the numbers 0, 1, 2 ... in the order they are added. A hash finds an entry, its bytes must agree."""

    def __init__(self) -> None:
        self.n, self._used = 0, 0
        self._table = HashTable()
        self._hold(np.zeros(1 << 12, np.uint8))
        self._at, self._size = np.zeros(1 << 10, np.int64), np.zeros(1 << 10, np.int32)

    def _hold(self, flat: np.ndarray) -> None:
        self._flat, self._view = flat, np.ndarray(len(flat) - 8, "<u8", flat, strides=(1,))

    def find(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, h: np.ndarray) -> np.ndarray:
        """The number of each word, -1 where there is none, CLASH where another word has its hash."""
        k = self._table.find(h)
        hit = np.flatnonzero(k >= 0)
        entry, size = k[hit], (ends - starts)[hit]
        same = self._size[entry] == size
        far = np.flatnonzero(same & (size > 8))  # shorter words of one size and hash are equal
        same[far] = same_bytes(buf, starts[hit[far]], self._flat, self._at[entry[far]], size[far], self._view)
        k[hit[~same]] = CLASH
        return k

    def has(self, h: np.ndarray) -> np.ndarray:
        """Whether some word has this hash."""
        return self._table.find(h) >= 0

    def add(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, h: np.ndarray) -> None:
        """New words with distinct hashes."""
        size = ends - starts
        total, n = int(size.sum()), self.n + len(h)
        while self._used + total + 8 > len(self._flat):
            self._hold(np.concatenate((self._flat, np.zeros_like(self._flat))))
        while n > len(self._at):
            self._at, self._size = (np.concatenate((x, np.zeros_like(x))) for x in (self._at, self._size))
        at = np.cumsum(size) - size
        self._flat[self._used : self._used + total] = buf[np.arange(total) + np.repeat(starts - at, size)]
        self._at[self.n : n], self._size[self.n : n] = self._used + at, size
        self._table.add(h, np.arange(self.n, n))
        self._used, self.n = self._used + total, n
