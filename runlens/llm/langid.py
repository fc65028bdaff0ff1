"""Language identification with a byte convolutional network trained in numpy.

Bytes are folded into classes; filters of several widths slide over fixed-length windows of the whole text, the maximum
of each filter over a window feeds a softmax, and the windows' probabilities are averaged, weighted by their letters.
A filter's response is a sum of table entries, one for each byte or pair of bytes it covers, so that applying the
network is a few table look-ups per byte, batched over many windows.

Learning takes a bounded sample of every language: about `per_lang` documents of each, beyond LANGUAGES languages fewer in
proportion but one at least, chosen by a hash, of at most `sample_chars` characters each, and never those whose crc32(doc_id as text) mod 4 is 2 or whose lang is null.

Defined results: null texts and texts without letters are `und` with score 0; so is everything when there is nothing to
learn from; repeated documents each get their row; ties go to the language that sorts first; rows of null doc_id count
as not held out and are not learned from. The score is the mean probability of the predicted language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runlens.llm.spans import CHUNK, LOWER, buffer_of, runs_of, texts_of
from runlens.llm.toxicity import held_out
from runlens.session import materialise

WINDOW = 128  # bytes
WIDTHS = (2, 3, 4)
FILTERS = 16  # of each width
PER_LANG, SAMPLE_CHARS, LANGUAGES = 500, 20_000, 200
BROADCAST_ROWS = 1_000_000
NONE = "und"
CLASSES = 64
_RUN = 1 << 18  # bytes taken through the network at once


def _classes() -> np.ndarray:
    """By byte: letters keep their own class, digits and white space share one each, other bytes are folded."""
    out = np.zeros(256, np.int64)
    for b in range(256):
        if 97 <= b <= 122:
            out[b] = b - 96  # 1 to 26
        elif b >= 128:
            out[b] = 29 + b % 32 if b < 192 else 29 + (b * 5 + 16) % 32
        elif 48 <= b <= 57:
            out[b] = 27
        elif b in b"'-":
            out[b] = 28
        elif 33 <= b <= 127:
            out[b] = 61
    return out


_CLASS = _classes()[LOWER]


@dataclass
class Network:
    """filters: for each width an array (width, classes, filters); top: (all filters, languages)."""

    languages: list[str]
    filters: list[np.ndarray]
    bias: np.ndarray
    top: np.ndarray
    top_bias: np.ndarray

    def tables(self) -> list[list[tuple[int, np.ndarray, int]]]:
        """For each width: (offset, table by pair or class, bytes covered)."""
        out = []
        for w in self.filters:
            parts, at = [], 0
            while at < len(w):
                if at + 1 < len(w):
                    parts.append((at, (w[at][:, None, :] + w[at + 1][None, :, :]).reshape(CLASSES * CLASSES, -1).astype(np.float32), 2))
                    at += 2
                else:
                    parts.append((at, w[at].astype(np.float32), 1))
                    at += 1
            out.append(parts)
        return out


def _pooled(x: np.ndarray, tables: list, bias: np.ndarray) -> np.ndarray:
    """x: windows of classes. The largest response of each filter in each window."""
    pair = x[:, :-1] * CLASSES + x[:, 1:]
    out = []
    for width, parts in zip(WIDTHS, tables, strict=True):
        n = x.shape[1] - width + 1
        total = None
        for at, table, covers in parts:
            got = table[(pair if covers == 2 else x)[:, at : at + n]]
            total = got if total is None else np.add(total, got, out=total)
        out.append(total.max(1))
    return np.maximum(np.concatenate(out, 1) + bias, 0)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def windows_of(buf: np.ndarray, at: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows (as classes) that cover every text, the text of each, and its letters. The last is filled up with class 0."""
    sizes = np.diff(at)
    n = np.maximum(-(-sizes // window), 1)
    owner = np.repeat(np.arange(len(sizes)), n)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    begin, end = at[:-1][owner] + within * window, at[1:][owner]
    place = begin[:, None] + np.arange(window)
    inside = place < end[:, None]
    x = np.where(inside, _CLASS[buf[np.minimum(place, max(len(buf) - 1, 0))]], 0) if len(buf) else np.zeros((len(owner), window), np.int64)
    letters = ((x > 0) & (x < 27) | (x > 28) & (x < 61)).sum(1)
    return x, owner, letters


def train_network(texts: list[str], langs: list[str], epochs: int = 6, per_text: int = 6, rate: float = 0.01, seed: int = 0) -> Network | None:
    """Adam on the cross-entropy of single windows; gradients pass each maximum to the place that gave it."""
    names = sorted(set(langs))
    if not names:
        return None
    rng = np.random.default_rng(seed)
    col = pa.array(texts, pa.large_string())
    buf, at = buffer_of(col)
    x, owner, letters = windows_of(buf, at)
    order = rng.permutation(len(owner))
    order = order[np.argsort(owner[order], kind="stable")]
    rank = np.arange(len(order)) - np.searchsorted(owner[order], owner[order])
    keep = np.sort(order[(rank < per_text) & (letters[order] > 0)])
    number = {v: i for i, v in enumerate(names)}
    x, y = x[keep], np.array([number[v] for v in langs])[owner[keep]]
    weight = len(y) / (len(names) * np.maximum(np.bincount(y, minlength=len(names)), 1))
    total = FILTERS * len(WIDTHS)
    net = Network(names, [rng.normal(0, 0.3, (w, CLASSES, FILTERS)) for w in WIDTHS], np.zeros(total), rng.normal(0, 0.1, (total, len(names))), np.zeros(len(names)))
    params = [*net.filters, net.bias, net.top, net.top_bias]
    moment, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(len(y)), max(1, len(y) // 64)):
            xb, yb = x[rows], y[rows]
            peaks, values = [], []
            for w, f in zip(WIDTHS, net.filters, strict=True):
                n = xb.shape[1] - w + 1
                r = sum(f[k][xb[:, k : k + n]] for k in range(w))
                peaks.append(r.argmax(1))
                values.append(np.take_along_axis(r, peaks[-1][:, None, :], 1)[:, 0])
            z = np.concatenate(values, 1) + net.bias
            a = np.maximum(z, 0)
            p = _softmax(a @ net.top + net.top_bias)
            p[np.arange(len(yb)), yb] -= 1
            p *= (weight[yb] / len(yb))[:, None]
            down = (p @ net.top.T) * (z > 0)
            grads = []
            for k, (w, peak) in enumerate(zip(WIDTHS, peaks, strict=True)):
                g = np.zeros_like(net.filters[k])
                d = down[:, k * FILTERS : (k + 1) * FILTERS]
                for j in range(w):
                    c = np.take_along_axis(xb, peak + j, 1)
                    g[j] = np.bincount((c * FILTERS + np.arange(FILTERS)).ravel(), d.ravel(), CLASSES * FILTERS).reshape(CLASSES, FILTERS)
                grads.append(g)
            grads += [down.sum(0), a.T @ p + 1e-4 * net.top, p.sum(0)]
            step += 1
            for i, g in enumerate(grads):
                moment[i] = 0.9 * moment[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                params[i] -= rate * (moment[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    return net


class Predictor:
    """Applies a network to columns of texts."""

    def __init__(self, net: Network | None) -> None:
        self.net = net
        self.tables = net.tables() if net else []
        self.bias = net.bias.astype(np.float32) if net else None

    def _windows(self, x: np.ndarray) -> np.ndarray:
        step = max(1, _RUN // x.shape[1])
        return np.concatenate([_softmax(_pooled(x[i : i + step], self.tables, self.bias) @ self.net.top + self.net.top_bias) for i in range(0, len(x), step)])

    def predict(self, col: pa.LargeStringArray) -> tuple[list[str], np.ndarray]:
        lettered = pc.match_substring_regex(col, r"\p{L}").to_numpy(zero_copy_only=False)
        names, score = np.full(len(col), NONE, object), np.zeros(len(col))
        if self.net is None or not len(col):
            return names.tolist(), score
        for i, j in runs_of(col):
            buf, at = buffer_of(col.slice(i, j - i))
            total = np.zeros((j - i, len(self.net.languages)))
            # one long text goes piece by piece; pieces are whole windows
            for a in range(0, max(len(buf), 1), CHUNK) if j - i == 1 else (0,):
                x, owner, letters = windows_of(buf[a : a + CHUNK], np.array([0, min(CHUNK, len(buf) - a)])) if j - i == 1 else windows_of(buf, at)
                p = self._windows(x) * (letters + 1e-3)[:, None]
                total += np.column_stack([np.bincount(owner, p[:, k], j - i) for k in range(p.shape[1])])
            total /= total.sum(1, keepdims=True)
            best = total.argmax(1)
            names[i:j], score[i:j] = np.array(self.net.languages, object)[best], total[np.arange(j - i), best]
        names[~lettered], score[~lettered] = NONE, 0.0
        return names.tolist(), score


def train(docs: DataFrame, per_lang: int = PER_LANG, sample_chars: int = SAMPLE_CHARS) -> Network | None:
    """Learn from about per_lang documents of each language, fewer of each beyond LANGUAGES languages, chosen by a hash of doc_id and text."""
    known = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    fits = F.length("text").between(1, sample_chars)
    hash_ = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20))
    counts = known.groupBy("lang").agg(F.count("*").alias("_n"), F.min(F.when(fits, hash_)).alias("_least"))
    counts = materialise(docs.sparkSession, counts)
    languages = counts.count()
    if not languages:
        return None
    each = per_lang * min(1.0, LANGUAGES / languages)
    share, u = F.least(F.lit(1.0), F.lit(each) / F.col("_n")), lambda h: h / float(1 << 20)
    held = lambda df: F.broadcast(df) if languages <= BROADCAST_ROWS else df
    rows = known.join(held(counts), "lang").where(fits & (u(hash_) < share)).select("doc_id", "text", "lang")
    missed = counts.where(u(F.col("_least")) >= share)  # languages of which the share takes nothing: one document each
    if not missed.isEmpty():
        rows = rows.unionByName(known.join(held(missed), "lang").where(fits & (hash_ == F.col("_least"))).select("doc_id", "text", "lang").dropDuplicates(["lang"]))
    rows = rows.distinct()  # a row that is repeated a million times is learned from once
    got = rows.toArrow().to_pandas().sort_values(["doc_id", "text", "lang"], kind="stable")
    return train_network(got["text"].tolist(), got["lang"].tolist())


def identify(docs: DataFrame, net: Network | None) -> DataFrame:
    """The documents with lang_pred and score (replacing columns of those names); a map without a shuffle."""
    held = docs.sparkSession.sparkContext.broadcast(net)
    keep = [c for c in docs.columns if c not in ("lang_pred", "score")]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = Predictor(held.value)
        for batch in batches:
            row = batch.column("row")
            names, score = ready.predict(texts_of(row.field("text")))
            yield pa.RecordBatch.from_arrays([row, pa.array(names, pa.string()), pa.array(score, pa.float64())], ["row", "lang_pred", "score"])

    df = docs.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row"))
    df = df.mapInArrow(step, T.StructType([df.schema["row"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
    return df.select(*(F.col(f"row.`{c}`") for c in keep), "lang_pred", "score")
