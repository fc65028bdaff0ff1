"""Toxicity by gradient-boosted trees over dense features, calibrated by isotonic regression.

Features of a whole text: densities of a fixed and of a learned lexicon (whole words and word beginnings), the densest
stretch of words, closeness of lexicon words to second-person words, shares of capitals, punctuation and symbols, and
obfuscated words (letters with digits or symbols inside), which are also looked up as they read once undone.

Learning takes at most `sample_docs` labelled documents of at most `sample_chars` characters each, the first by a hash
of their id, never those whose crc32(doc_id as text) mod 4 is 2. The lexicon and the calibration are cross-fitted: the
trees never see a count made with the row's own label, and the calibration never a score of a tree that saw the row.

Defined results: null and empty texts are scored like any text without words; repeated documents each get their score;
rows of null doc_id or null label are not learned from and count as not held out; documents with several labels count
as toxic if one says so; without a toxic and a clean label to learn from every score is the share of toxic labels (0 if
there are none). Extra columns of documents pass through where asked for.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runlens.llm.spans import LOWER, HashTable, buffer_of, byte_class, find_words, hash_spans, runs_of, texts_of

SAMPLE_DOCS, SAMPLE_CHARS = 6_000, 20_000
THRESHOLD = 0.3
FOLDS = 3
BEGINNINGS = (4, 5, 6, 7)  # bytes of a word's beginning that can be learned, beside whole words
LEARNED = 4000
COUNTED = 1 << 19  # pieces that are counted at once
COPIES = 8  # hashes that name a document when copies are told
STRETCH, NEAR = 50, 5  # words

#: Insults and threats that need no learning.
LEXICON = (
    "idiot idiots moron morons stupid dumb dumbass loser losers scum trash garbage worthless pathetic disgusting clown "
    "jerk bastard bitch bitches asshole assholes bullshit shit shitty fuck fucking fucker crap retard retarded whore slut "
    "imbecile cretin vermin filth freak creep "
    "connard connasse salaud salope merde putain abruti débile crétin arschloch scheisse scheiße hurensohn schlampe "
    "dummkopf abschaum wichser puta puto mierda cabrón gilipollas estúpido estúpida imbécil idiota basura pendejo"
).split()
#: Second-person words of four languages.
YOU = "you your yours yourself u ur tu toi te ton ta tes vous votre vos du dich dir dein deine deinen ihr euch sie usted ustedes vosotros tú ti tus".split()
#: What stands for a letter in obfuscated words.
UNDO = str.maketrans("01345789@$!|+€", "oieastbgasiite")

_WORD = byte_class("0123456789abcdefghijklmnopqrstuvwxyz")
_TOKEN = byte_class(outside=" \t\n\r\f\v")
_LETTERS = byte_class("abcdefghijklmnopqrstuvwxyz")
_UPPER = byte_class("ABCDEFGHIJKLMNOPQRSTUVWXYZ", above=False)
_DIGIT = byte_class("0123456789", above=False)
_SYMBOL = byte_class("#$%&*@^_~|<>=+\\/", above=False)
_PUNCT = byte_class(".,;:!?'\"()-[]{}", above=False)
_INNER = re.compile(r"[^\W\d_](?:[\d@$!|+*._\-#%^~]+[^\W\d_]|[\d@$!|+]+$)")

FEATURES = [
    "log_words", "fixed_hits", "fixed_density", "learned_hits", "learned_density", "learned_weight", "best_weight", "densest",
    "near_you", "you_density", "capitals", "exclamations", "punctuation", "symbols", "digits", "obfuscated", "undone_hits",
]


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that nothing is learned from; a null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(4)) == 2, F.lit(False))


def _word_set(words: list[str]) -> HashTable:
    col = pa.array([" ".join(words)], pa.large_string())
    buf, at = buffer_of(col)
    starts, ends, _ = find_words(buf, at, _WORD)
    names = np.unique(hash_spans(buf, starts, ends))
    table = HashTable()
    table.add(names, np.arange(len(names)))
    return table


_fixed: list[HashTable] = []


def _fixed_tables() -> list[HashTable]:
    if not _fixed:
        _fixed.extend([_word_set(LEXICON), _word_set(YOU)])
    return _fixed


def _pieces(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Hashes of whole words and, salted by length, of their beginnings (0: the word has no such beginning)."""
    out = [hash_spans(buf, starts, ends)]
    for k in BEGINNINGS:
        long = ends - starts > k
        h = hash_spans(buf, starts, np.where(long, starts + k, ends)) ^ np.uint64(k)
        out.append(np.where(long, h, np.uint64(0)))
    return out


@dataclass
class Lexicon:
    """Learned pieces with their log odds."""

    names: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))

    def table(self) -> HashTable:
        t = HashTable()
        if len(self.names):
            t.add(self.names, np.arange(len(self.names)))
        return t


def _pieces_by_text(col: pa.LargeStringArray) -> Iterator[np.ndarray]:
    """The distinct pieces of each text, ascending."""
    for i, j in runs_of(col):
        buf, at = buffer_of(col.slice(i, j - i))
        buf = LOWER[buf]
        starts, ends, first = find_words(buf, at, _WORD)
        every = _pieces(buf, starts, ends)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            yield np.unique(np.concatenate([h[a:b] for h in every]))


def _once(pieces: Iterator[np.ndarray]) -> Iterator[np.ndarray]:
    """Of texts that share their smallest hashes - copies - one."""
    seen: set[bytes] = set()
    for p in pieces:
        name = p[:COPIES].tobytes()
        if name not in seen:
            seen.add(name)
            yield p


def learn_lexicon(col: pa.LargeStringArray, toxic: np.ndarray) -> Lexicon:
    """Kept: pieces clearly likelier in toxic documents; of copies one counts for each label.

    A piece must stand in so many toxic documents that chance alone would hardly give one such piece. Clean documents are
    gone through a stretch at a time: only what toxic ones hold is counted in them.
    """
    some = list(_once(_pieces_by_text(col.filter(pa.array(toxic)))))
    names, a = np.unique(np.concatenate(some), return_counts=True) if some else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    n1, n0 = max(len(some), 1), 0
    del some
    table, b = HashTable(), np.zeros(len(names), np.int64)
    table.add(names, np.arange(len(names)))
    held: list[np.ndarray] = []

    def count() -> None:
        k = table.find(np.concatenate(held)) if held else np.zeros(0, np.int64)
        b[:] += np.bincount(k[k >= 0], minlength=len(b))[: len(b)]
        held.clear()

    for p in _once(_pieces_by_text(col.filter(pa.array(~toxic)))):
        held.append(p)
        n0 += 1
        if sum(map(len, held)) >= COUNTED:
            count()
    count()
    n0 = max(n0, 1)
    odds = np.log((a + 0.5) / (n1 + 1)) - np.log((b + 0.5) / (n0 + 1))
    share = (a + b) / (n1 + n0)
    z = (a - n1 * share) / np.sqrt(np.maximum(n1 * share * (1 - share), 1e-9))
    frequency, least = np.bincount(a + b), 3
    while least < len(frequency) and frequency[least] * (n1 / (n1 + n0)) ** least > 0.5:
        least += 1
    keep = np.flatnonzero((a >= least) & (odds >= 1.5) & (z >= 3) & (names != 0))
    keep = keep[np.argsort(-(a[keep] * odds[keep]), kind="stable")[:LEARNED]]
    return Lexicon(names[keep], odds[keep].astype(np.float32))


def _per_text(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of values between the offsets."""
    total = np.zeros(len(values) + 1, np.float64)
    np.cumsum(values, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


def _inner_symbols(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, list[tuple[int, str]]]:
    """Obfuscated words per text, and what they read once undone: (text, word)."""
    starts, ends, first = find_words(buf, at, _TOKEN)
    letters = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(_LETTERS[buf], out=letters[1:])
    size, kept = ends - starts, letters[ends] - letters[starts]
    odd = np.flatnonzero((kept >= 2) & (kept < size) & (size <= 30))
    # punctuation at the ends alone is no obfuscation: the letters must not be one run
    run = np.zeros(len(buf) + 1, np.int64)
    m = _LETTERS[buf]
    edge = m.copy()
    edge[1:] &= ~m[:-1]
    np.cumsum(edge, out=run[1:])
    s, e = starts[odd], ends[odd]
    runs = run[e] - run[s] + (m[s] & ~edge[s])
    digit = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(_DIGIT[buf] | (buf == 64) | (buf == 36), out=digit[1:])
    odd = odd[(runs >= 2) | ((digit[e] - digit[s] > 0) & (kept[odd] >= 2))]
    count = np.zeros(len(at) - 1)
    words: list[tuple[int, str]] = []
    owner = np.searchsorted(first, odd, side="right") - 1
    raw = buf.tobytes()
    for i, k in zip(odd.tolist(), owner.tolist(), strict=True):
        word = raw[starts[i] : ends[i]].decode("utf-8", "ignore").strip(".,;:?'\"()-[]{}*#%&")
        if _INNER.search(word):
            count[k] += 1
            words.append((k, re.sub(r"[^\w]|_", "", word.translate(UNDO))))
    return count, words


def features(col: pa.LargeStringArray, lexicon: Lexicon) -> np.ndarray:
    """A row for each text, by FEATURES."""
    fixed, you = _fixed_tables()
    learned = lexicon.table()
    out = np.zeros((len(col), len(FEATURES)))
    for i, j in runs_of(col):
        plain, at = buffer_of(col.slice(i, j - i))
        buf = LOWER[plain]
        starts, ends, first = find_words(buf, at, _WORD)
        pieces = _pieces(buf, starts, ends)
        n, chars = np.maximum(np.diff(first), 1), np.maximum(np.diff(at), 1)
        is_fixed, is_you = fixed.find(pieces[0]) >= 0, you.find(pieces[0]) >= 0
        weight = np.zeros(len(starts), np.float32)
        if learned.n:
            for h in pieces:
                k = learned.find(h)
                weight = np.maximum(weight, np.where(k >= 0, lexicon.weights[np.maximum(k, 0)], 0))
        hit = is_fixed | (weight > 0)
        near = hit & (_window(is_you, first, NEAR) > 0)
        odd, undone = _inner_symbols(buf, at)
        found = np.zeros(j - i)
        if undone:
            words, owner = pa.array([w for _, w in undone], pa.large_string()), np.array([k for k, _ in undone])
            wb, wa = buffer_of(words)
            wb = LOWER[wb]
            ok = np.diff(wa) > 0
            known = fixed.find(hash_spans(wb, wa[:-1], wa[1:])) >= 0
            if learned.n:
                for h in _pieces(wb, wa[:-1], wa[1:]):
                    known |= learned.find(h) >= 0
            np.add.at(found, owner[ok & known], 1)
        letters = np.maximum(_per_text(_LETTERS[buf], at), 1)
        best = np.zeros(j - i)
        densest = np.zeros(j - i)
        some = first[:-1] < first[1:]
        if some.any():
            begin = first[:-1][some]
            best[some] = np.maximum.reduceat(weight, begin)
            densest[some] = np.maximum.reduceat(_window(hit, first, STRETCH), begin)
        fixed_hits, hits = _per_text(is_fixed, first), _per_text(weight > 0, first)
        out[i:j] = np.column_stack([
            np.log(n), fixed_hits, fixed_hits / n, hits, hits / n, _per_text(weight, first) / n, best, densest,
            _per_text(near, first), _per_text(is_you, first) / n, _per_text(_UPPER[plain], at) / letters, _per_text(plain == 33, at) / chars,
            _per_text(_PUNCT[plain], at) / chars, _per_text(_SYMBOL[plain], at) / chars, _per_text(_DIGIT[plain], at) / chars, odd / n, found,
        ])
    return out


def _window(flag: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    """For each word, flags among the words at most k places off in the same text."""
    total = np.zeros(len(flag) + 1, np.int64)
    np.cumsum(flag, out=total[1:])
    place = np.arange(len(flag))
    sizes = np.diff(first)
    low, high = np.repeat(first[:-1], sizes), np.repeat(first[1:], sizes)
    return total[np.minimum(place + k + 1, high)] - total[np.maximum(place - k, low)]


# Trees


@dataclass
class Trees:
    """Boosted trees of one depth; node i has the children 2i+1 and 2i+2; leaves are the last level."""

    depth: int
    base: float
    feature: np.ndarray  # trees x inner nodes
    cut: np.ndarray
    leaf: np.ndarray  # trees x leaves

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, c, v in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, f[node]] > c[node])
            out += v[node - len(f)]
        return out


def boost(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 32, least: float = 4.0) -> Trees:
    """Logistic loss, second-order gains over quantile bins. A node that gains nothing sends all rows to the left."""
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)])
    share = min(max(y.mean(), 1e-3), 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    raw, inner = np.full(len(y), base), (1 << depth) - 1
    feature, cut, leaf = (np.zeros((trees, n)) for n in (inner, inner, inner + 1))
    for t in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            offset, width = (1 << level) - 1, 1 << level
            local = node - offset
            best, choice, place = np.zeros(width), np.zeros(width, np.int64), np.full(width, -1, np.int64)
            for f, c in enumerate(cuts):
                if not len(c):
                    continue
                key = local * (len(c) + 1) + binned[:, f]
                gs, hs = (np.bincount(key, v, width * (len(c) + 1)).reshape(width, -1) for v in (g, h))
                gl, hl = np.cumsum(gs, 1)[:, :-1], np.cumsum(hs, 1)[:, :-1]
                gt, ht = gs.sum(1, keepdims=True), hs.sum(1, keepdims=True)
                gain = np.where((hl >= least * 0.05) & (ht - hl >= least * 0.05), gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1), 0)
                k = gain.argmax(1)
                top = gain[np.arange(width), k]
                better = top > best + 1e-12
                best, choice, place = np.where(better, top, best), np.where(better, f, choice), np.where(better, k, place)
            for w in range(width):
                feature[t, offset + w] = choice[w]
                cut[t, offset + w] = cuts[choice[w]][place[w]] if place[w] >= 0 else np.inf
            f = choice[local]
            node = 2 * node + 1 + ((place[local] >= 0) & (binned[np.arange(len(y)), f] > place[local]))
        end = node - inner
        value = rate * np.bincount(end, g, inner + 1) / (np.bincount(end, h, inner + 1) + 1)
        leaf[t] = value
        raw += value[end]
    return Trees(depth, base, feature.astype(np.int64), cut, leaf)


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots (score, share), both ascending, for linear interpolation."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # sum, count, least and most score
    for s, v in zip(score[order].tolist(), y[order].tolist(), strict=True):
        blocks.append([v, 1, s, s])
        while len(blocks) > 1 and (blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1] or blocks[-2][3] == blocks[-1][2]):
            v_, n_, _, top = blocks.pop()
            blocks[-1] = [blocks[-1][0] + v_, blocks[-1][1] + n_, blocks[-1][2], top]
    knots = np.array([k for b in blocks for k in (b[2], b[3])])
    shares = np.array([b[0] / b[1] for b in blocks for _ in range(2)])
    return knots, shares


@dataclass
class Model:
    lexicon: Lexicon
    trees: Trees | None
    knots: np.ndarray
    shares: np.ndarray

    def score(self, col: pa.LargeStringArray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(col), float(self.shares[0]))
        raw = self.trees.raw(features(col, self.lexicon))
        return np.clip(np.interp(raw, self.knots, self.shares), 0.0, 1.0)


def fit(texts: list[str] | pa.LargeStringArray, toxic: list[int], folds: int = FOLDS) -> Model:
    """A model from texts and labels in memory (a bounded sample)."""
    y = np.array(toxic, bool)
    if not y.any() or y.all():
        return Model(Lexicon(), None, np.zeros(1), np.array([float(y.mean()) if len(y) else 0.0]))
    col = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
    fold = np.zeros(len(y), np.int64)
    for v in (False, True):  # both labels in each fold
        rows = np.flatnonzero(y == v)
        fold[rows] = np.arange(len(rows)) % folds
    x = np.zeros((len(y), len(FEATURES)))
    for k in range(folds):
        rest, own = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
        x[own] = features(col.take(pa.array(own)), learn_lexicon(col.take(pa.array(rest)), y[rest]))
    out = np.zeros(len(y))
    for k in range(folds):
        rest = fold != k
        out[~rest] = boost(x[rest], y[rest].astype(float)).raw(x[~rest])
    knots, shares = isotonic(out, y.astype(float))
    return Model(learn_lexicon(col, y), boost(x, y.astype(float)), knots, shares)


def _fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The model of a sample, which comes to one task, pickled; none of no rows."""
    held = [b for b in batches if b.num_rows]
    if held:
        got = pa.Table.from_batches(held).select(["_text", "_toxic"])
        held.clear()
        model = fit(texts_of(got.column("_text")), (got.column("_toxic").to_numpy() > 0).astype(int).tolist())
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])


def train(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> Model:
    """Learn from a bounded sample of labelled documents, those with the smallest hashes of their ids. A task of the executors learns; the model alone comes to the driver."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out())
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("_toxic"), F.xxhash64("doc_id").alias("_order"))
    chosen = known.orderBy("_order", "doc_id").limit(sample_docs)
    rows = docs.select("doc_id", F.col("text").alias("_text")).where(F.length("_text") <= sample_chars).join(F.broadcast(chosen), "doc_id")  # at most sample_docs rows
    one = rows.groupBy("_order", "doc_id").agg(F.min("_text").alias("_text"), F.max("_toxic").alias("_toxic"))  # of a repeated id one text comes to the sample
    found = one.repartition(1).sortWithinPartitions("_order", "doc_id").mapInArrow(_fitted, "model binary").collect()
    return pickle.loads(found[0].model) if found else fit([], [])


def scorer(spark: SparkSession, model: Model) -> Callable[[Column], Column]:
    """From a text column to its score. Only texts go to Python and only scores come back."""
    held = spark.sparkContext.broadcast(model)

    @F.arrow_udf(T.DoubleType())
    def toxicity(text: pa.Array) -> pa.Array:
        return pa.array(held.value.score(texts_of(text)), pa.float64())

    return toxicity


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The documents with `score` (replacing a column of that name), without a shuffle."""
    return docs.drop("score").withColumn("score", scorer(docs.sparkSession, model)(F.col(text)))


def keep_clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """Documents whose score is below the threshold, columns as they were."""
    return docs.where(scorer(docs.sparkSession, model)(F.col("text")) < threshold)
