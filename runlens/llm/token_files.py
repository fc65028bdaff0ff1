"""Token files: documents as ids of a public tokenizer, each compressed alone with one shared zstandard dictionary.

Format, a folder of two Parquet tables:
  dictionary  hash, data: one row, the dictionary that all frames need (no data if none could be trained)
  packs       a row for about PACK_BYTES of frames: shard (ascending in document order), pack (within the shard),
              first_token (tokens of the shard before it), tokens, dict_hash, doc_ids, n_tokens and frame_ends per
              document, blob: the frames. A document's frame lies between the ends of the one before and its own.
Ids are little-endian unsigned 16-bit integers if the vocabulary allows it, else 32-bit (`width`).

Spark's committer writes the folder, so lost executors cost a retry and any file system will do. Texts cross one range
shuffle; each task tokenizes, compresses and packs its range in order, holding one pack at a time.

Tokenizing: a text's ids are the ids of its pre-tokens in a row. Pre-tokens are found and hashed for a whole batch at
once; each worker asks the tokenizers library for every distinct pre-token it meets and keeps the answer, which is used
again only where the bytes agree.

Defined results: a null text counts as empty and holds the end id alone; repeated rows are written again; documents of
null id come first; ties of the order go by a hash of the text; an empty table gives an empty folder of packs.
"""

from __future__ import annotations

import hashlib
import os
import unicodedata
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.llm.spans import CLASH, WordTable, buffer_of, hash_spans, runs_of, texts_of

END_ID = 0
PACK_BYTES, PACK_DOCS = 1_000_000, 4096
SAMPLE_DOCS, SAMPLE_CHARS, DICTIONARY_BYTES = 400, 20_000, 32_768
CACHE = 520_000  # distinct pre-tokens a worker keeps; beyond that it starts anew

PACKS = "shard int, pack int, first_token bigint, tokens bigint, dict_hash string, width int, doc_ids array<bigint>, n_tokens array<bigint>, frame_ends array<bigint>, blob binary"

_LETTER, _NUMBER, _SPACE, _OTHER = 0, 1, 2, 3
_kinds: list[np.ndarray] = []
_SPECIAL_SPACE = {0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000}
_ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")  # fixed values: what may follow an apostrophe in a pre-token of its own


def _kind() -> np.ndarray:
    """The kind of each code point."""
    if not _kinds:
        kind = np.full(0x110000, _OTHER, np.uint8)
        for c in range(0x110000):
            k = unicodedata.category(chr(c))[0]
            if k == "L":
                kind[c] = _LETTER
            elif k == "N":
                kind[c] = _NUMBER
        kind[list(_SPECIAL_SPACE)] = _SPACE
        _kinds.append(kind)
    return _kinds[0]


def pre_tokens(points: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pre-tokens of texts laid end to end; at: where each text starts (one more than texts).

    Runs of letters, of numbers and of anything else but white space, each with the one blank before it; apostrophe
    endings apart; of white space before a word the last character stands alone unless it is that blank.
    """
    n = len(points)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = _kind()[points]
    change = np.empty(n, bool)
    change[0] = True
    change[1:] = kind[1:] != kind[:-1]
    change[at[:-1][at[:-1] < n]] = True
    starts = np.flatnonzero(change)
    ends = np.append(starts[1:], n)
    what = kind[starts]
    final = np.zeros(n + 1, bool)
    final[at[1:]] = True
    joined = ~final[ends]  # another run of the same text follows
    inner = np.flatnonzero((what == _SPACE) & joined)  # white space before something else
    tail = ends[inner] - 1
    blank = points[tail] == 32
    starts, ends = starts.copy(), ends.copy()
    led = np.zeros(len(starts), bool)
    led[inner[blank] + 1] = True
    starts[inner[blank] + 1] -= 1
    ends[inner] -= 1
    lone = tail[~blank]
    mark = np.flatnonzero((what[:-1] == _OTHER) & (what[1:] == _LETTER) & joined[:-1] & ~led[:-1] & (ends[:-1] - starts[:-1] == 1)) if len(starts) > 1 else np.zeros(0, np.int64)
    mark = mark[points[starts[mark]] == 39]
    for end in _ENDINGS:
        if not len(mark):
            break
        after = ends[mark]
        fits = ends[mark + 1] - after >= len(end)
        for i, c in enumerate(end):
            fits &= points[np.minimum(after + i, n - 1)] == ord(c)
        hit = mark[fits]
        ends[hit] += len(end)
        starts[hit + 1] += len(end)
        mark = mark[~fits]
    starts, ends = np.concatenate((starts, lone)), np.concatenate((ends, lone + 1))
    keep = ends > starts
    starts, ends = starts[keep], ends[keep]
    order = np.argsort(starts, kind="stable")
    return starts[order], ends[order]


class Encoder:
    """Ids of texts by a tokenizers file with byte-level pre-tokens."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; idle threads would spin
        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.width = 2 if self.library.get_vocab_size() <= 1 << 16 else 4
        self._forget()

    def _forget(self) -> None:
        self.words, self.flat, self.used = WordTable(), np.zeros(1 << 16, f"u{self.width}"), 0
        self.off, self.size = np.zeros(1 << 13, np.int32), np.zeros(1 << 13, np.int32)

    def _learn(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> None:
        raw = buf.tobytes()
        words = [raw[a:b].decode() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        ids = [e.ids for e in self.library.encode_batch_fast(words, add_special_tokens=False)]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes.sum()))
        n, m = self.words.n, self.words.n + len(words)
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        while m > len(self.off):
            self.off, self.size = (np.concatenate((x, np.zeros_like(x))) for x in (self.off, self.size))
        self.flat[self.used : self.used + len(flat)] = flat
        self.off[n:m], self.size[n:m] = self.used + np.cumsum(sizes) - sizes, sizes
        self.used += len(flat)
        self.words.add(buf, starts, ends, hashes)

    def _places(self, buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the pre-tokens, in bytes."""
        lead = (buf & 0xC0) != 0x80
        if lead.all() and (buf < 128).all():
            return pre_tokens(buf, at)
        byte = np.append(np.flatnonzero(lead), len(buf))  # of each character
        upto = np.zeros(len(buf) + 1, np.int64)
        np.cumsum(lead, out=upto[1:])
        starts, ends = pre_tokens(np.frombuffer(buf.tobytes().decode().encode("utf-32-le"), np.uint32), upto[at])
        return byte[starts], byte[ends]

    def _by_words(self, col: pa.LargeStringArray) -> tuple[list[np.ndarray], np.ndarray]:
        """Ids of each text, and the texts that hold a pre-token whose hash another one has: their ids are not to be used."""
        buf, at = buffer_of(col)
        starts, ends = self._places(buf, at)
        h = hash_spans(buf, starts, ends)
        k = self.words.find(buf, starts, ends, h)
        new = np.flatnonzero(k == -1)
        if len(new):
            if self.words.n + len(new) > CACHE:
                self._forget()
                new = np.arange(len(h))
            names, first = np.unique(h[new], return_index=True)
            spot = new[first]
            self._learn(buf, starts[spot], ends[spot], names)
            k[new] = self.words.find(buf, starts[new], ends[new], h[new])
        bad = np.unique(np.searchsorted(at, starts[k == CLASH], side="right") - 1)
        k = np.maximum(k, 0)
        sizes = self.size[k].astype(np.int64)
        upto = np.zeros(len(k) + 1, np.int64)
        np.cumsum(sizes, out=upto[1:])
        ids = self.flat[np.arange(upto[-1]) + np.repeat(self.off[k] - upto[:-1], sizes)].astype(np.uint32)
        cut = upto[np.searchsorted(starts, at)]
        return [ids[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)], bad

    def encode(self, col: pa.LargeStringArray) -> list[np.ndarray]:
        """Ids of each text. Texts that hold a special token's string go to the library whole."""
        out, bad = self._by_words(col)
        whole = set(bad.tolist())
        for s in self.special:
            whole |= set(np.flatnonzero(pc.match_substring(col, s).to_numpy(zero_copy_only=False)).tolist())
        for i, e in zip(whole, self.library.encode_batch([col[i].as_py() for i in whole], add_special_tokens=False), strict=True):
            out[i] = np.array(e.ids, np.uint32)
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per worker and file. The path must exist on every executor, as the tokenizers' package does."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _serial(ids: np.ndarray, width: int) -> bytes:
    return ids.astype(f"<u{width}").tobytes()


def train_dictionary(docs: DataFrame, tokenizer: str, docs_bound: int = SAMPLE_DOCS) -> bytes:
    """From a bounded sample (by a hash of id and text) of documents of at most SAMPLE_CHARS; empty if there is too little."""
    short = docs.where(F.length("text").between(1, SAMPLE_CHARS)).select("text", F.xxhash64("doc_id", "text").alias("h"))
    chosen = short.select("h").distinct().orderBy("h").limit(docs_bound)  # hashes alone first: tasks need not send texts that others beat
    rows = short.join(F.broadcast(chosen), "h").groupBy("h").agg(F.min("text").alias("text"))
    texts = [r["text"] for r in sorted(rows.collect(), key=lambda r: r["h"])]
    enc = encoder(tokenizer)
    samples = [_serial(x, enc.width) for x in enc.encode(pa.array(texts, pa.large_string()))] if texts else []
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, sum(map(len, samples)) // 8), samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


def write_tokens(docs: DataFrame, path: str, tokenizer: str, order_by: list[Column] | None = None, end_id: int = END_ID) -> None:
    """Write `docs` (doc_id, text) below `path` in ascending order of doc_id, or of the given columns."""
    spark = docs.sparkSession
    data = train_dictionary(docs, tokenizer)
    digest = hashlib.sha256(data).hexdigest()
    spark.createDataFrame([(digest, bytearray(data))], "hash string, data binary").coalesce(1).write.parquet(f"{path}/dictionary")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        press = zstandard.ZstdCompressor(level=3, dict_data=_dictionary(data), write_content_size=True)
        shard, n, before = TaskContext.get().partitionId(), 0, 0
        ids_, sizes, ends, blob = [], [], [], bytearray()

        def flush() -> pa.RecordBatch:
            row = {"shard": shard, "pack": n, "first_token": before, "tokens": sum(sizes), "dict_hash": digest, "width": enc.width, "doc_ids": ids_, "n_tokens": sizes, "frame_ends": ends, "blob": bytes(blob)}
            kinds = {"shard": pa.int32(), "pack": pa.int32(), "width": pa.int32(), "first_token": pa.int64(), "tokens": pa.int64(), "dict_hash": pa.string(), "blob": pa.binary()}
            return pa.RecordBatch.from_arrays([pa.array([v], kinds.get(k, pa.list_(pa.int64()))) for k, v in row.items()], list(row))

        for batch in batches:
            col, names = texts_of(batch.column("text")), batch.column("doc_id").to_pylist()
            for i, j in runs_of(col):
                for name, ids in zip(names[i:j], enc.encode(col.slice(i, j - i)), strict=True):
                    blob += press.compress(_serial(np.append(ids, np.uint32(end_id)), enc.width))
                    ids_.append(name)
                    sizes.append(len(ids) + 1)
                    ends.append(len(blob))
                    if len(blob) >= PACK_BYTES or len(ids_) >= PACK_DOCS:
                        yield flush()
                        n, before = n + 1, before + sum(sizes)
                        ids_, sizes, ends, blob = [], [], [], bytearray()
        if ids_:
            yield flush()

    keys = order_by or [F.col("doc_id")]
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", *(k.alias(f"_k{i}") for i, k in enumerate(keys)))
    names = [f"_k{i}" for i in range(len(keys))]
    ordered = rows.repartitionByRange(*names).sortWithinPartitions(*names, F.xxhash64("text"))
    ordered.select("doc_id", "text").mapInArrow(pack, PACKS).write.parquet(f"{path}/packs")


def dictionary_of(spark: SparkSession, path: str) -> tuple[str, bytes]:
    row = spark.read.parquet(f"{path}/dictionary").first()
    return row["hash"], bytes(row["data"])


def read_tokens(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """Per document: doc_id, start (ids of all documents before it), n_tokens, and ids or, with `digest`, ids_crc32.

    What the driver holds is one number per shard, that is per written partition.
    """
    digest_hash, data = dictionary_of(spark, path)
    packs = spark.read.parquet(f"{path}/packs")
    starts, total = {}, 0
    for r in packs.groupBy("shard").agg(F.sum("tokens").alias("n")).orderBy("shard").collect():
        starts[r["shard"]], total = total, total + r["n"]

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = zstandard.ZstdDecompressor(dict_data=_dictionary(data))
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i] for name in batch.schema.names}
                if row["dict_hash"].as_py() != digest_hash:
                    raise ValueError("a pack was written with another dictionary")
                sizes = row["n_tokens"].values.to_numpy()
                ends, blob = row["frame_ends"].values.to_numpy(), memoryview(row["blob"].as_buffer())
                begin = starts[row["shard"].as_py()] + row["first_token"].as_py() + np.cumsum(sizes) - sizes
                ids = [np.frombuffer(opened.decompress(blob[a:b]), f"<u{row['width'].as_py()}") for a, b in zip([0, *ends[:-1]], ends, strict=True)]
                last = pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()) if digest else pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))
                counts = pa.array([len(x) for x in ids], pa.int64())
                yield pa.RecordBatch.from_arrays([row["doc_ids"].values, pa.array(begin), counts, last], ["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"])

    columns = [c for c in packs.columns if c not in ("pack", "tokens")]
    return packs.select(*columns).mapInArrow(unpack, "doc_id bigint, start bigint, n_tokens bigint, " + ("ids_crc32 bigint" if digest else "ids array<int>"))


def find_document(spark: SparkSession, path: str, doc_id: int) -> list[int] | None:
    """The ids of one document: the index finds its pack and frame, and only that frame is decompressed."""
    _, data = dictionary_of(spark, path)
    place = F.array_position("doc_ids", F.lit(doc_id).cast("bigint")).cast("int")
    begin = F.when(place > 1, F.element_at("frame_ends", F.greatest(place - 1, F.lit(1)))).otherwise(F.lit(0))
    hit = spark.read.parquet(f"{path}/packs").where(F.array_contains("doc_ids", F.lit(doc_id).cast("bigint")))
    row = hit.select("width", F.substring("blob", (begin + 1).cast("int"), (F.element_at("frame_ends", place) - begin).cast("int")).alias("frame")).first()
    if row is None:
        return None
    return np.frombuffer(zstandard.ZstdDecompressor(dict_data=_dictionary(data)).decompress(bytes(row["frame"])), f"<u{row['width']}").tolist()
