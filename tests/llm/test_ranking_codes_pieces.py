"""Ranked search, vector codes and sentencepiece against brute-force versions and the library."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from runlens.llm import codes, pieces, queries, ranking, spans

SF = "/root/testdata/sf0.001"

# 11 ranked search

DOCS = "doc_id bigint, text string, term string, row string, w string"
ODD = [(1, None, "t", "r", "w"), (2, "", "t", "r", "w"), (3, " .. !!", "t", "r", "w"), (None, "red fox", "t", "r", "w"), (4, "Red fox; red HEN", "t", "r", "w"), (5, "red fox", "t", "r", "w"), (5, "red fox", "t", "r", "w"), (0, "fox red", "t", "r", "w"), (7, "größe ÄRGER größe", "t", "r", "w"), (8, "lorem ipsum " * 30_000 + "fox", "t", "r", "w"), (-3, "hen", "t", "r", "w")]
ITEMS = [(1, "The red fox", "t"), (2, None, "t"), (3, "", "t"), (4, "nothing known", "t"), (None, "red", "t"), (5, "hen hen HEN", "t"), (6, "Größe", "t"), (7, "red", "t"), (7, "hen", "t"), (8, "lorem red", "t")]


def terms(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def ranked(docs, items, k):
    have = [(d, Counter(terms(t))) for d, t in docs if d is not None and terms(t)]
    n, total = len(have), sum(sum(c.values()) for _, c in have)
    df = Counter(t for _, c in have for t in c)
    asked = defaultdict(set)
    for i, t in items:
        if i is not None:
            asked[i] |= set(terms(t))
    out = []
    for i, ts in asked.items():
        scores = []
        for d, c in have:
            m = 50 + 50 * sum(c.values()) * n // total
            scores.append((sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in ts if t in c), d))
        best = sorted((-s, d) for s, d in scores if s > 0)[:k]
        out += [(i, r, d, -s) for r, (s, d) in enumerate(best, 1)]
    return sorted(out)


@pytest.mark.parametrize(("postings", "block", "chars"), [(1_000_000, 32, 4_000_000), (3, 1, 12)])
def test_ranked_odd_rows(spark, monkeypatch, postings, block, chars):
    monkeypatch.setattr(ranking, "PACK_POSTINGS", postings)
    monkeypatch.setattr(ranking, "BLOCK", block)
    docs, items = spark.createDataFrame(ODD, DOCS).repartition(3), spark.createDataFrame(ITEMS, "item_id bigint, text string, doc_id string")
    for k in (1, 2, 50):
        got = [tuple(r) for r in ranking.search(docs, items, k, chars).collect()]
        assert sorted(got) == ranked([r[:2] for r in ODD], [r[:2] for r in ITEMS], k)
    assert ranking.search(docs.limit(0), items).count() == 0 and ranking.search(docs, items.limit(0)).count() == 0


def test_ranked_ties_and_many_packs(spark, monkeypatch):
    monkeypatch.setattr(ranking, "PACK_DOCS", 7)
    monkeypatch.setattr(ranking, "BLOCK", 2)
    r = random.Random(3)
    words = [f"w{i}" for i in range(12)]
    docs = [(i, " ".join(r.choice(words[: 1 + i % 12]) for _ in range(r.randint(1, 6)))) for i in range(400)] + [(1000 + i, "w0 w1") for i in range(60)]
    items = [(i, " ".join(r.sample(words, 3))) for i in range(20)]
    got = ranking.search(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(70), spark.createDataFrame(items, "item_id bigint, text string"), 10)
    assert sorted(tuple(x) for x in got.collect()) == ranked(docs, items, 10)


def test_threshold_stops_early():
    """A pack whose lists fall: the search ends long before their ends."""
    n = 20_000
    row = {"doc_ids": np.arange(n), "sizes": np.arange(1, n + 1) * 3, "holds": np.full(n, 2, np.int32), "terms": np.arange(2 * n) % 2, "tfs": np.ones(2 * n, np.int32)}
    pack = ranking.Pack(row, 2, n, int(row["sizes"].sum()))
    looked = []
    whole = pack.score
    pack.score = lambda docs, *a: looked.append(len(docs)) or whole(docs, *a)
    scores, ids = pack.search(np.array([0, 1]), np.array([5, 7]), 10, 0)
    full = whole(np.arange(n), np.array([0, 1]), np.array([5, 7]))
    best = np.lexsort((np.arange(n), -full))[:10]
    assert sorted(zip(-scores, ids)) == sorted(zip(-full[best], best)) and sum(looked) < n // 50


# 12 vector codes


def coded(rows, parts, entries, rounds, scale=4096):
    kept = sorted(((v is None, v), [math.floor(scale * x) for x in e], label) for v, e, label in rows)
    width = len(kept[0][1]) // parts if kept else 0
    cut = [[e[p * width : (p + 1) * width] for p in range(parts)] for _, e, _ in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            mine = defaultdict(list)
            for c in cut:
                mine[near(c[p], books[p])[1]].append(c[p])
            for i, xs in mine.items():
                books[p][i] = [sum(col) // len(xs) for col in zip(*xs)]
    out = []
    for ((_, v), _, label), c in zip(kept, cut):
        found = [near(c[p], books[p]) for p in range(parts)]
        out.append((v, label, "".join(f"{i:02x}" for _, i in found), sum(d for d, _ in found)))
    sums = Counter()
    for _, label, _, err in out:
        sums[label] += err
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((v, code, err, sums[label], sha) for v, label, code, err in out), key=repr)


def codes_of(df, **how):
    text = F.array_join(F.transform("code", lambda i: F.lpad(F.lower(F.hex(i)), 2, "0")), "")
    rows = codes.compress(df, **how).select("vec_id", text.alias("code"), "error", "label_error", "codebooks_sha256")
    return sorted((tuple(r) for r in rows.collect()), key=repr)


VECTORS = "vec_id bigint, embedding array<float>, label int, code string, _label int"


@pytest.mark.parametrize("labels", [codes.BROADCAST_LABELS, 0])
def test_codes_odd_rows(spark, monkeypatch, labels):
    monkeypatch.setattr(codes, "BROADCAST_LABELS", labels)
    r = random.Random(5)
    half = [0.25, -0.5, 1.0, 0.125]  # coarse values: many ties
    good = [(i, [r.choice(half) for _ in range(8)], r.choice([0, 1, None])) for i in range(60)] + [(7, [0.25] * 8, 1), (7, [0.25] * 8, 1), (None, [0.5] * 8, None)]
    bad = [(100, None, 1), (101, [], 1), (102, [0.5] * 7 + [None], 1), (103, [0.5] * 7 + [float("nan")], 1), (104, [0.5] * 7 + [float("inf")], 1), (105, [0.5] * 9, 1), (106, [0.5] * 16, 1), (107, [0.5] * 7 + [9000.0], 1)]
    df = spark.createDataFrame([(*x, "c", 1) for x in good + bad], VECTORS).repartition(3)
    assert codes_of(df, parts=4, entries=5, rounds=3) == coded(good, 4, 5, 3)
    assert codes_of(df.where("vec_id < 3"), parts=4, entries=5, rounds=2) == coded([g for g in good if g[0] is not None and g[0] < 3], 4, 5, 2)
    assert codes_of(df.limit(0)) == [] and codes_of(df.where("vec_id = 100")) == []


def test_codes_of_the_table(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet")
    got = sorted((tuple(r) for r in queries.op12_vector_codes(spark, SF).collect()), key=repr)
    assert got == coded([(r.vec_id, r.embedding, r.label) for r in rows.collect()], 8, 16, 6)


def test_entry_tree_against_plain_search():
    r = np.random.default_rng(1)
    for _ in range(50):
        entries = r.integers(-4, 5, (r.integers(1, 17), 3))  # repeated entries and equal distances
        x = r.integers(-6, 7, (200, 3))
        index, gap = codes.EntryTree(entries).nearest(x)
        plain = ((x[:, None] - entries[None]) ** 2).sum(2)
        assert (index == plain.argmin(1)).all() and (gap == plain.min(1)).all()


def test_codes_decode(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label")
    books = codes.fit(df, rounds=2)
    both = codes.decode(codes.encode(df, books), books).join(df.drop("label"), "vec_id")
    gap = F.aggregate(F.zip_with("embedding", "approx", lambda x, a: (F.floor(x.cast("double") * 4096) - a) ** 2), F.lit(0.0), lambda s, d: s + d)
    assert both.where(gap != F.col("error")).count() == 0 and both.count() == df.count()


# 13 sentencepiece


@pytest.fixture(scope="module")
def path():
    return queries.vocabulary("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library(path):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def same_as_library(texts, path, library):
    flat, at = pieces.encoder(path).encode(pa.array(texts, pa.large_string()))
    for i, text in enumerate(texts):
        ids = flat[at[i] : at[i + 1]].tolist()
        assert ids == library.encode(text), repr(text[:100])
        assert pieces.encoder(path).model.decode(ids) == library.decode(ids)


def test_pieces_blanks(path, library):
    """Runs of blanks merge by place, all their pieces having one score."""
    same_as_library([" " * k + end for k in range(130) for end in ("", "the", "\t", "▁x")], path, library)


def test_pieces_odd_texts(path, library):
    odd = ["", " ", "a▁b", "<s> </s> <unk> <0x41>", "\x00", "日本語の文章" * 200, "🙂" * 300, "x" * 5000, "ab" * 3000 + " ", "é" * 1000, "a\n\n\nb\t", "0123456789" * 50, "　x", "́"]
    same_as_library([*odd, "".join(odd) * 3], path, library)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from(" ▁abethings\n12é日")), max_size=60), max_size=4))
def test_pieces_any_text(texts):
    import sentencepiece

    path = queries.vocabulary("piece_bpe_32k.model")
    same_as_library(texts, path, sentencepiece.SentencePieceProcessor(model_file=path))


def test_last_piece_is_the_only_one_that_fits(path):
    """At each end of a character exactly one of the pieces that end there fits, and the plain merges end in it."""
    model, r = pieces.encoder(path).model, random.Random(2)
    some = [" " + "".join(r.choice(model.text[1:]) for _ in range(4)) for _ in range(60)] + [" " * 40]
    for text in some:
        raw = text.encode()
        last = model.table(np.frombuffer(raw, np.uint8), np.array([0]), np.array([len(raw)]))[0]
        for n in range(1, len(text) + 1):
            at = len(text[:n].encode())
            fit = [k for k in (p for p in range(1, len(model.text)) if text[:n].endswith(model.text[p])) if model.fits(max(last[at - model.size[k]], 0), k)]
            assert fit == [last[at]] and model.text[last[at]] == model.merge(text[:n])[-1]


def test_pieces_decode_any_ids(path, library):
    r = random.Random(4)
    model = pieces.encoder(path).model
    for top in (10, 259, library.get_piece_size()):
        for _ in range(800):
            ids = [r.randrange(top) for _ in range(r.randint(0, 8))]
            assert model.decode(ids) == library.decode(ids), ids


@pytest.mark.parametrize("kept", [pieces.KEPT, 3])
def test_pieces_that_share_a_hash(monkeypatch, path, library, kept):
    """With hashes of five bits and a memory of three stretches the bytes still decide."""
    monkeypatch.setattr(pieces, "hash_spans", lambda buf, a, b: spans.hash_spans(buf, a, b) & np.uint64(31))
    monkeypatch.setattr(pieces, "KEPT", kept)
    fresh = pieces.Encoder(pieces.encoder(path).model)
    texts = [f"word{i} other{i * 7} and the {i % 3}" for i in range(60)]
    for _ in range(2):
        flat, at = fresh.encode(pa.array(texts, pa.large_string()))
        assert [flat[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == library.encode(texts)


def test_pieces_long_stretches_by_both_ways(path, library):
    model = pieces.encoder(path).model
    for text in ["x" * 700, "inging" * 100, "日本" * 120, " " * 300]:
        raw = (" " + text).encode()
        assert model.ids_alone(raw) == model.ids_by_merges(raw) == library.encode(text)


def test_pieces_query_and_odd_rows(spark, path, library):
    got = {r.doc_id: tuple(r)[1:] for r in queries.op13_sentencepiece(spark, SF).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = library.encode(r.text or "")
        assert got[r.doc_id] == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)))
    odd = [(1, None, "i", "r"), (2, "", "i", "r"), (None, "a b", "i", "r"), (3, "a b", "i", "r"), (3, "a b", "i", "r"), (4, "lorem " * 100_000, "i", "r")]
    df = spark.createDataFrame(odd, "doc_id bigint, text string, ids string, row string")
    rows = pieces.encode(df, path).collect()
    assert sorted(((r.doc_id, r.row, r.ids) for r in rows), key=repr) == sorted(((d, "r", library.encode(t or "")) for d, t, _, _ in odd), key=repr)
    back = pieces.decode(pieces.encode(df, path), path)
    assert {(r.doc_id, r.text) for r in back.collect()} == {(d, t or "") for d, t, _, _ in odd}
    assert pieces.encode(df.limit(0), path).count() == 0 and pieces.decode(df.select(F.lit(None).cast("array<int>").alias("ids")), path).distinct().first().text == ""
