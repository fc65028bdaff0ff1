"""Each operator against a brute-force version, on small tables with nulls, empty and long texts, ties, repeats and odd columns."""

import hashlib
import math
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from runlens.llm import decontam, groups, jaccard, langid, lines, mixing, pages, queries, spans, token_counts, token_files, toxicity, vectors
from runlens.llm.components import components

SF = "/root/testdata/sf0.001"
LONG = "lorem ipsum dolor " * 20_000
DOCS = "doc_id bigint, text string, lang string, source string, row string, score string"
ODD = [(1, None, None, None, "r", "s"), (2, "", "en", "a", "r", "s"), (3, " \n\t ", "en", "a", "r", "s"), (None, "some words here now ok", "en", None, None, None), (4, LONG, "en", "b", "r", "s"), (5, "One two", "en", "b", "r", "s"), (5, "One two", "en", "b", "r", "s"), (6, "12 34 !!", "fr", "b", "r", "s")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def rows_of(df, *columns):
    return sorted(df.select(*columns).collect(), key=repr)


# 1 language


def test_language_held_out_accuracy(spark, docs):
    got = {r.doc_id: r for r in queries.op1_language_id(spark, SF).collect()}
    want = {r.doc_id: r.lang for r in docs.collect()}
    assert set(got) == set(want)
    held = [k for k in want if zlib.crc32(str(k).encode()) % 4 == 2]
    assert sorted(k for k, r in got.items() if r.held_out) == sorted(held)
    assert sum(got[k].lang_pred == want[k] for k in held) / len(held) > 0.9
    assert all(0 <= r.score <= 1 for r in got.values())


def test_language_odd_rows(odd):
    net = langid.train_network(["le la les une est dans " * 20, "the and of to in is " * 20], ["fr", "en"])
    got = langid.identify(odd, net).collect()
    assert len(got) == len(ODD) and got[0].row in ("r", None)
    assert {r.doc_id: r.lang_pred for r in got if r.doc_id in (1, 2, 3, 6)} == dict.fromkeys((1, 2, 3, 6), "und")
    assert {r.lang_pred for r in langid.identify(odd, None).collect()} == {"und"} and langid.identify(odd.limit(0), net).count() == 0
    assert langid.train(odd.limit(0)) is None


def test_language_whole_text():
    net = langid.train_network(["le la les une est dans " * 20, "the and of to in is " * 20], ["fr", "en"])
    names, _ = langid.Predictor(net).predict(pa.array(["the and " * 20 + "le la les une " * 400], pa.large_string()))
    assert names == ["fr"]


def test_language_learns_every_label(spark, monkeypatch):
    """Beyond LANGUAGES labels the sample of each shrinks, but none is left out, not even one that the share would miss."""
    rows = [(i, f"text number {i} of many", f"l{i % 50}") for i in range(4000)] + [(9000 + k, "the rarest of all", "z") for k in range(4)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    monkeypatch.setattr(langid, "train_network", lambda texts, langs: langs)
    monkeypatch.setattr(langid, "LANGUAGES", 5)
    for per_lang in (100, 1):
        got = Counter(langid.train(df, per_lang))
        assert set(got) == {r[2] for r in rows} and sum(got.values()) < 2 * max(5 * per_lang, 51)


# 2 lines


@pytest.mark.parametrize("held", [lines.HELD, 0])
def test_lines(spark, held):
    common, near = "Subscribe to our letter", "almost everywhere"
    rows = [(i, f"own {i}\n{common} \n\n{near if i < 4 else 'x'}", f"s{i}", "k") for i in range(8)] + [(8, None, "s0", "k"), (9, "", None, "k"), (None, common, None, "k"), (8, common, "s1", "k")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, h string")
    got = rows_of(lines.without_boilerplate(df, held=held), "doc_id", "text", "n_lines", "n_removed", "h")
    want = [(i, f"own {i}\n\n{near if i < 4 else 'x'}", 4, 1, "k") for i in range(8)] + [(8, None, 0, 0, "k"), (9, "", 1, 0, "k"), (None, "", 1, 1, "k"), (8, "", 1, 1, "k")]
    assert [tuple(r) for r in got] == sorted(want, key=lambda w: repr(df.sparkSession.createDataFrame([w], "doc_id bigint, text string, n_lines bigint, n_removed bigint, h string").first()))
    assert lines.without_boilerplate(df.limit(0), held=held).count() == 0


# 3 pages


def test_pages(spark):
    menu, foot = "<div>Home News Sport Weather Video Travel Culture More</div>", "<div>Copyright by the Example Company all rights reserved since 1999</div>"
    plain = [(i, "https://h.example/x", f"<html><body>{menu}<div><p>Unique {i} words that nobody {i} has</p></div>{foot}</body></html>") for i in range(40)]
    marked = "<html><nav>Menu</nav><header>Site</header><div class='ad'>Buy</div><article><h1>T &amp; U</h1><p>a  b&nbsp;c<br>d<script>x()</script><!-- no --></p><form>f</form><div class='comments'><article>no</article></div></article><aside>s</aside>" + menu
    rows = plain + [(100, None, None), (101, "odd", ""), (102, "https://h.example/y", marked), (102, "https://h.example/y", marked), (103, "https://z.example/", "<p>alone"), (104, "https://h.example/z", "<article></article>" + menu), (105, "https://h.example/l", "<article>" + "<p>w</p>" * 5000 + "</article>")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id bigint, url string, html string, host string")
    got = defaultdict(list)
    for r in pages.extract(df).collect():
        got[r.page_id].append(r.text)
    assert {k: v for k, v in got.items() if k < 40} == {i: [f"Unique {i} words that nobody {i} has"] for i in range(40)}
    assert got[102] == ["T & U\na b c\nd"] * 2 and got[100] == [""] and got[101] == [""] and got[103] == ["alone"] and got[105] == ["\n".join(["w"] * 5000)]
    assert pages.extract(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    "page,text",
    [("<div class='page with-sidebar'><article><p>Text</p></article></div>", "Text"), ("<article class='post comments-open'><p>Text</p></article>", "Text"),
     ("<article class='comment'><p>Text</p></article>", "Text"), ("<article><header><h1>Title</h1><p>by me</p></header><p>Text</p></article>", "Title\nText"),
     ("<header><h1>Site</h1></header><article>Text</article><div id='comments'><article>no</article></div>", "Text"), ("<main><article>Text</article><article class='comment'>no</article></main>", "Text"),
     ("<div class='with-sidebar'><p>Text</p><nav>no</nav></div>", "Text"), ("<div class='with-sidebar'><p>no</p></div><p>Text</p>", "Text"), ("<div class='sidebar'><main>Text<div class='share'>no</div></main></div>", "Text"),
     ("<article><section id='hidden-figures'><p>Text</p></section><p class='notice-board'>More</p><div class='site-notice'>no</div></article>", "Text\nMore"),
     ("<article><p title='the hidden id of a menu' data-id='comment-1'>Text</p><div class='post-header'><h1>Title</h1></div></article>", "Text\nTitle"),
     ("<article>Text<svg/> and <svg-icon></svg-icon>more<svg><text>no</text></svg><!--> too<a title=\"1 > 0\">!</a></article>", "Text and more too!"),
     ("<article>Text <script> stays<b x=\"1> here</article>", "Text stays here"), ("<article>1 < 2 <! and", "1 < 2 <! and"),
     ("<div class='sidebar' hidden><article>no</article></div>", ""), ("<article><div class='ad'><h2>no</h2></div>Text</article>", "Text")],
)
def test_pages_names_are_weak_evidence(spark, page, text):
    blocks = pages.blocks_of(page)
    got = pages.choose(blocks, np.zeros(0, np.int64))
    assert got == text


def test_pages_ask_the_host(spark):
    """Names that articles use too are furniture where the host repeats them; plain text outside an article stays where it is unique."""
    share = "Share this story with all of your friends on every network"
    page = lambda i: f"<div>{share} today</div><div>The lead of story {i} runs over ten words {i * i} here</div><article><p>Text {i}</p><div class='related'>Background of case {i} as told by {i * 3} people then</div><div class='share'>{share}</div><div class='login'><a href='/l'>Log in</a></div></article>"
    df = spark.createDataFrame([(i, "https://h.example/", page(i)) for i in range(20)] + [(50, "https://one.example/", page(50))], "page_id bigint, url string, html string")
    got = {r.page_id: r.text for r in pages.extract(df).collect()}
    inner = lambda i: f"Text {i}\nBackground of case {i} as told by {i * 3} people then"
    lead = lambda i: f"The lead of story {i} runs over ten words {i * i} here"
    alone = f"{share} today\n{lead(50)}\n{inner(50)}\n{share}"  # a host of one page repeats nothing
    assert got == {i: f"{lead(i)}\n{inner(i)}" for i in range(20)} | {50: alone}


def test_pages_names_are_held_against_the_host(spark):
    """A word of furniture beside another kind of word: unique it is text, repeated over the host it is none; the hosts differ in that alone."""
    same = "Readers of this paper can send us notes at any hour"
    page = lambda i, board: f"<article><p>Text {i}</p><p class='notice-board'>{board}</p></article>"
    own = lambda i: f"Meeting number {i} is held in hall {i * i} of block {i + 7} today"
    rows = [(i, "https://a.example/", page(i, own(i))) for i in range(12)] + [(100 + i, "https://b.example/", page(i, same)) for i in range(12)]
    got = {r.page_id: r.text for r in pages.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got == {i: f"Text {i}\n{own(i)}" for i in range(12)} | {100 + i: f"Text {i}" for i in range(12)}


@pytest.mark.parametrize(
    "page", ["<div>x" * 100_000, "<p><b>x" * 100_000, "<script>x" * 100_000, "<svg><math>x" * 50_000, "<!x <?y " * 50_000, "<a href='x\" " * 100_000 + ">", "<a \">\" " * 50_000 + "\"", "</div>x<ul>" * 100_000,
             "<div class='ad nav'>" * 50_000, "<article>" + "<li>x" * 100_000, "<!--" * 100_000, "<a " + "x=\"" * 100_000 + ">", "<a" + " " * 500_000 + ">x"],
)
def test_pages_broken_pages_take_linear_time(page):
    """A hundred thousand open elements, unclosed scripts, comments and quotes: about a second; quadratic work would take minutes."""
    begin = time.process_time()
    pages.blocks_of(page)
    assert time.process_time() - begin < 5


def test_pages_query_against_brute_force(spark, tmp_path):
    """The query on pages without any mark, of several hosts of several sizes: what is cut is told by nested loops over the raw paragraphs."""
    rng = np.random.default_rng(8)
    shared = [" ".join(f"s{k}w{j}" for j in range(int(rng.integers(3, 14)))) for k in range(10)]
    hosts = {"a": 1, "b": 2, "c": 9, "d": 30}
    rows, made = [], {}
    for host, n in hosts.items():
        for i in range(n):
            paragraphs = []
            for _ in range(5):
                own = " ".join(f"{host}{i}x{rng.integers(1000)}" for _ in range(int(rng.integers(0, 6))))
                part = shared[int(rng.integers(10))] if rng.random() < 0.6 else ""
                paragraphs.append(" ".join(x for x in (own, part) if x))
            page_id = len(rows)
            made[page_id] = (host, [p for p in paragraphs if p])
            rows.append((page_id, f"https://{host}.example/{i}", "".join(f"<p>{p}</p>" for p in paragraphs)))
    spark.createDataFrame(rows, "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: (r.text, r.n_chars) for r in queries.op3_html_extraction(spark, str(tmp_path)).collect()}
    streams = {i: [(w, b) for b, p in enumerate(ps) for w in p.split()] for i, (_, ps) in made.items()}
    runs = {i: [tuple(w for w, _ in s[k : k + 8]) for k in range(len(s) - 7)] for i, s in streams.items()}
    n_cut = 0
    for i, (host, ps) in made.items():
        mates = {tuple(w for w, _ in streams[j]) for j, (h, _) in made.items() if h == host}
        on = lambda run, mates=mates: sum(any(m[k : k + 8] == run for k in range(len(m) - 7)) for m in mates)
        common = [k for k, run in enumerate(runs[i]) if on(run) >= max(2, math.ceil(0.2 * len(mates)))]
        every, inner = set(), set()
        for k in common:
            every |= set(range(k, k + 8))
            if streams[i][k][1] == streams[i][k + 7][1]:
                inner |= set(range(k, k + 8))
        kept = []
        for b in range(len(ps)):
            own = [k for k, (_, of) in enumerate(streams[i]) if of == b]
            out = every if len(every & set(own)) >= 0.5 * len(own) else inner
            words = [streams[i][k][0] for k in own if k not in out]
            n_cut += len(words) < len(own)
            if words:
                kept.append(" ".join(words))
        text = "\n".join(kept or ps)
        assert got[i] == (text, len(text))
    assert n_cut > 10


def test_pages_host_counts_are_merged(spark):
    """A section's menu on 100 of a host's 1,000 pages goes, what is unique in its block stays, and so does what stands on too few pages."""
    menu, rare = "Local Council Roads Schools Parks Police Courts Weather Notices", "these nine words stand on only five pages here"
    middle = lambda i: f"{i} told by {i * 7} people {i}"
    body = lambda i: f"<p>{menu + ' ' if i % 10 == 0 else ''}{middle(i)}{' ' + rare if i < 5 else ''}</p>"
    df = spark.createDataFrame([(i, "https://big.example/x", body(i)) for i in range(1000)], "page_id bigint, url string, html string")
    got = {r.page_id: r.text for r in pages.extract(df).collect()}
    assert got == {i: middle(i) + (" " + rare if i < 5 else "") for i in range(1000)}


def test_pages_equal_streams_count_once(spark):
    """Two distinct pages however often they are repeated: their shared line goes, while equal pages keep theirs."""
    line = "one two three four five six seven eight nine"
    rows = [(i, "https://a.example/", f"<p>{line}</p><p>own {i % 2} x</p>") for i in range(100)] + [(i, "https://b.example/", f"<p>{line}</p>") for i in range(100, 200)]
    got = {r.page_id: r.text for r in pages.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got == {i: f"own {i % 2} x" if i < 100 else line for i in range(200)}


def test_pages_against_one_array(spark, monkeypatch):
    """Hosts in shards of three pages come out as with all pages of the host in one array."""
    rng = np.random.default_rng(5)
    parts = [" ".join(rng.choice(list("abcdefgh"), 10)) for _ in range(12)]
    rows = [(i, f"https://h{i % 3}.example/", "".join(f"<p>{parts[k]} u{i}</p>" for k in rng.integers(0, 12, 4)) + "<div>end</div>") for i in range(60)]
    monkeypatch.setattr(pages, "needed", lambda n: F.greatest(F.lit(2), F.ceil(pages.SUPPORT * n)).cast("bigint"))
    monkeypatch.setattr(pages, "SHARD_PAGES", 3)
    got = {r.page_id: r.text for r in pages.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    cut = 0
    for h in range(3):
        mine = {i: pages.blocks_of(page) for i, _, page in rows if i % 3 == h}
        tokens = {i: " ".join(t for _, t, _ in b).split() for i, b in mine.items()}
        stretches = {i: [tuple(t[k : k + 8]) for k in range(len(t) - 7)] for i, t in tokens.items()}
        on = Counter(x for i in mine for x in set(stretches[i]))
        for i, b in mine.items():
            begins = np.array([k for k, x in enumerate(stretches[i]) if on[x] >= max(2, math.ceil(0.2 * len(mine)))], np.int64)
            assert got[i] == pages.choose(b, begins)
            cut += len(begins) > 0
    assert cut > 10


def test_pages_of_the_tables(spark):
    want = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    import html

    for r in queries.op3_html_extraction(spark, SF).collect():
        inner = want[r.page_id].split("<article>")[1].split("</article>")[0]
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", "", p)).split()) for p in re.split("</?(?:p|h1|br)>", inner)]
        assert r.text == "\n".join(p for p in parts if p) and r.n_chars == len(r.text)


def test_suffix_array_against_brute_force():
    rng = np.random.default_rng(1)
    streams = [rng.integers(0, 4, n).astype(np.uint64) for n in (30, 40, 0, 5, 40, 12)]
    streams.append(streams[0])
    for long in (1, 3, 5, 8):
        distinct = list({s.tobytes(): s for s in streams}.values())
        least = max(2, math.ceil(0.5 * len(distinct)))
        seen = defaultdict(set)
        for k, s in enumerate(distinct):
            for i in range(len(s) - long + 1):
                seen[tuple(s[i : i + long])].add(k)
        for s, flag in zip(streams, pages.boilerplate(streams, long, 0.5), strict=True):
            want = np.zeros(len(s), bool)
            for i in range(len(s) - long + 1):
                if len(seen[tuple(s[i : i + long])]) >= least:
                    want[i : i + long] = True
            assert (flag == want).all()


# 4 toxicity


def test_toxicity_learns_and_scores():
    rng = np.random.default_rng(0)
    words = ["lamp", "river", "stone", "cloud", "paper", "green", "walk", "house"]
    text = lambda bad: " ".join([*rng.choice(words, 40), *(["you", "utter", "idiot", "moron"] if bad else [])])
    y = [i % 5 == 0 for i in range(300)]
    model = toxicity.fit([text(b) for b in y], [int(b) for b in y])
    test = [text(True), text(False), "y0u 1d10t and m0ron", "", LONG]
    score = model.score(pa.array(test, pa.large_string()))
    assert score[0] >= 0.3 and score[1] < 0.3 and ((0 <= score) & (score <= 1)).all()
    assert toxicity.fit([], []).score(pa.array(["x"], pa.large_string())).tolist() == [0.0]


def test_toxicity_learns_away_from_the_driver(spark, monkeypatch):
    """The texts of the sample stay on the executors; what comes back is the model that they give."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    known = labels.where("doc_id is not null and toxic is not null").where(~toxicity.held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.xxhash64("doc_id").alias("h"))
    rows = docs.where(F.length("text") <= toxicity.SAMPLE_CHARS).join(known, "doc_id").groupBy("h", "doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).orderBy("h", "doc_id").collect()
    want = toxicity.fit([r.text for r in rows], [r.toxic for r in rows])
    for name in ("fit", "features", "learn_lexicon"):
        monkeypatch.setattr(toxicity, name, None)
    got = toxicity.train(docs, labels)
    assert got.trees is not None and np.array_equal(got.lexicon.names, want.lexicon.names) and np.array_equal(got.knots, want.knots)
    assert all(np.array_equal(a, b) for a, b in zip((got.trees.feature, got.trees.cut, got.trees.leaf), (want.trees.feature, want.trees.cut, want.trees.leaf), strict=True))


def test_toxicity_odd_rows(spark, odd):
    model = toxicity.Model(toxicity.Lexicon(), None, np.zeros(1), np.array([0.2]))
    assert toxicity.score(odd, model).count() == len(ODD) and toxicity.score(odd, model).columns == ["doc_id", "text", "lang", "source", "row", "score"]
    assert rows_of(toxicity.keep_clean(odd, model), "*") == rows_of(odd, "*") and toxicity.keep_clean(odd, model, 0.1).count() == 0
    labels = spark.createDataFrame([(4, 1), (4, 0), (5, None), (None, 1)], "doc_id bigint, toxic int")
    assert toxicity.train(odd, labels).trees is None and toxicity.train(odd, labels.limit(0)).shares.tolist() == [0.0]


def test_isotonic_is_the_best_monotone_fit():
    s, y = np.array([1.0, 2, 2, 3, 4, 5]), np.array([0.0, 1, 0, 0, 1, 1])
    knots, shares = toxicity.isotonic(s, y)
    got = np.interp(s, knots, shares)
    assert np.allclose(got, [0, 1 / 3, 1 / 3, 1 / 3, 1, 1])


# 5 mixing


def test_mixing_stays_within_a_block(spark):
    rows = [(i, "a" if i % 10 < 6 else "b" if i % 10 < 9 else None, "k") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, key string")
    units = {"a": 50, "b": 3, None: 47}
    got = mixing.schedule(df, units, block=2).collect()
    assert len(got) == 3000 and all(r.release <= r.slot < r.deadline for r in got)
    slots = {r.slot: r.source for r in got}
    last = min(max(s for s, k in slots.items() if k == u) for u in units)
    done, total = dict.fromkeys(units, 0), sum(units.values())
    for t in range(last + 1):
        done[slots[t]] += 1
        assert all(abs(done[k] - units[k] * (t + 1) / total) < 1 for k in units)


def test_mixing_keeps_rows_and_order(spark, odd):
    out = mixing.mixed(odd)
    assert rows_of(out, "*") == rows_of(odd, "*") and out.columns == odd.columns
    assert mixing.schedule(odd.limit(0)).count() == 0


def test_mixing_beyond_the_broadcast(spark, docs, monkeypatch):
    want = sorted(map(tuple, mixing.schedule(docs.select("doc_id", "source")).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    monkeypatch.setattr(mixing, "BROADCAST_HEADS", 0)
    got = mixing.schedule(docs.select("doc_id", "source"))
    assert "ResolvedHint" not in (plan := got._jdf.queryExecution().analyzed().toString()) and "broadcast" not in plan and sorted(map(tuple, got.collect())) == want


def test_mixing_is_native(spark):
    plan = queries.op5_source_mixing(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# 6 token files


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.vocabulary("byte_bpe_50k.json"))


def test_token_files_round_trip(spark, odd, tokenizer, tmp_path):
    path = str(tmp_path / "t")
    token_files.write_tokens(odd, path, queries.vocabulary("byte_bpe_50k.json"))
    got = token_files.read_tokens(spark, path).collect()
    want = defaultdict(list)
    for k, text, *_ in ODD:
        want[k].append(tokenizer.encode(text or "", add_special_tokens=False).ids + [0])
    order = sorted(got, key=lambda r: r.start)
    assert [r.doc_id for r in order] == [None, 1, 2, 3, 4, 5, 5, 6]
    at = 0
    for r in order:
        assert r.start == at and r.n_tokens == len(r.ids) and list(r.ids) in want[r.doc_id]
        at += r.n_tokens
    assert token_files.find_document(spark, path, 6) == want[6][0] and token_files.find_document(spark, path, 99) is None


def test_encoder_is_the_library(tokenizer):
    texts = ["It's they'll we've I'd 'tis ''s", "a  b   c \n\n d\t\te ", " lead", "x<|endoftext|>y", "é ñ 日本語 12ab34", "  a", "  z 's", "don't DON'T", "", "🙂🙂 ok", "a\r\nb"]
    got = token_files.encoder(queries.vocabulary("byte_bpe_50k.json")).encode(pa.array(texts, pa.large_string()))
    assert [x.tolist() for x in got] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_token_file_query(spark, docs, tokenizer):
    got = {r.doc_id: r for r in queries.op6_token_files(spark, SF).collect()}
    at = 0
    for r in docs.orderBy("doc_id").collect():
        ids = np.array(tokenizer.encode(r.text, add_special_tokens=False).ids + [0], "<u4")
        assert (got[r.doc_id].start, got[r.doc_id].n_tokens, got[r.doc_id].ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


# 7 decontamination


def contaminated(text, items, window=13):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w, hit, found = words(text), set(), set()
    for name, item in items:
        x = words(item)
        n = min(window, len(x))
        grams = {tuple(x[i : i + n]) for i in range(len(x) - n + 1)} if n else set()
        for i in range(len(w) - n + 1):
            if n and tuple(w[i : i + n]) in grams:
                hit |= set(range(i, i + n))
                found.add(str(name))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("shard", [decontam.SHARD_CHARS, 200])
def test_decontamination(spark, shard):
    rng = np.random.default_rng(3)
    word = lambda n: " ".join(rng.choice(list("abcdef"), n))
    items = [(i, word(n)) for i, n in enumerate((40, 20, 13, 5, 3, 30))] + [(9, None), (10, ""), (11, "Été à Zoë, l'art 12")]
    texts = [word(200), items[0][1] + " x " + word(30), "X " + items[2][1].upper() + "! y", items[3][1], None, "", "été,À zoë L'ART 12", word(5000), "z " * 50 + items[1][1]]
    df = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id bigint, text string, state string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, list(r["items"])) for r in decontam.measure(df, bench, shard_chars=shard).collect()}
    want = {i: contaminated(t, items) for i, t in enumerate(texts)}
    assert got == want
    kept = {r.doc_id for r in decontam.decontaminate(df, bench, shard_chars=shard).collect()}
    assert kept == {i for i, (n, h, _) in want.items() if not (h and 20 * h >= n)}
    assert decontam.measure(df, bench.limit(0)).agg(F.sum("n_hit")).first()[0] == 0 and decontam.measure(df.limit(0), bench).count() == 0


@pytest.mark.parametrize("most", [decontam.FILTER_BYTES, 256])
def test_decontamination_in_shards_writes_only_what_may_be_hit(spark, monkeypatch, most):
    """A benchmark of many shards: documents without a window are never written, and a filter that is full changes no row."""
    rng = np.random.default_rng(12)
    word = lambda n: " ".join(f"w{k}" for k in rng.integers(0, 3000, n))
    items = [(i, word(int(rng.integers(4, 60)))) for i in range(120)] + [(7, word(20)), (None, word(20)), (200, None), (201, "")]
    texts = [word(int(rng.integers(0, 120))) + (" " + items[int(rng.integers(120))][1] if i % 10 == 0 else "") + " " + word(30) for i in range(200)] + [None, "", items[3][1], items[3][1]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    written, keep = [], decontam.materialise
    monkeypatch.setattr(decontam, "materialise", lambda spark, df: written.append(keep(spark, df)) or written[-1])
    sizes, drop = [], decontam.discard
    monkeypatch.setattr(decontam, "discard", lambda *tables: sizes.extend(t.count() for t in tables) or drop(*tables))
    full = most < decontam.FILTER_BYTES
    monkeypatch.setattr(decontam, "FILTER_BYTES", most)
    got = {r.doc_id: (r.n_words, r.n_hit, list(r["items"])) for r in decontam.measure(df, bench, shard_chars=1500).collect()}
    want = {i: contaminated(t, [x for x in items if x[0] is not None]) for i, t in enumerate(texts)}
    assert got == want and sum(h > 0 for _, h, _ in want.values()) >= 22
    assert len(written) >= 8 and len(sizes) == len(written) - 1
    if not full:
        assert set(sizes) == {sum(h > 0 for _, h, _ in want.values())}


def test_window_filter_knows_every_window():
    rng = np.random.default_rng(4)
    items = [" ".join(rng.choice(list("abcdefgh"), int(n))) for n in rng.integers(0, 30, 50)]
    sieve = decontam.WindowFilter(sum(map(len, items)))
    sieve.add(items[:20])
    sieve.add(items[20:])
    words = [t.split() for t in items]
    for texts in ([t for t in items if t], [" ".join(["x", *w[2 : 2 + 13], "y"]) for w in words if len(w) >= 15]):
        buf, at = spans.buffer_of(pa.array(texts, pa.large_string()))
        starts, ends, first = spans.find_words(buf, at, decontam.WORD)
        assert sieve.has(spans.hash_spans(buf, starts, ends, 0), first).all()
    far = [" ".join(rng.choice(list("uvwxyz"), 40)) for _ in range(200)]
    buf, at = spans.buffer_of(pa.array(["", *far], pa.large_string()))
    starts, ends, first = spans.find_words(buf, at, decontam.WORD)
    assert sieve.has(spans.hash_spans(buf, starts, ends, 0), first).sum() <= 2


# 8 Jaccard


def linked(rows, share=85):
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    sets = []
    for _, t in rows:
        w = words(t)
        sets.append(frozenset(zip(*(w[k:] for k in range(4)), strict=False)) if len(w) >= 4 else frozenset([tuple(w)] if w else []))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= share * len(a | sets[j]):
                root[find(i)] = find(j)
    least = defaultdict(lambda: None)
    for i, (k, _) in enumerate(rows):
        if k is not None and (least[find(i)] is None or k < least[find(i)]):
            least[find(i)] = k
    return [(k, len(s), (least[find(i)] if s else k)) for i, ((k, _), s) in enumerate(zip(rows, sets, strict=True))]


def near_copies(rng):
    vocab = [f"w{i}" for i in range(500)]
    texts = []
    for size in (4, 7, 20, 60, 150, 400):
        base = list(rng.choice(vocab, size))
        for edits in (0, 0, 1, 1, 1, 2, 2, 3, 5):
            t = list(base)
            for _ in range(edits):
                t[rng.integers(len(t))] = str(rng.choice(vocab))
            texts.append(" ".join(t))
        texts.append(" ".join(base[: int(size * 0.9)]))
    passage = " ".join(rng.choice(vocab, 50))
    texts += [passage + " " + " ".join(rng.choice(vocab, n)) for n in (5, 6, 40, 50, 60, 100)]
    return texts


@pytest.mark.parametrize("block", [jaccard.BLOCK, 3])
def test_jaccard(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    texts = near_copies(np.random.default_rng(block)) + [None, "", " \n", "Only THREE words", "only three Words", "é É ñ x", "É é ñ x", LONG]
    rows = [(i * 7 % 1009, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(k, t, "z") for k, t in rows], "doc_id bigint, text string, fp string")
    got = sorted(tuple(r) for r in jaccard.link(df).collect())
    assert got == sorted(linked(rows))
    assert len({c for _, _, c in got}) < len(rows) - 20


def test_jaccard_odd_rows(spark, odd):
    got = sorted((tuple(r) for r in jaccard.link(odd).collect()), key=repr)
    assert got == sorted([(1, 0, 1), (2, 0, 2), (3, 0, 3), (None, 2, None), (4, 3, 4), (5, 1, 5), (5, 1, 5), (6, 1, 6)], key=repr)
    assert sorted((r.doc_id for r in jaccard.keep_one(odd).collect()), key=repr) == sorted([1, 2, 3, None, 4, 5, 6], key=repr)
    assert jaccard.link(odd.limit(0)).count() == 0 and jaccard.keep_one(odd.limit(0)).count() == 0


def test_jaccard_keeps_texts_of_their_own(spark):
    """Id 7 stands on a copy of row 1 and on a text that has no copy: only the copy goes."""
    copy, own, other = "a b c d e f g h i j", "k l m n o p q r s t", "u v w x y z aa bb cc dd"
    rows = [(1, copy, "p"), (7, copy, "q"), (7, own, "r"), (7, own, "r"), (8, other, "s"), (9, other, "t"), (9, "", "u"), (None, own, "v")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, extra string")
    got = sorted((tuple(r) for r in jaccard.keep_one(df).collect()), key=repr)
    assert got == sorted([(1, copy, "p"), (7, own, "r"), (8, other, "s"), (9, "", "u"), (None, own, "v")], key=repr)


def test_bounds_hold():
    rng = np.random.default_rng(5)
    for n in (3, 200, 900, 3000, 20_000):
        a = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
        b = np.unique(np.concatenate((a[: n // 2], rng.integers(0, 1 << 62, n // 3 + 1).astype(np.uint64))))
        (ma, x), (mb, y) = jaccard.unpack(jaccard.pack(a)), jaccard.unpack(jaccard.pack(b))
        g = min(len(x), len(y))
        assert int(np.minimum(jaccard.fold(x, g), jaccard.fold(y, g)).sum(dtype=np.int64)) + min(ma, mb) >= len(np.intersect1d(a, b))


def test_components(spark):
    rng = np.random.default_rng(2)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(k, k + 1) for k in range(1000, 1060)] + [(5, 5), (7, None)]
    got = {r.node: r.root for r in components(spark, spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    root = {x: x for e in links if None not in e and e[0] != e[1] for x in e}
    for _ in range(100):
        for a, b in links:
            if b is not None and a != b:
                root[a] = root[b] = min(root[a], root[b])
    assert set(got) == set(root)
    pairs = lambda m: {frozenset(k for k in m if m[k] == v) for v in set(m.values())}
    assert pairs(got) == pairs(root)
    assert components(spark, spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# 9 token counts


def test_token_counts(spark, odd, docs):
    path = queries.vocabulary("piece_bpe_32k.model")
    c = token_counts.counter(path)
    brute = lambda t: sum(token_counts.count_one(b" " + w, c.pieces, c.longest) for w in re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()))
    got = [(r.text, r.n_tokens, r.n_pre_tokens) for r in token_counts.count_tokens(odd, path).collect()]
    assert all(n == brute(t) and k == len((t or "").split()) for t, n, k in got) and len(got) == len(ODD)
    some = docs.limit(40).unionByName(docs.limit(1).withColumn("text", F.lit("é日本" * 60 + " " + "x" * 5000 + " ünïcödé")))
    assert all(r.n_tokens == brute(r.text) for r in token_counts.count_tokens(some, path).collect())
    assert token_counts.count_tokens(odd.limit(0), path).count() == 0


# 10 top-k


def test_top_k(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(0, 1, (700, 12))
    v[300:420] = v[300]  # ties
    rows = [(int(i), [float(x) for x in v[i]], 1) for i in range(700)] + [(800, None, 1), (900, [1.0, None] * 6, 1), (1000, [math.nan] * 12, 1), (1100, [math.inf] + [0.0] * 11, 1), (None, [1.0] * 12, 1), (1200, [], 1), (1300, [1.0, 2.0], 1), (1301, [3.0, 1.0], 1), (200, [float(x) for x in v[200]], 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, q int").repartition(5)
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in vectors.search(df).collect())
    whole = [(i, [math.floor(1024 * x) for x in e]) for i, e, _ in rows if i is not None and e and all(x is not None and math.isfinite(x) for x in e)]
    want = []
    for q, e in {(i, tuple(e)) for i, e in whole if i % 100 == 0}:
        found = sorted((-sum(a * b for a, b in zip(e, x, strict=True)), i) for i, x in whole if i != q and len(x) == len(e))[:10]
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found)]
    assert got == sorted(want)
    assert vectors.search(df.limit(0)).count() == 0


def test_large_components_stay_exact():
    q = np.array([[2.0**40, -(2.0**41)]])
    assert vectors.products(q, np.array([[3.0, 5.0]])).tolist() == [[3 * 2**40 - 5 * 2**41]]
    assert vectors.products(np.array([[2.0**60, 2.0**60]]), np.array([[2.0**10, 2.0**10]])).tolist() == [[(1 << 63) - 1]]


# shared


def test_groups_and_spans():
    b = [pa.RecordBatch.from_pydict({"k": k, "v": v}) for k, v in (([1, 1, 2], [1, 2, 3]), ([2, 2], [4, 5]), ([], []), ([3], [6]))]
    b[2] = pa.RecordBatch.from_arrays([pa.array([], pa.int64()), pa.array([], pa.int64())], ["k", "v"])
    assert [t.column("v").to_pylist() for t in groups.runs_by(iter(b), ["k"])] == [[1, 2], [3, 4, 5], [6]]
    col = pa.array(["ab cd", "", None, "e"], pa.large_string())
    buf, at = spans.buffer_of(spans.texts_of(col))
    starts, ends, first = spans.find_words(buf, at, spans.byte_class(outside=" "))
    assert [bytes(buf[a:b]) for a, b in zip(starts, ends, strict=True)] == [b"ab", b"cd", b"e"] and first.tolist() == [0, 2, 2, 2, 3]


def test_digest_of_items(spark):
    got = queries.op7_benchmark_decontamination(spark, SF).where("n_items = 0").first()
    assert got.items_sha256 == hashlib.sha256(b"").hexdigest()


# words that weak hashes mix up, and hashes that two words share


def thue_morse(n):
    t = [0]
    while len(t) < n:
        t += [1 - x for x in t]
    return "".join("ab"[x] for x in t[:n])


@pytest.mark.parametrize("n", [1024, 4096])
def test_words_are_told_by_their_bytes(spark, tokenizer, n):
    s = thue_morse(n)
    t = s.translate(str.maketrans("ab", "ba"))
    rows = [(1, s), (2, t), (3, f"{s} {t} {s}"), (4, f"{t} {t} {s}"), (5, s)]
    texts = [x for _, x in rows]
    col = pa.array(texts, pa.large_string())
    got = token_files.encoder(queries.vocabulary("byte_bpe_50k.json")).encode(col)
    assert [x.tolist() for x in got] == [tokenizer.encode(x, add_special_tokens=False).ids for x in texts]
    c = token_counts.counter(queries.vocabulary("piece_bpe_32k.model"))
    assert c.count(col)[0].tolist() == [sum(unigram_tokens(w, c.pieces) for w in x.split()) for x in texts]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    hit = {r.doc_id: r.n_hit for r in decontam.measure(df, spark.createDataFrame([(1, s)], "item_id bigint, text string")).collect()}
    assert hit == {1: 1, 2: 0, 3: 2, 4: 1, 5: 1}
    assert sorted(tuple(r) for r in jaccard.link(df).collect()) == sorted(linked(rows))


def test_words_that_share_a_hash(monkeypatch, tokenizer):
    """With hashes of eight bits most words of over eight bytes clash - shorter ones of one size cannot - and results stay right."""
    whole = spans.hash_spans
    narrow = lambda buf, a, b, seed=0: whole(buf, a, b, seed) & np.uint64(255 if seed < 3 else (1 << 64) - 1)
    for m in (token_files, token_counts, decontam):
        monkeypatch.setattr(m, "hash_spans", narrow)
    rng = np.random.default_rng(7)
    words = ["".join(rng.choice(list("abcdefghijklmnop"), k)) for k in rng.integers(9, 30, 900)]
    texts = [" ".join(rng.choice(words, 60)) for _ in range(30)]
    col = pa.array(texts, pa.large_string())
    got = token_files.Encoder(queries.vocabulary("byte_bpe_50k.json")).encode(col)
    assert [x.tolist() for x in got] == [tokenizer.encode(x, add_special_tokens=False).ids for x in texts]
    c = token_counts.Counter(queries.vocabulary("piece_bpe_32k.model"))
    assert c.count(col)[0].tolist() == [sum(unigram_tokens(w, c.pieces) for w in x.split()) for x in texts]
    auto = decontam.Automaton([("1", texts[0]), ("2", texts[1])])
    assert auto.seed == 3 and auto.vocab.n == len({w for x in texts[:2] for w in x.split()})


def test_word_table():
    table = spans.WordTable()
    col = pa.array(["ab abcdefghij abcdefghik " + "x" * 300], pa.large_string())
    buf, at = spans.buffer_of(col)
    starts, ends, _ = spans.find_words(buf, at, spans.byte_class(outside=" "))
    h = spans.hash_spans(buf, starts, ends)
    table.add(buf, starts[[0, 1, 3]], ends[[0, 1, 3]], h[[0, 1, 3]])
    assert table.find(buf, starts, ends, h).tolist() == [0, 1, -1, 2]
    other = np.array([h[0], h[1], h[1], h[0]])
    assert table.find(buf, starts, ends, other).tolist() == [0, 1, spans.CLASH, spans.CLASH]


def test_jaccard_names_that_begin_alike(spark, monkeypatch):
    """Digests of which one byte names the set: those that clash are named anew."""
    monkeypatch.setattr(jaccard, "NAME_BYTES", 1)
    rng = np.random.default_rng(9)
    rows = [(i, " ".join(rng.choice(list("abcdefghij"), 12))) for i in range(60)]
    rows += [(100 + i, t) for i, t in rows[:20]]
    assert sorted(tuple(r) for r in jaccard.link(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()) == sorted(linked(rows))


def test_groups_of_members_across_rows(monkeypatch):
    """Members of a key fall into rows of MEMBERS at most, keys of equal members into one part; nothing is lost at the edges of batches."""
    monkeypatch.setattr(jaccard, "MEMBERS", 4)
    keys = {5: [1, 2], 6: [3], 7: [1, 2], 8: list(range(10, 31)), 9: [40], 10: [41, 42, 43], 11: [50, 51], 12: [7]}
    flat = [(h, fp) for h, fps in keys.items() for fp in fps for _ in range(1 + fp % 2)]
    for size in (1, 3, 7, 100):
        batches = [pa.RecordBatch.from_pydict({"h": [h for h, _ in flat[i : i + size]], "fp": [f for _, f in flat[i : i + size]]}) for i in range(0, len(flat), size)]
        parts = defaultdict(set)
        for b in jaccard._groups(iter(batches)):
            for part, members in zip(b.column("part").to_pylist(), b.column("members").to_pylist(), strict=True):
                assert len(members) <= 4
                parts[part] |= set(members)
        got = {frozenset(m) for m in parts.values()}
        assert {frozenset(keys[h]) for h in (5, 7, 8, 10, 11)} <= got and all(len(m) > 1 or m in ({1}, {2}, {7}, {40}) for m in got)


# queries against independent versions


def unigram_tokens(word, pieces, unknown=-25.0):
    """Tokens of the best segmentation of a word with its blank, from the end of each prefix on; ties go to the longer last piece."""
    w = b" " + word.encode()
    score, tokens = {0: 0.0}, {0: 0}
    for end in range(1, len(w) + 1):
        options = [(score[begin] + pieces[w[begin:end]], begin) for begin in range(end) if w[begin:end] in pieces]
        options.append((score[end - 1] + unknown, end - 1))
        top = max(s for s, _ in options)
        begin = min(b for s, b in options if s == top)
        score[end], tokens[end] = top, tokens[begin] + 1
    return tokens[len(w)]


def test_token_count_query(spark, docs):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=queries.vocabulary("piece_bpe_32k.model"))
    plain = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    pieces = {p.replace("▁", " ").encode(): -math.log(rank + 2) for rank, p in enumerate(plain)}
    known = {}
    count = lambda w: known.get(w) or known.setdefault(w, unigram_tokens(w, pieces))
    want = {r.doc_id: sum(count(w) for w in re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in docs.collect()}
    assert {r.doc_id: r.n_tokens for r in queries.op9_token_counts(spark, SF).collect()} == want


def test_toxicity_query_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in queries.op4_toxicity(spark, sf).collect()}
    labels = defaultdict(int)
    for r in spark.read.parquet(f"{sf}/labels.parquet").where("toxic is not null").collect():
        labels[r.doc_id] = max(labels[r.doc_id], r.toxic)
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    held = [k for k in labels if k in got and zlib.crc32(str(k).encode()) % 4 == 2]
    assert all(got[k].held_out for k in held)
    toxic, clean = ([got[k].predicted for k in held if labels[k] == v] for v in (1, 0))
    assert sum(toxic) >= 0.9 * len(toxic) > 50 and sum(clean) <= 0.01 * len(clean)


def test_network_against_plain_convolution():
    net = langid.train_network(["le la les une est dans " * 20, "the and of to in is " * 20], ["fr", "en"])
    rng = np.random.default_rng(2)
    x = rng.integers(0, langid.CLASSES, (5, langid.WINDOW))
    want = []
    for row in x:
        pooled = [max(sum(f[k, row[p + k], j] for k in range(w)) for p in range(len(row) - w + 1)) for w, f in zip(langid.WIDTHS, net.filters, strict=True) for j in range(langid.FILTERS)]
        z = np.maximum(np.array(pooled) + net.bias, 0) @ net.top + net.top_bias
        want.append(np.exp(z - z.max()) / np.exp(z - z.max()).sum())
    assert np.allclose(langid.Predictor(net)._windows(x), want, atol=1e-4)


def test_clashing_columns(spark, monkeypatch):
    """Whatever operators call their own columns, those of the table come back as they were."""
    extra = ["_key", "_row", "row", "key", "h", "fp", "state", "rank", "turn", "file", "kept", "id", "tie", "order", "_drop", "_t", "count", "_n", "_least"]
    rows = [(i, f"line one of {i}\nshared line here\nlast {i % 3}", "en", f"s{i % 6}", *("KEEP" for _ in extra)) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, " + ", ".join(f"{c} string" for c in extra))
    monkeypatch.setattr(langid, "train_network", lambda texts, langs: (len(texts), len(set(texts))))
    n, distinct = langid.train(df.unionByName(df))
    assert n == distinct > 0  # repeated rows are learned from once
    model = toxicity.Model(toxicity.Lexicon(), None, np.zeros(1), np.array([0.2]))
    bench = spark.createDataFrame([(1, "nothing of the kind")], "item_id bigint, text string")
    outs = {
        "op1": langid.identify(df, None), "op2": lines.without_boilerplate(df), "op2 joined": lines.without_boilerplate(df, held=0), "op4": toxicity.score(df, model), "op4 keeps": toxicity.keep_clean(df, model),
        "op5": mixing.schedule(df), "op5 mixed": mixing.mixed(df), "op7": decontam.decontaminate(df, bench), "op8": jaccard.keep_one(df), "op9": token_counts.count_tokens(df, queries.vocabulary("piece_bpe_32k.model")),
    }
    for name, out in outs.items():
        got = out.select("doc_id", *extra).collect()
        assert got and all(set(r[1:]) == {"KEEP"} for r in got), name
    pages_df = df.select(F.col("doc_id").alias("page_id"), F.lit("https://a.example/").alias("url"), F.col("text").alias("html"), *extra)
    vecs = df.select(F.col("doc_id").alias("vec_id"), F.array(F.col("doc_id").cast("double"), F.lit(1.0)).alias("embedding"), *extra)
    assert pages.extract(pages_df).count() == 12 and vectors.search(vecs).count() == 10


def test_a_text_of_tens_of_megabytes(tokenizer):
    unit = " lorem ipsum dolor"
    n = 30_000_000 // len(unit)
    col = pa.array([unit * n], pa.large_string())
    names, score = langid.Predictor(langid.train_network([unit * 30, "the and of to in is " * 20], ["la", "en"])).predict(col)
    assert names == ["la"] and 0 < score[0] <= 1
    ids = token_files.encoder(queries.vocabulary("byte_bpe_50k.json")).encode(col)[0]
    assert (ids == np.tile(np.array(tokenizer.encode(unit, add_special_tokens=False).ids, np.uint32), n)).all()
    tokens, words = token_counts.counter(queries.vocabulary("piece_bpe_32k.model")).count(col)
    one, _ = token_counts.counter(queries.vocabulary("piece_bpe_32k.model")).count(pa.array([unit], pa.large_string()))
    assert (tokens[0], words[0]) == (one[0] * n, 3 * n)
    key, at = jaccard.sets_of(col, 4)
    assert at.tolist() == [0, 3]
    assert toxicity.features(col, toxicity.Lexicon()).shape == (1, len(toxicity.FEATURES))


def test_near_copies_cost_pairs_in_proportion(spark, monkeypatch):
    """A group of near copies stands in dozens of parts; the pairs that are looked for do not grow with their number, and all links are found."""
    rng = np.random.default_rng(13)
    base, rows = [f"w{i}" for i in range(150)], []
    for k in range(300):
        t = list(base)
        for place in rng.choice(150, 1 + k % 3, replace=False):
            t[place] = f"x{rng.integers(1 << 30)}"
        rows.append((k, " ".join(t)))
    made, write = [], jaccard.materialise

    def counted(session, df):
        out = write(session, df)
        if df.columns == ["a", "b", "cut"]:
            made.append(out.where("a is not null").count())
        return out

    monkeypatch.setattr(jaccard, "materialise", counted)
    got = sorted(tuple(r) for r in jaccard.link(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    assert got == sorted(linked(rows))
    assert sum(made) <= 6 * len(rows)
