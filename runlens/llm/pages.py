"""Main text of web pages: page structure, and a suffix array over each host's token streams.

A page is cut into blocks of text. Blocks inside an article or main element are the text; navigation, headers, footers,
sidebars, notices, adverts, forms, comments, scripts and styles are furniture by their tags, roles or names. What the
markup leaves open the host decides: the token streams of all its pages, without what stands in a marked article, are laid
end to end, their suffixes are sorted, and stretches of `LONG` tokens or more that begin suffixes of several distinct pages
are boilerplate. Open are all plain blocks of pages without a marked article; plain blocks outside of one, kept where no
boilerplate is in them; and blocks inside an article under a name that may mean furniture (`related`, `share`) or that has
a word of furniture beside one of another kind (`notice-board`, `hidden-figures`), dropped where they are boilerplate or
links. Tokens covered by boilerplate are cut out, unique runs stay. Plain text inside a marked article is never removed for
being repeated: the contract keeps it, and passages that pages share are no furniture. What a host has not shown to be
repeated stays, however few pages it has.

A host's distinct pages are dealt out by a hash over shards of about SHARD_PAGES, so a host of any size is many small
arrays. An array only counts: each stretch goes on as a hash with its number of pages, single ones too, and the numbers of
all shards are added up before they are held against the host's one threshold (`needed`). Pages of equal text, articles
included, count as one. Every page is parsed once.

Names alone are weak evidence. An article inside a wrapper named like furniture is the text if the page has no other; blocks
of such names are kept if nothing else is left. Headings in an article's own header belong to it.

Defined results: null and empty html give an empty text; a page of whose open blocks nothing would stay keeps them; pages of
null or odd url form a host of their own; repeated rows are each extracted; extra columns take no part. White space is
what Unicode calls so, after character references are decoded; <br> ends a block; table cells are set apart by a space.
Script, style and the like without an end are a mark alone, and a quote that is never closed does not hide the end of its
tag. Broken pages take no longer than others: time is linear in the page, however deep or unclosed it is.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.llm.groups import runs_by
from runlens.session import materialise

LONG = 8  # tokens
SUPPORT = 0.2  # of a host's distinct pages, two at least, up to SHARD_PAGES; of larger hosts see `needed`
COVERED = 0.5  # of a block's tokens
SHARD_PAGES = 32
BROADCAST_ROWS = 1_000_000  # stretches
BATCH = 1 << 18  # rows
LINKS = 0.5  # an open block with more of its text in links is a menu

MAIN, OPEN, FURNITURE, NAMED = 0, 1, 2, 3  # NAMED: furniture by its class or id alone
DOUBTFUL = 5  # inside an article, by a name that may mean furniture
_SOFT = 4  # an article in a wrapper of such a name, or of one: the text if the page has no other

#: Elements by what they do.
_BLOCK = set("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split())
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_STRONG = set("nav aside footer form menu dialog button select option datalist label".split())
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "form", "toolbar"}
_HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
#: Words of class and id names. Those of the first set hold whatever stands inside them, articles if there are others.
_STRONG_NAMES = set("nav navbar navigation menu sidebar comment comments commentlist disqus replies related breadcrumb breadcrumbs pagination pager footer foot modal popup cookie cookies consent gdpr share sharing social newsletter subscribe signup login widget".split())
_DOUBTFUL_NAMES = set("related share sharing social newsletter subscribe signup login widget".split())  # of them, those that articles use too
_WEAK_NAMES = set("header masthead banner ad ads advert adverts advertisement advertising sponsor sponsored promo promotion notice alert notification toolbar skip hidden".split())
#: Words that stand beside those and change nothing (`site-notice`, `ad-slot`); beside any other word the host is asked.
_PLAIN_WORDS = set("site page box block container wrapper wrap bar slot unit area zone section content inner outer top bottom left right main global mobile desktop sticky fixed inline text label list item group row col column panel message msg close btn button image img frame".split())
_MAIN_NAMES = {"articlebody", "article-body", "post-content", "entry-content", "article-content", "main-content", "story-body", "post-body"}

_RAW = "script style noscript template svg math iframe object textarea title canvas audio video".split()
_RAW_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in _RAW}
_START = re.compile(r"<(?:(?P<comment>!--)|(?P<other>[!?])|(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*))")
_SIMPLE_END = re.compile(r"(?:[^>\"']++|\"[^\">]*+\"|'[^'>]*+')*+>")  # of a tag without > in quotes
_MARK = re.compile("[>\"']")
_ATTR = re.compile(r"([^\s\"'>/=]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?")
_NAME_WORDS = re.compile(r"[a-z]+")


def _quoted_end(page: str, at: int, dead: set[int]) -> int:
    """Where the tag whose rest begins here ends, > in quotes passed over; 0 if a quote stays open. dead: quotes known to lead nowhere, each met once."""
    opened = []
    while mark := _MARK.search(page, at):
        if mark[0] == ">":
            return mark.end()
        if mark.start() in dead:
            break
        opened.append(mark.start())
        close = page.find(mark[0], mark.end())
        if close < 0:
            break
        at = close + 1
    dead.update(opened)
    return 0


def _tags(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(begin, end, name, closing, rest) of each tag in lower case; comments, declarations and raw elements with what they hold have no name."""
    at, last = 0, page.rfind(">")
    endless: set[str] = set()  # raw elements that end nowhere from here on
    dead: set[int] = set()
    while start := _START.search(page, at):
        begin, at = start.start(), start.end()
        if start["comment"]:
            end = page.find("-->", begin + 2)
            at = len(page) if end < 0 else end + 3
            yield begin, at, "", False, ""
            continue
        if at > last:  # no tag ends any more
            continue
        if start["other"]:
            at = page.find(">", at) + 1
            yield begin, at, "", False, ""
            continue
        name, closing, rest_at = start["name"].lower(), bool(start["end"]), at
        simple = _SIMPLE_END.match(page, at)
        at = simple.end() if simple else _quoted_end(page, at, dead) or page.find(">", at) + 1
        rest = page[rest_at : at - 1]
        if name in _RAW_END and not closing:
            if name not in endless and not (name in ("svg", "math") and rest.endswith("/")):
                stop = _RAW_END[name].search(page, at)
                if stop:
                    at = stop.end()
                else:
                    endless.add(name)
            name = ""
        yield begin, at, name, closing, rest


def _role(name: str, rest: str) -> str:
    """'' (nothing), 'main', 'soft' (an article named like furniture), or furniture: 'weak' and 'strong', and by names alone 'faint' and 'named', or 'vague' and 'doubtful' if articles use such names too."""
    whole = name in ("article", "main")
    if whole:
        out = "main"
    elif name in _STRONG:
        out = "strong"
    elif name == "header":
        out = "weak"
    else:
        out = ""
    if not rest.strip():
        return out
    named = doubtful = main = False
    for key, *values in _ATTR.findall(rest):
        value = next((v for v in values if v), "").lower()
        key = key.lower()
        if key == "role":
            if value in _ROLES:
                return "strong"
            if value == "main":
                out, main = "main", True
        elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return "strong"
        elif key in ("class", "id", "itemprop"):
            names = set(value.split())
            words = {w.lower() for w in _NAME_WORDS.findall(value)}
            if name not in ("html", "body") and (found := (names if whole else words) & _STRONG_NAMES):
                doubtful = doubtful or not named and found <= _DOUBTFUL_NAMES
                named = True
                if not found <= _DOUBTFUL_NAMES:
                    doubtful = False
            if names & _MAIN_NAMES:
                out = "main"
            elif not whole and name not in ("html", "body") and words & _WEAK_NAMES and out not in ("strong", "weak"):
                out = "faint" if out == "faint" or any(_means_furniture(n) for n in names) else "vague"
    if named and not main:
        return "soft" if whole else "strong" if name in _STRONG or name == "header" else "doubtful" if doubtful else "named"
    return out


def _means_furniture(name: str) -> bool:
    """Whether a name has a word of furniture and no word of another kind."""
    words = {w for w in _NAME_WORDS.findall(name) if len(w) > 1}
    return bool(words & _WEAK_NAMES) and words <= _WEAK_NAMES | _STRONG_NAMES | _PLAIN_WORDS


#: Where one is in a page: role, under a name of furniture, the role around an article's own header, within furniture for good.
_Place = tuple[int, bool, int | None, bool]
_TOP: _Place = (OPEN, False, None, False)


def _within(place: _Place, name: str, kind: str) -> _Place:
    """The place inside an element that stands at `place`."""
    now, named, header_of, shut = place
    if shut or kind == "strong":
        return FURNITURE, named, None, True
    if kind in ("main", "soft"):
        now = _SOFT if named or kind == "soft" or now == _SOFT else MAIN
    elif kind == "weak":
        now, header_of = FURNITURE, now if now in (MAIN, _SOFT) else None
    elif kind:
        named = named or kind in ("named", "doubtful")
        inside = kind in ("doubtful", "vague") and now in (MAIN, DOUBTFUL)
        now, header_of = FURNITURE if now == FURNITURE else DOUBTFUL if inside else NAMED, None
    elif name in _HEADINGS and header_of is not None:  # of the article's own header
        now = header_of
    return now, named, header_of, False


def blocks_of(page: str | None) -> list[tuple[int, str, float]]:
    """(role, text, share of the text in links) of each block in page order."""
    out: list[tuple[int, str, float]] = []
    stack: list[tuple[str, _Place]] = []  # open elements that matter, containers and those with a role, and the place inside each
    standing: Counter[str] = Counter()  # how often each name is on the stack
    text: list[str] = []
    linked: list[int] = []
    role, in_link = OPEN, False

    def flush() -> None:
        if text:
            words = " ".join(html.unescape("".join(text)).split())
            if words:
                out.append((role, words, min(1.0, sum(linked) / max(1, sum(map(len, text))))))
            text.clear()
            linked.clear()

    def add(piece: str) -> None:
        if piece:
            text.append(piece)
            if in_link:
                linked.append(len(piece))

    def close() -> str:
        name, _ = stack.pop()
        standing[name] -= 1
        return name

    def place() -> _Place:
        return stack[-1][1] if stack else _TOP

    at, page = 0, page or ""
    for begin, end, name, closing, rest in _tags(page):
        add(page[at:begin])
        at = end
        if not name:
            continue
        if name == "a":
            in_link = not closing
        if name in ("td", "th"):
            text.append(" ")
        block = name in _BLOCK
        if block:
            flush()
        if closing:
            if standing[name]:
                flush()
                while close() != name:
                    pass
                role = place()[0]
        elif name not in _VOID:
            if block and stack and stack[-1][0] == "p":
                close()
                role = place()[0]
            kind = _role(name, rest)
            if kind or block and name not in ("p", "li", "tr", "td", "dd", "dt"):
                if kind:
                    flush()
                if not rest.rstrip().endswith("/"):
                    stack.append((name, _within(place(), name, kind)))
                    standing[name] += 1
                    role = place()[0]
    add(page[at:])
    flush()
    soft = FURNITURE if has_main(out) else MAIN
    return [(soft if r == _SOFT else r, t, links) for r, t, links in out]


def has_main(blocks: list[tuple[int, str, float]]) -> bool:
    return any(r == MAIN for r, _, _ in blocks)


def needed(pages: Column) -> Column:
    """How many of a host's distinct pages make a stretch boilerplate: 2 to 7 up to 32 pages, then in proportion to the root,
    36 of 1,000 - a section's menu stands on few of a large host's pages, while chance repeats grow with the host."""
    share = SUPPORT * F.when(pages <= SHARD_PAGES, pages).otherwise(F.sqrt(SHARD_PAGES * pages))
    return F.greatest(F.lit(2), F.ceil(share)).cast("bigint")


def stream_of(texts: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(w) for t in texts for w in t.split()], np.uint64)


def _sorted_stretches(streams: list[np.ndarray], long: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the streams laid end to end: where whole stretches begin, the name of each, and the stream it lies in.

    The suffixes are sorted by their first `long` tokens, doubling the sorted length.
    """
    sizes = np.array([len(s) for s in streams], np.int64)
    if not sizes.sum():
        return (np.zeros(0, np.int64),) * 3
    tokens = np.concatenate(streams)
    owner = np.repeat(np.arange(len(streams)), sizes)
    last = np.repeat(np.cumsum(sizes), sizes)
    place = np.arange(len(tokens))
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    span = 1
    while span < long:
        step = min(span, long - span)
        after = place + step
        follow = np.where(after < last, rank[np.minimum(after, len(tokens) - 1)] + 1, 0)
        order = np.lexsort((follow, rank))
        new = np.zeros(len(tokens), np.int64)
        new[1:] = np.cumsum((rank[order][1:] != rank[order][:-1]) | (follow[order][1:] != follow[order][:-1]))
        rank = np.empty_like(rank)
        rank[order] = new
        span += step
    whole = np.flatnonzero(place + long <= last)  # suffixes as long as that
    return whole, rank[whole], owner[whole]


def _pages_of(names: np.ndarray, pages: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct names and on how many distinct pages each stands."""
    one = np.unique(np.column_stack((names, pages)), axis=0)
    return np.unique(one[:, 0], return_counts=True)


def covered(size: int, begins: np.ndarray, long: int) -> np.ndarray:
    """Which of `size` tokens lie in a stretch that begins at one of these places."""
    edge = np.zeros(size + 1, np.int64)
    np.add.at(edge, begins, 1)
    np.add.at(edge, begins + long, -1)
    return np.cumsum(edge)[:-1] > 0


def boilerplate(streams: list[np.ndarray], long: int = LONG, support: float = SUPPORT) -> list[np.ndarray]:
    """For each page's token stream, which tokens lie in a stretch of `long` tokens found on several distinct pages, all pages in one array."""
    distinct: dict[bytes, int] = {}
    page_of = np.array([distinct.setdefault(s.tobytes(), len(distinct)) for s in streams])
    least = max(2, math.ceil(support * len(distinct)))
    sizes = np.array([len(s) for s in streams], np.int64)
    if not sizes.sum():
        return [np.zeros(n, bool) for n in sizes]
    whole, rank, owner = _sorted_stretches(streams, long)
    names, count = _pages_of(rank, page_of[owner])
    return np.split(covered(sizes.sum(), whole[np.isin(rank, names[count >= least])], long), np.cumsum(sizes)[:-1])


def keys_of(host: str, stream: np.ndarray, long: int = LONG) -> np.ndarray:
    """A hash of the host and each whole stretch of the stream, in order."""
    n = max(0, len(stream) - long + 1)
    key = np.full(n, xxhash.xxh3_64_intdigest(host), np.uint64)
    for j in range(long):
        key = (key ^ stream[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(32)
    return key.view(np.int64)


def choose(blocks: list[tuple[int, str, float]], begins: np.ndarray, long: int = LONG) -> str:
    """The text of a page, given where in the stream of its blocks outside of MAIN boilerplate begins.

    A stretch that runs on into the next block takes no words from it unless at least COVERED of that block is boilerplate.
    """
    whole = has_main(blocks)
    words = [[] if r == MAIN else t.split() for r, t, _ in blocks]
    cuts = np.cumsum([0, *map(len, words)])
    block = np.repeat(np.arange(len(blocks)), np.diff(cuts))
    every = covered(cuts[-1], begins, long)
    within = covered(cuts[-1], begins[block[begins] == block[begins + long - 1]], long)
    likely, kept = {OPEN: [], NAMED: []}, {OPEN: [], NAMED: []}
    for (role, text, links), own, a, b in zip(blocks, words, cuts[:-1], cuts[1:], strict=True):
        if role == MAIN:
            kept[OPEN].append(text)
        elif links > LINKS or role not in (OPEN, NAMED, DOUBTFUL):
            continue
        elif role == DOUBTFUL:
            if every[a:b].mean() < COVERED:
                kept[OPEN].append(text)
        elif whole:
            if role == OPEN and not within[a:b].any() and every[a:b].mean() < COVERED:
                kept[OPEN].append(text)
        else:
            likely[role].append(text)
            flag = every[a:b] if every[a:b].mean() >= COVERED else within[a:b]
            stays = [w for w, f in zip(own, flag, strict=True) if not f]
            if stays:
                kept[role].append(" ".join(stays))
    return "\n".join(kept[OPEN] or likely[OPEN] or kept[NAMED] or likely[NAMED])


def asks(blocks: list[tuple[int, str, float]]) -> bool:
    """Whether markup leaves anything to the host."""
    if not has_main(blocks):
        return bool(blocks)
    return any(r == DOUBTFUL or r == OPEN and links <= LINKS for r, _, links in blocks)


_PARSED = "row bigint, page_id bigint, url string, host string, text string, asks boolean, outside array<string>, stream binary, roles array<int>, texts array<string>, links array<double>"


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """text: what the markup alone says; outside: the blocks the host is judged by; roles, texts and links: all blocks, of pages that ask."""
    for batch in batches:
        for i in range(0, batch.num_rows, 500):
            part = batch.slice(i, 500)
            pages = [blocks_of(x) for x in part.column("html").to_pylist()]
            open_ = [asks(b) for b in pages]
            outside = [[t for r, t, _ in b if r != MAIN] for b in pages]
            full = [b if a else [] for a, b in zip(open_, pages, strict=True)]
            yield pa.RecordBatch.from_arrays([
                *(part.column(c) for c in ("row", "page_id", "url", "host")), pa.array(["\n".join(t for r, t, _ in b if r == MAIN) for b in pages], pa.string()), pa.array(open_, pa.bool_()),
                pa.array(outside, pa.list_(pa.string())), pa.array([xxhash.xxh3_128_digest("\n".join(t for _, t, _ in b)) for b in pages], pa.binary()),
                pa.array([[r for r, _, _ in b] for b in full], pa.list_(pa.int32())), pa.array([[t for _, t, _ in b] for b in full], pa.list_(pa.string())),
                pa.array([[s for _, _, s in b] for b in full], pa.list_(pa.float64())),
            ], ["row", "page_id", "url", "host", "text", "asks", "outside", "stream", "roles", "texts", "links"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """On how many distinct pages of the shard each stretch stands, and the host's threshold with it."""
    for shard in runs_by(batches, ["host", "shard"]):
        host, least = shard.column("host")[0].as_py(), shard.column("least")[0].as_py()
        streams = [stream_of(t) for t in shard.column("outside").to_pylist()]
        _, rank, owner = _sorted_stretches(streams, LONG)
        if not len(rank):
            continue
        names, count = _pages_of(rank, owner)
        key = np.empty(len(names), np.int64)
        key[np.searchsorted(names, rank)] = np.concatenate([keys_of(host, s) for s in streams])
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.full(len(key), least, np.int64)), pa.array(count.astype(np.int64))], ["key", "least", "n"])


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Where in which page each stretch begins."""
    rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def held() -> pa.RecordBatch:
        got = pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*rows, strict=True)], ["row", "pos", "key"])
        rows.clear()
        return got

    for batch in batches:
        for row, host, texts in zip(*(batch.column(batch.schema.names.index(c)).to_pylist() for c in ("row", "host", "outside")), strict=True):
            key = keys_of(host, stream_of(texts))
            rows.append((np.full(len(key), row, np.int64), np.arange(len(key), dtype=np.int64), key))
            if sum(len(k) for k, _, _ in rows) >= BATCH or len(rows) >= 1000:
                yield held()
    if rows:
        yield held()


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages that ask, with the places where boilerplate begins."""
    for batch in batches:
        at = batch.schema.names.index
        texts = []
        for roles, words, links, hits in zip(*(batch.column(at(c)).to_pylist() for c in ("roles", "texts", "links", "hits")), strict=True):
            texts.append(choose(list(zip(roles, words, links, strict=True)), np.array(hits or [], np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column(at("page_id")), batch.column(at("url")), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def extract(pages: DataFrame) -> DataFrame:
    """Per row of pages (page_id, url, html): page_id, url, text."""
    spark = pages.sparkSession
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1)), F.lit(""))
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html", host.alias("host"), F.monotonically_increasing_id().alias("row"))
    parsed = materialise(spark, rows.mapInArrow(_parse, _PARSED))
    one = materialise(spark, parsed.groupBy("host", "stream").agg(F.min("row").alias("row")))
    sizes = one.groupBy("host").count().select("host", needed(F.col("count")).alias("least"), F.ceil(F.col("count") / SHARD_PAGES).alias("shards"))
    dealt = one.join(sizes, "host").select("row", "least", F.pmod(F.xxhash64("stream"), "shards").cast("bigint").alias("shard"))
    counts = parsed.select("row", "host", "outside").join(dealt, "row").repartition("host", "shard").sortWithinPartitions("host", "shard", "row")
    counts = counts.mapInArrow(_count, "key bigint, least bigint, n bigint").groupBy("key", "least").agg(F.sum("n").alias("n"))
    common = materialise(spark, counts.where("n >= least").select("key"))
    common = F.broadcast(common) if common.count() <= BROADCAST_ROWS else common
    left = parsed.where("asks")
    hits = left.select("row", "host", "outside").mapInArrow(_places, "row bigint, pos bigint, key bigint").join(common, "key", "left_semi")
    hits = hits.groupBy("row").agg(F.collect_list("pos").alias("hits"))
    settled = left.join(hits, "row", "left").select("page_id", "url", "roles", "texts", "links", "hits")
    done = parsed.where("not asks").select("page_id", "url", "text")
    return done.unionByName(settled.mapInArrow(_settle, "page_id bigint, url string, text string"))
