"""Main text of web pages, with suffix arrays and the number of a host's pages that share a run.

Each task puts the token streams (words, and a mark for each block's tag) of a slice of pages one
behind another.  A suffix array of these, sorted by the first ``RUN`` tokens through prefix
doubling, brings equal substrings together and gives each (host, run) with the number of its
pages that have it.  These are added up over all pages of the host, however many there are, and
runs on enough distinct pages are boilerplate; every token that one of them covers is marked.  Blocks of a page
whose markup does not say what they are keep only the tokens that are not.  Every page of every host that has enough
pages goes this way, declared or not; ``n_repeated`` tells how many words of its blocks were marked.

Most runs are on one page, so counts are taken in two rounds.  The first adds up 3 bytes a run: its place in a piece of
the cells that keys fall into.  Cells that reach the threshold go into a filter of fixed size, and the second round counts whole keys
of the runs that pass it.  Marks are found from the boilerplate runs where these are few; otherwise they return to the pages by a join.

Where the markup does say it, it is believed: blocks inside ``article`` or ``main`` are the main text even
if other pages repeat them (copied articles are still articles), and blocks of menus, headers,
footers, sidebars, notices, adverts, forms and reader comments are not, even on one page.  A page
with an ``article`` or ``main`` has its text there alone.  Names count as whole class or id tokens, not on
headings.  Inside ``article`` or ``main`` only elements, roles and hidden parts are believed, and names of adverts, cookie notices,
sidebars and sections of reader comments.  An ``article`` or
``main`` inside an element that only its name sets apart is believed where the page has no other;
an ``article`` among comments or related texts is not.

Scripts, styles, comments and markup go, character references are decoded, white space inside a
block becomes one space (a line break too), and blocks are joined by a newline.  Null html is
empty; a null url is a host of its own; damaged markup closes at the end of what holds it.  Rows
that repeat a page_id are pages each.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywise.llm.common import mix, slices, span_hashes, utf8, words
from tallywise.sources.staging import staged

#: Tokens of a repeat, and pages of a host, of whatever size, that make it boilerplate.
RUN, PAGES = 8, 8
#: Hosts of enough pages are broadcast up to this number (beyond it, pages of all hosts are counted); boilerplate runs too, and joined beyond it, a part for
#: every LOT pages of a run then.
HOSTS_MOST, RUNS_MOST, LOT = 200_000, 200_000, 20_000
#: Bits of a run's key that are its piece and its place there, and those that the filter tells apart; runs that a task holds before it gives their cells.
PIECE, PLACE, TOLD, HELD = 12, 24, 27, 1 << 21

CHROME, OPEN, MAIN, WRAPPED = 0, 1, 2, 3

# Elements of HTML by what they mean for the main text.
RAW = {"script", "style", "textarea", "title", "iframe"}
#: Elements whose text is not shown, to their end or that of what holds them; buttons only outside the main text.
INERT = {"template", "svg", "select", "audio", "video", "canvas"}
NOT_MAIN = {"nav", "footer", "aside", "form", "menu", "dialog", "head"}
BLOCKS = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "alert", "form", "menu", "menubar"}
NAMES = "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe signup sidebar widget widgets menu nav navbar navigation breadcrumb breadcrumbs footer masthead share sharing social related recommended comment comments commentlist disqus respond replies pagination pager toolbar topbar login search skip".split()
COMPOUND = "site-footer page-footer site-nav site-navigation main-nav main-navigation main-menu nav-menu nav-bar side-bar cookie-notice cookie-banner cookie-consent cookie-bar ad-banner ad-container ad-slot share-buttons social-links social-share newsletter-signup skip-link".split()
#: Names of elements whose articles are other texts than the page's.
OTHERS = set("comment comments commentlist disqus respond replies related recommended comment-list comments-area comments-section related-posts related-articles".split())
NAMED = set(NAMES) | set(COMPOUND) | OTHERS
HEADERS = {"header", "site-header", "page-header"}
#: Inside the main text: names that set any element apart, and those that set a section of it apart.
ADVERTS = set("ad ads adv advert adverts advertisement advertising adsense sponsored ad-banner ad-container ad-slot cookie-notice cookie-banner cookie-consent cookie-bar".split())
SECTIONS = {"sidebar"} | OTHERS - {"comment", "related", "recommended"}
SECTION_ELEMENTS = {"div", "section", "aside", "ol", "ul", "dl"}
#: Ids that set an element apart inside the main text too, and those that do so on a div.
IDS, DIV_IDS = {"comments", "commentlist", "disqus", "respond"}, {"sidebar", "navbar", "breadcrumb", "breadcrumbs"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6", "hgroup"}

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?/][^>]*>|<(/?)([A-Za-z][^\s/>]*+)([^>]*)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*))")
#: Attributes that may set an element apart, as they are found in or outside names.
_TELLING = re.compile(r"class|id|role|style|hidden", re.I)
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I) for name in RAW}
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


def _apart(name: str, attributes: str, in_main: bool) -> tuple[bool, bool, bool]:
    """Whether an element holds no main text: by itself; only by its name; by one of the names OTHERS."""
    if name in NOT_MAIN or (name == "header" and not in_main):
        return True, False, False
    if not attributes or name in ("html", "body", "article", "main") or not _TELLING.search(attributes):
        return False, False, False
    a = {k.lower(): (x or y or z).lower() for k, x, y, z in _ATTRIBUTE.findall(attributes)}
    bare = _ATTRIBUTE.sub(" ", attributes).lower().split()
    if a.get("role") in ROLES or _HIDDEN.search(a.get("style", "")) or "hidden" in bare or "hidden" in a:
        return True, False, False
    if name in HEADINGS:
        return False, False, False
    classes, ids = set(a.get("class", "").split()), set(a.get("id", "").split())
    if in_main:
        ids &= IDS | DIV_IDS if name == "div" and "section" not in classes else IDS
    called = (classes | ids) & (NAMED | HEADERS)
    if in_main:
        called = (classes | ids) & ADVERTS | (classes & SECTIONS | ids if name in SECTION_ELEMENTS else set())
    others = bool(called & OTHERS)
    return False, bool(called) and not others, others


def page_blocks(html: str) -> list[tuple[int, str, str]]:
    """The blocks of a page in order: CHROME, OPEN or MAIN; the tag that opened it; the text."""
    out: list[tuple[int, str, str]] = []
    open_: list[tuple[str, bool, bool, bool, bool, bool, int]] = []
    names: defaultdict[str, int] = defaultdict(int)  # of the open elements, so that deep nesting is searched only for what is there
    hard = named = others = main = inert = 0
    ended = 0  # names around the article or main that it ends
    text: list[str] = []
    tag, at = "", 0

    def flush() -> None:
        if text:
            if words_ := unescape("".join(text)).split():
                out.append((CHROME if hard + named + others > ended else OPEN if not main else WRAPPED if ended else MAIN, tag, " ".join(words_)))
            text.clear()

    def close(down_to: int) -> None:
        nonlocal hard, named, others, main, inert, ended
        for name, h, n, o, inside, unseen, before in reversed(open_[down_to:]):
            names[name] -= 1
            hard, named, others, main, inert, ended = hard - h, named - n, others - o, main - inside, inert - unseen, before
        del open_[down_to:]

    while True:
        m = _TAG.search(html, at)
        start, end = m.span() if m else (len(html), 0)
        if at < start and not inert:
            text.append(html[at:start])
        if m is None:
            break
        at = end
        closing, name, attributes, closing_too, other, rest = m.groups()
        name = (name or other or "").lower()
        if not name:
            continue
        if name == "br":
            text.append(" ")
            continue
        if closing or closing_too:
            if name in BLOCKS:
                flush()
            if names[name]:
                close(len(open_) - 1 if open_[-1][0] == name else next(i for i in range(len(open_) - 1, -1, -1) if open_[i][0] == name))
            continue
        attributes = attributes or rest or ""
        if name in INERT and attributes.rstrip().endswith("/"):
            continue
        if name in RAW:
            if not attributes.rstrip().endswith("/"):
                last = _RAW_END[name].search(html, at)
                at = last.end() if last else len(html)
            continue
        block = name in BLOCKS
        if block:
            if names["svg"]:  # a block ends a drawing that is still open
                close(next(i for i, o in enumerate(open_) if o[0] == "svg"))
            flush()
            tag = name
            if names["p"]:
                close(next(i for i in range(len(open_) - 1, -1, -1) if open_[i][0] == "p"))
        if name in VOID:
            continue
        if name in ("article", "main") and any(names[x] for x in ("nav", "header", "footer", "head")):
            close(next(i for i, o in enumerate(open_) if o[0] in ("nav", "header", "footer", "head")))
        unseen = name in INERT or (name == "button" and not main)
        h, n, o = (False, False, False) if unseen else _apart(name, attributes, main > 0)
        if not block and (h or (main and (n or o))):
            h, n, o, unseen = False, False, False, True  # inside a block, whose other text stays
        if block or unseen or n or o or names[name]:
            inside = name in ("article", "main")
            names[name] += 1
            open_.append((name, h, n, o, inside, unseen, ended))
            hard, named, others, main, inert = hard + h, named + n, others + o, main + inside, inert + unseen
            if inside:
                ended = named + others * (name == "main")
    flush()
    alone = all(kind != MAIN for kind, *_ in out)
    return [((MAIN if alone else CHROME) if kind == WRAPPED else kind, tag, text) for kind, tag, text in out]


def suffix_array(tokens: np.ndarray, page: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in the order of their first ``run`` tokens (a power of 2) and the class of each position.

    Prefix doubling: a class of length 2k is a pair of classes of length k.  Substrings that would cross the end of
    a page get classes of their own.
    """
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64) + 1
    n, width = len(tokens), 1
    while width < run:
        ahead = np.zeros(n, np.int64)
        ahead[: n - width] = np.where(page[width:] == page[: n - width], rank[width:], 0) if width < n else 0
        lone = np.flatnonzero(ahead == 0)
        ahead[lone] = -1 - lone
        rank = np.unique(rank * np.int64(1 << 31) + ahead, return_inverse=True)[1].astype(np.int64) + 1
        width *= 2
    return np.argsort(rank, kind="stable"), rank


def shared_runs(tokens: np.ndarray, page: np.ndarray, host: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of whole runs by (run, host); where each of these begins among them; its number of distinct pages.

    ``host`` is by page, and pages of a host stand together.
    """
    n = len(tokens)
    order, rank = suffix_array(tokens, page, RUN)
    order = order[order <= n - RUN]
    order = order[page[order] == page[order + RUN - 1]]
    if not len(order):
        return order, order, order
    r, p = rank[order], page[order]
    new = np.append(True, (r[1:] != r[:-1]) | (host[p[1:]] != host[p[:-1]]))
    first = np.flatnonzero(new)
    # positions of a class stand in order, so its pages do too
    return order, first, np.add.reduceat((new | np.append(True, p[1:] != p[:-1])).astype(np.int64), first)


def spread(hit: np.ndarray, n: int) -> np.ndarray:
    """Which of n tokens lie in a run that starts at one of the positions."""
    edge = np.zeros(n + RUN + 1, np.int64)
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + RUN, -1)
    return np.cumsum(edge)[:n] > 0


def covered(tokens: np.ndarray, page: np.ndarray, least: int) -> np.ndarray:
    """Which tokens of one host's pages lie in a run of RUN tokens or more that ``least`` distinct pages have."""
    order, first, counts = shared_runs(tokens, page, np.zeros(int(page.max(initial=0)) + 1, np.uint64))
    return spread(order[np.repeat(counts >= least, np.diff(np.append(first, len(order))))], len(tokens))


def run_keys(tokens: np.ndarray, at: np.ndarray, host: np.ndarray) -> np.ndarray:
    """64-bit keys of the runs that start at the positions, each with the hash of its host."""
    h = mix(host)
    for j in range(RUN):
        h = mix(h + tokens[at + j])
    return h


class Stream:
    """The tokens of the blocks of pages, one page behind another."""

    def __init__(self, pages: list[list[tuple[int, str, str]]]) -> None:
        self.flat = [(i, *b) for i, blocks in enumerate(pages) for b in blocks]
        self.data, bounds = utf8(pa.array([f"<{tag}> {text}" for _, _, tag, text in self.flat], pa.string()))
        self.starts, self.ends, self.first = words(self.data, bounds)
        self.page = np.repeat(np.array([i for i, *_ in self.flat], np.int64), np.diff(self.first))
        self.tokens = span_hashes(self.data, self.starts, self.ends)

    def runs(self, host: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions and keys of all runs; ``host`` is by page."""
        at = np.arange(max(0, len(self.tokens) - RUN + 1))
        at = at[self.page[at] == self.page[at + RUN - 1]]
        return at, run_keys(self.tokens, at, host[self.page[at]])

    def texts(self, n: int, hidden: np.ndarray) -> tuple[list[str], np.ndarray]:
        """The texts of n pages, and how many words of their blocks are hidden: MAIN blocks as they are, or else OPEN ones without these words."""
        declared = {i for i, kind, *_ in self.flat if kind == MAIN}
        out: list[list[str]] = [[] for _ in range(n)]
        many = np.zeros(n, np.int64)
        for (i, kind, _, text), a, b in zip(self.flat, self.first[:-1], self.first[1:], strict=True):
            if kind == (MAIN if i in declared else OPEN):
                mask = hidden[a + 1 : b]
                many[i] += (cut := int(np.count_nonzero(mask)))
                if kind == MAIN or not cut:
                    out[i].append(text)
                elif cut < len(mask):
                    out[i].append(b" ".join(self.data[s:e].tobytes() for s, e, h in zip(self.starts[a + 1 : b], self.ends[a + 1 : b], mask, strict=True) if not h).decode())
        return ["\n".join(x) for x in out], many


def host_hashes(hosts: pa.Array) -> np.ndarray:
    data, bounds = utf8(hosts)
    return span_hashes(data, bounds[:-1], bounds[1:])


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Stream, np.ndarray]]:
    """Slices of pages, a host's together, with their tokens and the hash of each page's host."""
    for batch in batches:
        for part in slices(batch, "html"):
            part = part.take(pa.array(np.argsort(host_hashes(part.column("host")), kind="stable")))
            yield part, Stream([page_blocks(h) for h in part.column("html").to_pylist()]), host_hashes(part.column("host"))


def _packed(cells: np.ndarray) -> pa.RecordBatch:
    """A row for each piece that the cells are in, with their places there in 3 bytes each."""
    cells = np.sort(cells)
    piece = (cells >> np.uint64(PLACE)).astype(np.int32)
    first = np.flatnonzero(np.diff(piece, prepend=-1))
    data = np.ascontiguousarray(cells.astype("<u4").view(np.uint8).reshape(-1, 4)[:, : PLACE // 8])
    ends = (np.append(first, len(cells)) * (PLACE // 8)).astype(np.int32)
    places = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends), pa.py_buffer(data)])
    return pa.RecordBatch.from_arrays([pa.array(piece[first]), places], ["piece", "places"])


def _unpacked(batch: pa.RecordBatch) -> np.ndarray:
    """The cells of such rows."""
    places = batch.column("places").cast(pa.large_binary())
    _, offsets, data = places.buffers()
    ends = np.frombuffer(offsets, np.int64)[places.offset : places.offset + len(places) + 1]
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].reshape(-1, PLACE // 8).astype(np.uint64)
    return np.repeat(np.asarray(batch.column("piece")).astype(np.uint64) << np.uint64(PLACE), np.diff(ends) // (PLACE // 8)) + (raw << np.arange(0, PLACE, 8, dtype=np.uint64)).sum(1, dtype=np.uint64)


def _cells(least: int):
    """The cells of the distinct (host, run) of each slice of pages, each as often as pages have it, at most ``least`` times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for _, stream, host in _streams(batches):
            order, first, counts = shared_runs(stream.tokens, stream.page, host)
            at = order[first]
            if len(at):
                held.append(np.repeat(run_keys(stream.tokens, at, host[stream.page[at]]) >> np.uint64(64 - PIECE - PLACE), np.minimum(counts, least)))
            if sum(map(len, held)) >= HELD:
                yield _packed(np.concatenate(held))
                held.clear()
        if held:
            yield _packed(np.concatenate(held))

    return run


def _often_cells(least: int):
    """From rows in the order of their pieces, a bit map for each piece: which of its cells ``least`` pages or more are in."""
    inner = TOLD - PIECE

    def marked(cells: np.ndarray) -> Iterator[pa.RecordBatch]:
        value, many = np.unique(cells, return_counts=True)
        told = value[many >= least] >> np.uint64(PIECE + PLACE - TOLD)
        piece = (told >> np.uint64(inner)).astype(np.int32)
        for k in np.unique(piece):
            bits = np.zeros(1 << inner, bool)
            bits[(told[piece == k] & np.uint64((1 << inner) - 1)).astype(np.int64)] = True
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], ["piece", "bits"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(0, np.uint64)
        for batch in batches:
            if batch.num_rows:
                held = np.append(held, _unpacked(batch))
                open_ = int(np.searchsorted(held >> np.uint64(PLACE), held[-1] >> np.uint64(PLACE)))
                yield from marked(held[:open_])
                held = held[open_:]
        yield from marked(held)

    return run


def _told(keys: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Which keys the filter lets pass: all that ``least`` pages have, and few others."""
    at = (keys >> np.uint64(64 - TOLD)).astype(np.int64)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


def _page_runs(stream: Stream, host: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Run and page of the distinct pairs of these whose runs the filter lets pass, in their order."""
    at, keys = stream.runs(host)
    passed = _told(keys, bits)
    run, page = keys[passed].view(np.int64), stream.page[at[passed]]
    order = np.lexsort((page, run))
    run, page = run[order], page[order]
    new = np.append(True, (run[1:] != run[:-1]) | (page[1:] != page[:-1]))[: len(run)]
    return run[new], page[new]


def _count(filter_):
    """The distinct (host, run) of each slice of pages that the (broadcast) filter lets pass, and how many of these pages have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, stream, host in _streams(batches):
            keys, pages = np.unique(_page_runs(stream, host, filter_.value)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(pages)], ["run", "pages"])

    return run


def _own_runs(filter_):
    """The distinct runs of each page that the filter lets pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, stream, host in _streams(batches):
            keys, page = _page_runs(stream, host, filter_.value)
            yield pa.RecordBatch.from_arrays([part.column("row").take(pa.array(page)), pa.array(keys)], ["row", "run"])

    return run


def _finish(often, filter_):
    """The texts of pages from html and the boilerplate runs: ``often``, in their order, or those that come with each page; both are broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, stream, host in _streams(batches):
            at, keys = stream.runs(host)
            passed = _told(keys, filter_.value)
            at, keys = at[passed], keys[passed].view(np.int64)
            known = often.value
            if "runs" in part.schema.names:
                # a run is boilerplate of its host or not, so the lists of a slice can be put together
                known = np.unique(np.array([r for runs in part.column("runs").to_pylist() for r in runs or ()], np.int64))
            hit = at[known[np.searchsorted(known[:-1], keys)] == keys] if len(known) else at[:0]
            texts, many = stream.texts(part.num_rows, spread(hit, len(stream.tokens)))
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(many)], ["page_id", "url", "text", "n_repeated"])

    return run


def _filter(rows: DataFrame, least: int) -> np.ndarray:
    """A bit for each run of 2^TOLD kinds, set for those that ``least`` pages of a host have."""
    cells = rows.select("html", "host").mapInArrow(_cells(least), "piece int, places binary")
    often = staged(cells.repartition("piece").sortWithinPartitions("piece").mapInArrow(_often_cells(least), "piece int, bits binary"))
    bits = np.zeros((1 << PIECE, 1 << (TOLD - PIECE - 3)), np.uint8)
    for r in often.toLocalIterator():
        bits[r["piece"]] |= np.frombuffer(r["bits"], np.uint8)
    return bits.ravel()


def extract(pages: DataFrame, least_pages: int = PAGES) -> DataFrame:
    """page_id, url, text, n_chars, n_repeated for each row of pages (page_id, url, html).

    Runs of RUN tokens that ``least_pages`` pages of a host have are boilerplate, on hosts of any size: they are cut where markup is silent.
    ``n_repeated`` counts their words in the blocks that the text comes from.
    """
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")).withColumn("host", host)
    # a host of fewer pages has no run on enough of them
    hosts = staged(rows.groupBy("host").count().filter(F.col("count") >= least_pages).select(F.col("host").alias("h")))
    many = hosts.count()
    counted = rows.join(F.broadcast(hosts), rows["host"] == hosts["h"], "left_semi") if many <= HOSTS_MOST else rows
    bits = _filter(counted, least_pages) if many else np.zeros(1 << (TOLD - 3), np.uint8)
    sent = pages.sparkSession.sparkContext.broadcast
    passing, often = sent(bits), None
    if bits.any():
        counts = counted.select("html", "host").mapInArrow(_count(passing), "run long, pages long")
        often = staged(counts.groupBy("run").agg(F.sum("pages").alias("pages")).filter(F.col("pages") >= least_pages).select(F.col("run").alias("o"), F.ceil(F.col("pages") / LOT).alias("lots")))
    known = np.zeros(0, np.int64)
    if often is None or often.count() <= RUNS_MOST:
        if often is not None:
            known = np.sort(np.array([r["o"] for r in often.select("o").collect()], np.int64))
    else:
        # pages that are equal in all of this may share a list
        rows = rows.withColumn("row", F.xxhash64("page_id", "host", "html"))
        own = rows.select("row", "host", "html").mapInArrow(_own_runs(passing), "row long, run long")
        # a run that most pages of a large host have would be one task's work: those of more than a lot are dealt by row
        wide = often.filter("lots > 1")
        wide = F.broadcast(wide) if wide.count() <= RUNS_MOST else wide.hint("merge")
        own = own.join(wide, own["run"] == F.col("o"), "left").select("row", "run", F.coalesce(F.pmod(F.xxhash64("row"), F.col("lots")), F.lit(0)).alias("salt"))
        dealt = often.withColumn("s", F.explode(F.sequence(F.lit(0).cast("long"), F.col("lots") - 1)))
        hits = own.join(dealt.hint("merge"), (own["run"] == dealt["o"]) & (own["salt"] == dealt["s"]))
        marks = staged(hits.groupBy(F.col("row").alias("r")).agg(F.collect_list("run").alias("runs")))
        rows = rows.join(marks.hint("merge"), rows["row"] == marks["r"], "left").select("page_id", "url", "host", "html", "runs")
    found = rows.mapInArrow(_finish(sent(known), passing), "page_id long, url string, text string, n_repeated long")
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_repeated")
