"""Removal of passages that occur more than once anywhere in a corpus, with Aho-Corasick automata.

A window is ``width`` consecutive words of a document.  Words go that are covered by a window whose words also start somewhere else,
in the same document or another.

* Candidates: every window is represented by the phrase of ``anchor`` words in it with the least hash (the leftmost of equals).
  Equal windows have the same anchor at the same place, so only windows with an anchor that occurs twice or more are looked
  at.  About one phrase in nine is an anchor, and only the anchors are shuffled.
* Confirmed passages: the windows at recurring anchors are counted by two 64-bit hashes; those that start at two places or
  more are confirmed, and their text is taken from the first of these places.
* Automata: anchors are dealt over shards of about ``SHARD`` confirmed windows.  A shard compiles its windows into automata, whose letters
  are words, and streams the passages around its anchors from all documents through them: every place where
  a confirmed window stands, word for word, is found.
* Anchors that occur very often are dealt over several shards, each with their windows; anchors with very many windows
  are split by window, and a passage goes to the shards of the windows that it may hold.
* The places are merged to spans per document, and the words under them removed.

Null text has no words; texts shorter than a window keep all their words.  Very long texts are one row each and handled in slices of
a megabyte.  Repeated rows are documents each, and so remove each other whole.  An empty table gives an empty one.  Other
columns are not touched.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywise.llm.common import mix, slices, span_hashes, split_join, utf8, words
from tallywise.sources.staging import release, staged
from tallywise.tables import small

#: Confirmed windows in an automaton, and about as many in a shard: a search goes through the children of a node one by one.
SHARD = 500
#: Distinct passages whose places a shard remembers.
KNOWN = 10_000
#: Passages of an anchor that go to one shard at least, however few there are in all.
OFTEN = 500

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _phrases(h: np.ndarray, n: int, base: np.uint64) -> np.ndarray:
    """Hashes of every n consecutive words, from prefix sums of a polynomial of word hashes modulo 2^64."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    up = np.full(len(h) + 1, base, np.uint64)
    up[0] = 1
    up = np.multiply.accumulate(up)
    down = np.full(len(h) + 1, pow(int(base), -1, 1 << 64), np.uint64)
    down[0] = 1
    down = np.multiply.accumulate(down)
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(mix(h ^ base) * up[:-1], out=sums[1:])
    return mix((sums[n:] - sums[:-n]) * down[: len(h) - n + 1])


def _least(values: np.ndarray, n: int) -> np.ndarray:
    """The place of the least of every n consecutive values, the leftmost of equals."""
    if len(values) < n:
        return np.zeros(0, np.int64)
    out = np.empty(len(values) - n + 1, np.int64)
    for start in range(0, len(out), 1 << 15):
        view = sliding_window_view(values[start : start + (1 << 15) + n - 1], n)
        out[start : start + len(view)] = view.argmin(1) + np.arange(start, start + len(view))
    return out


class _Texts:
    """Words, anchors and windows of the texts of a slice."""

    def __init__(self, text: pa.Array, width: int, anchor: int) -> None:
        self.data, bounds = utf8(text)
        self.starts, self.ends, self.first = words(self.data, bounds)
        self.hashes = span_hashes(self.data, self.starts, self.ends)
        self.tokens = _phrases(self.hashes, anchor, _A)
        least = _least(self.tokens, width - anchor + 1)
        doc = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        self.doc = doc
        # windows that lie in one document, and the anchor of each
        self.windows = np.flatnonzero(doc[: len(least)] == doc[width - 1 :]) if len(least) else np.zeros(0, np.int64)
        self.anchor_of = least[self.windows]


def _anchors(rows: DataFrame, width: int, anchor: int) -> DataFrame:
    """(row, at, token): the anchors of all windows; ``at`` counts words of the document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                t = _Texts(part.column("text"), width, anchor)
                at = np.unique(t.anchor_of)
                doc = t.doc[at] if len(at) else at
                yield pa.RecordBatch.from_arrays([part.column("row").take(pa.array(doc)), pa.array(at - t.first[doc]), pa.array(t.tokens[at].view(np.int64))], ["row", "at", "token"])

    return rows.mapInArrow(run, "row long, at long, token long")


def _passages(marked: DataFrame, width: int, anchor: int) -> DataFrame:
    """(token, row, at, text): the words of all windows of each recurring anchor; ``at`` is the first of them in its document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                t = _Texts(part.column("text"), width, anchor)
                marks = part.column("marks")
                at = np.asarray(marks.flatten(), np.int64) + np.repeat(t.first[:-1], np.asarray(pc.list_value_length(marks), np.int64))
                keep = np.isin(t.anchor_of, at)
                windows, of = t.windows[keep], t.anchor_of[keep]
                _, low = np.unique(of, return_index=True)
                high = np.append(low[1:], len(of)) - 1
                begin, end = windows[low], windows[high] + width - 1 if len(of) else windows[low]
                data = t.data.tobytes()
                text = [data[a:b] for a, b in zip(t.starts[begin].tolist(), t.ends[end].tolist(), strict=True)] if len(of) else []
                doc = t.doc[begin] if len(of) else begin
                yield pa.RecordBatch.from_arrays([pa.array(t.tokens[of[low]].view(np.int64)), part.column("row").take(pa.array(doc)), pa.array(begin - t.first[doc]), pa.array(text, pa.binary())], ["token", "row", "at", "text"])

    return marked.mapInArrow(run, "token long, row long, at long, text binary")


def _window_hashes(passages: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every window of the passages: two hashes, the passage and the place in it."""
    column = passages.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    starts, ends, first = words(data, bounds - bounds[0])
    h = span_hashes(data, starts, ends)
    of = np.repeat(np.arange(len(column)), np.diff(first))
    n = max(0, len(h) - width + 1)
    inside = np.flatnonzero(of[:n] == of[width - 1 :]) if n else np.zeros(0, np.int64)
    return _phrases(h, width, _A)[inside], _phrases(h, width, _B)[inside], of[inside], inside - first[of[inside]]


def _confirmed(passages: DataFrame, width: int, anchor: int) -> DataFrame:
    """(id, places): of the passages that are the first to hold a recurring window, the places of these windows."""
    most = width - anchor + 1  # windows in a passage

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                a, b, of, place = _window_hashes(part.column("text"), width)
                at = part.column("id").to_numpy()[of] * most + place
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(at)], ["a", "b", "at"])

    found = passages.mapInArrow(run, "a long, b long, at long").groupBy("a", "b").agg(F.count(F.lit(1)).alias("times"), F.min("at").alias("at")).filter("times > 1")
    place = F.pmod("at", F.lit(most))
    return found.groupBy(F.expr(f"at div {most}").alias("id")).agg(F.sort_array(F.collect_list(place.cast("int"))).alias("places"))


def _split_of(hashes: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """The part of each window of an anchor whose windows are dealt over ``parts``."""
    return (mix(hashes) % parts.astype(np.uint64)).astype(np.int32)


def _routed(passages: DataFrame, width: int) -> DataFrame:
    """(token, salts, row, at, text, places, sub) of passages to search, and of those with ``places``, whose windows are compiled.

    ``parts`` (of the anchor's windows) and ``salts`` (of its passages) are 1 but for very frequent anchors.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                count = part.column("parts").to_numpy()
                a, _, of, place = _window_hashes(part.column("text"), width)
                sub = _split_of(a, count[of])
                take, key, kept = [], [], []
                places = part.column("places").to_pylist()
                ends = np.searchsorted(of, np.arange(part.num_rows + 1))
                for i in range(part.num_rows):
                    own = dict(zip(place[ends[i] : ends[i + 1]].tolist(), sub[ends[i] : ends[i + 1]].tolist(), strict=True))
                    for s in sorted(set(own.values()) if places[i] is None else {own[p] for p in places[i]}):
                        take.append(i)
                        key.append(s)
                        kept.append(None if places[i] is None else [p for p in places[i] if own[p] == s])
                rows = [part.column(c).take(pa.array(take, pa.int64())) for c in ("token", "salts", "row", "at", "text")]
                yield pa.RecordBatch.from_arrays([*rows, pa.array(kept, pa.list_(pa.int32())), pa.array(key, pa.int32())], ["token", "salts", "row", "at", "text", "places", "sub"])

    return passages.mapInArrow(run, "token long, salts int, row long, at long, text binary, places array<int>, sub int")


class _Shard:
    """Automata over the windows of one shard, with words as letters; passages go through all of them."""

    def __init__(self, width: int) -> None:
        self.width, self.codes, self.automata, self.size, self.open = width, {}, [], 0, None
        self.known: dict[bytes, list[tuple[int, int]]] = {}

    def add(self, text: bytes, places: list[int]) -> None:
        code = self.codes
        split = text.split()
        for w in split:
            if w not in code:
                n = len(code) + 1
                code[w] = chr(n if n < 0xD800 else n + 0x800)  # past the surrogates
        letters = "".join([code[w] for w in split])
        for p in places:
            if self.open is None:
                self.open = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
            self.size += self.open.add_word(letters[p : p + self.width])
        # letters are code points, of which there are more than an automaton has words
        if self.size >= SHARD:
            self.close()

    def close(self) -> None:
        if self.open is not None:
            self.open.make_automaton()
            self.automata.append((self.open, self.codes))
        self.open, self.size, self.codes = None, 0, {}

    def spans(self, text: bytes) -> list[tuple[int, int]]:
        """First and last word of every run of words under windows that the automata find; those of copies are remembered."""
        if (known := self.known.get(text)) is not None:
            return known
        split, ends = text.split(), set()
        for automaton, codes in self.automata:
            ends.update([e for e, _ in automaton.iter("".join([codes.get(w, "\0") for w in split]))])
        out: list[tuple[int, int]] = []
        for e in sorted(ends):
            if out and e - self.width < out[-1][1]:
                out[-1] = (out[-1][0], e)
            else:
                out.append((e - self.width + 1, e))
        if len(self.known) >= KNOWN:
            self.known.clear()
        self.known[text] = out
        return out


def _located(dealt: DataFrame, width: int) -> DataFrame:
    """(row, low, high): the words of each document that the automata of a shard find covered; rows come sorted by shard and kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, now, ready = None, None, False
        for batch in batches:
            rows, low, high = [], [], []
            for s, kind, row, at, text, places in zip(*(batch.column(c).to_pylist() for c in ("shard", "kind", "row", "at", "text", "places")), strict=True):
                if s != shard:
                    shard, now, ready = s, _Shard(width), False
                if kind == 0:
                    now.add(text, places)
                    continue
                if not ready:
                    now.close()
                    ready = True
                for a, b in now.spans(text):
                    rows.append(row)
                    low.append(at + a)
                    high.append(at + b)
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(low, pa.int64()), pa.array(high, pa.int64())], ["row", "low", "high"])

    return dealt.mapInArrow(run, "row long, low long, high long")


def repeated_spans(rows: DataFrame, width: int = 35, anchor: int = 18) -> DataFrame:
    """(row, spans): sorted pieces (first word, last word) of each document that lie under windows that occur elsewhere too.

    ``rows`` (row, text) must be a written table with one row for each ``row``; documents without such words are absent.
    """
    spark = rows.sparkSession
    anchors = staged(_anchors(rows, width, anchor), "zstd")
    often = staged(anchors.groupBy("token").agg(F.count(F.lit(1)).alias("times")).filter("times > 1"))
    hits = split_join(anchors, often, ["token"], "times", anchors.count())
    marks = staged(hits.groupBy("row").agg(F.sort_array(F.collect_list("at")).alias("marks")))
    release(anchors)
    passages = _passages(rows.join(marks.hint("merge"), "row"), width, anchor)
    passages = staged(passages.withColumn("id", F.monotonically_increasing_id()), "zstd")
    first = staged(_confirmed(passages, width, anchor))
    compiled = staged(passages.join(first.hint("merge"), "id").drop("id"), "zstd")
    release(first, marks)
    total = compiled.agg(F.sum(F.size("places"))).first()[0] or 0
    shards = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // SHARD))
    # anchors with more passages than a shard's share, or with more windows than an automaton has
    share = max(OFTEN, passages.count() // shards)
    sizes = compiled.groupBy("token").agg(F.sum(F.size("places")).alias("windows"))
    parts = [F.ceil(F.col("windows") / SHARD).cast("int").alias("parts"), F.ceil(F.col("times") / share).cast("int").alias("salts")]
    frequent = staged(sizes.join(often.hint("merge"), "token").select("token", *parts).filter("parts > 1 OR salts > 1"))
    every = passages.drop("id").withColumn("places", F.lit(None).cast("array<int>")).unionByName(compiled).join(small(frequent), "token", "left")
    plain = every.filter("parts IS NULL OR parts = 1").withColumn("salts", F.coalesce("salts", F.lit(1))).withColumn("sub", F.lit(0))
    routed = _routed(every.filter("parts > 1").select("token", "row", "at", "text", "places", "parts", "salts"), width)
    routed = plain.select(*routed.columns).unionByName(routed).withColumn("kind", F.col("places").isNull().cast("int"))
    # compiled windows go to every salt of their anchor, searched passages to one
    salt = F.when(F.col("kind") == 0, F.sequence(F.lit(0), F.col("salts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("row", "at"), F.col("salts")).cast("int")))
    dealt = routed.withColumn("salt", F.explode(salt)).withColumn("shard", F.pmod(F.xxhash64("token", "sub", "salt"), F.lit(shards)))
    dealt = dealt.select("shard", "kind", "row", "at", "text", "places").repartition("shard").sortWithinPartitions("shard", "kind")
    spans = staged(_located(dealt, width).groupBy("row").agg(F.sort_array(F.collect_list(F.struct("low", "high"))).alias("spans")))
    release(passages, compiled, frequent, often)
    return spans


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 35, anchor: int = 18) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept (the words that stay, joined by a space)."""
    rows = staged(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("row", F.monotonically_increasing_id()), "zstd")
    spans = repeated_spans(rows.select("row", "text"), width, anchor)
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                data, bounds = utf8(part.column("text"))
                starts, ends, first = words(data, bounds)
                found = part.column("spans")
                each = np.asarray(pc.fill_null(pc.list_value_length(found), 0), np.int64)
                flat = found.drop_null().flatten()
                base = np.repeat(first[:-1], each)
                cover = np.zeros(len(starts) + 1, np.int64)
                if len(flat):
                    np.add.at(cover, np.asarray(flat.field("low"), np.int64) + base, 1)
                    np.add.at(cover, np.asarray(flat.field("high"), np.int64) + base + 1, -1)
                keep = np.cumsum(cover[:-1]) == 0
                held = np.zeros(len(keep) + 1, np.int64)
                np.cumsum(keep, out=held[1:])
                n = np.diff(first)
                raw = data.tobytes()
                kept = [b" ".join([raw[a:b] for a, b in zip(starts[i:j][keep[i:j]].tolist(), ends[i:j][keep[i:j]].tolist(), strict=True)]) for i, j in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
                removed = n - (held[first[1:]] - held[first[:-1]])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n), pa.array(removed), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return rows.join(spans.hint("merge"), "row", "left").select("doc_id", "text", "spans").mapInArrow(run, f"doc_id {id_type}, n_words long, n_removed long, kept string")


def repeat_report(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256."""
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 34], ' ') AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35) t),
o AS (SELECT win FROM g GROUP BY win HAVING count(*) > 1),
hit AS (SELECT doc_id, i FROM g SEMI JOIN o ON o.win = g.win),
x AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w),
c AS (SELECT x.doc_id, x.i, word, max(hit.i) OVER (PARTITION BY x.doc_id ORDER BY x.i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone FROM x LEFT JOIN hit ON hit.doc_id = x.doc_id AND hit.i = x.i),
k AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM c GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k ON k.doc_id = w.doc_id
"""
