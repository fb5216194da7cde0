"""N-gram Jaccard self-join with adaptive multi-match prefixes, and the groups it links.

A document is the set of its distinct n-word shingles (64-bit hashes of the lower-cased words).
Documents with the same set are one class, and classes are what is joined; they go back to the
rows at the end.  Two sets link when ``100 * intersection >= percent * union``.

* Prefix: of n shingles at most ``n - ceil(percent/100 * n)`` are missing from a partner, so one
  more than that many, in any common order (here by hash), must hold a shared one.
* Adaptive length: the sizes of the prefix lists are the candidate cost.  A document is given a
  prefix that is longer by the number of costly shingles in it and then needs as many matches
  more.  The costly ones can supply only so many of these, so one match at least is with a cheap
  shingle, and the costly lists are not joined at all.  Where the cheap ones that are left
  still add up to a high cost, the prefix grows by one more and two matches are needed.
* Where a document has fewer cheap shingles than the prefix needs, all links of it are with
  documents of the same sort, through costly shingles.  Those lists are searched from a pivot,
  then, while members are outside the pivot's component, from more of these as pivots, ``MORE``
  times as many in each round, until all were.
* Candidates go through an upper bound from 64-bin histograms of the sets, then the exact test.
  Copies in a group need no pair each: each document is first tested with its smallest
  partner, and then only pairs that are still in different components.

Every step is exact on 64-bit hashes of the shingles; thresholds steer cost alone.  The costs are
broadcast while they are few, and joined beyond ``COSTLY_MOST``; costly lists are dealt over
tasks by their length.

Null text counts as empty; a document without words has the empty set and links with nothing.  Rows that
repeat a doc_id are documents each, with the component of their own text; a null doc_id is never
the smallest, and alone gives a null component.  Very long texts are one set each.  An empty
table gives an empty one.  Other columns are not touched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywise.llm.common import lower_ascii, mix, slices, span_hashes, spare_name, split_join, utf8, words
from tallywise.llm.components import components
from tallywise.sources.staging import release, staged

#: Prefix lists longer than this are costly.
COSTLY = 50
#: The costs of shingles are broadcast up to this number (16 bytes each); beyond it they are joined.
COSTLY_MOST = 1 << 20
#: Lists from this length on count in the cost of a document; a cost above DEAR asks for two matches.
WARM, DEAR = 17, 200
#: Row ids of classes are broadcast up to this number (8 bytes each); beyond it they are joined.
IDS_MOST = 2_000_000
#: Cheap lists are joined in so many parts, to bound what is on disk at once.
PARTS = 2
#: Pivots of a costly list in a round by those of the round before.
MORE = 16
#: Members of a costly list that go to one task at least, however few there are in all.
LOT = 500

_MULTIPLIERS = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(text: pa.Array, ngram: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data, bounds = utf8(text)
    data = lower_ascii(data)
    starts, ends, first = words(data, bounds)
    h = span_hashes(data, starts, ends)
    sums = np.zeros(max(0, len(h) - ngram + 1), np.uint64)
    for j in range(ngram):
        sums += h[j : j + len(sums)] * _MULTIPLIERS[j]
    sums = mix(sums)
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= ngram:
            out.append(np.unique(sums[a : b - ngram + 1]))
        elif b > a:
            out.append(mix(np.sum(h[a:b] * _MULTIPLIERS[: b - a], keepdims=True) + np.uint64(b - a)))
        else:
            out.append(sums[:0])
    return out


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1 if n else 0


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    values = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)))


def _summaries(docs: DataFrame, ngram: int) -> DataFrame:
    """doc_id, text_hash, n, two digests of the set, histogram, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingle_sets(part.column("text"), ngram)
                n = [len(s) for s in sets]
                d1 = np.array([mix(s).sum(dtype=np.uint64) for s in sets], np.uint64)
                d2 = np.array([mix(s + np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) for s in sets], np.uint64)
                hist = [np.minimum(np.bincount((s >> np.uint64(58)).astype(np.int64), minlength=64), 65535).astype("<u2").tobytes() for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("text_hash"), pa.array(n, pa.int64()), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), pa.array(hist, pa.binary()), part.column("text")],
                    ["doc_id", "text_hash", "n", "d1", "d2", "hist", "text"],
                )

    return docs.mapInArrow(run, "doc_id long, text_hash long, n long, d1 long, d2 long, hist binary, text string")


def _prefixes(docs: DataFrame, ngram: int, percent: int) -> DataFrame:
    """(token): the plain prefixes of all classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                heads = [s[: prefix_length(len(s), percent)] for s in shingle_sets(part.column("text"), ngram)]
                tokens = np.concatenate(heads) if heads else np.zeros(0, np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64))], ["token"])

    return docs.mapInArrow(run, "token long")


def _costs(table: tuple[np.ndarray, np.ndarray], part: np.ndarray) -> np.ndarray:
    keys, cost = table
    if not len(keys):
        return np.zeros(len(part), np.int64)
    at = np.minimum(np.searchsorted(keys, part), len(keys) - 1)
    return np.where(keys[at] == part, cost[at], 0)


def _sorted_table(*parts: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Sorted shingles with the largest count that any part has."""
    tokens = np.concatenate([p.column("token").to_numpy().view(np.uint64) for p in parts])
    counts = np.concatenate([p.column("count").to_numpy() for p in parts])
    order = np.lexsort((-counts, tokens))
    tokens, first = np.unique(tokens[order], return_index=True)
    return tokens, counts[order][first]


def _costly_sets(docs: DataFrame, ngram: int, percent: int, table: tuple[np.ndarray, np.ndarray], costly: int) -> DataFrame:
    """(token): whole sets of the documents of whose prefix a fifth or more is costly."""
    known = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                kept = [np.zeros(0, np.uint64)]
                for s in shingle_sets(part.column("text"), ngram):
                    p = prefix_length(len(s), percent)
                    if p and 5 * (_costs(known.value, s[:p]) > costly).sum() >= p:
                        kept.append(s)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(kept).view(np.int64))], ["token"])

    return docs.mapInArrow(run, "token long")


_INDEX = "id long, n long, cheap array<long>, dear array<long>, need int, h long"


def _chosen(ids: list[int], sizes: list[int], heads: list[np.ndarray], costs: list[np.ndarray], percent: int, costly: int) -> pa.RecordBatch:
    """The lengthened prefixes: cheap and costly shingles, and the matches that are needed; see ``_adapted``."""
    cheap, dear, need, h = [], [], [], []
    for n, head, cost in zip(sizes, heads, costs, strict=True):
        p, hot = prefix_length(n, percent), cost > costly
        light = head[~hot]
        two = cost[~hot][:p].sum() > DEAR and len(light) > p
        cheap.append(light[: p + two])
        dear.append(head[hot][: max(0, p - len(light))])
        need.append(1 + two)
        h.append(n - len(light) if len(light) < p else 0)
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), _lists(cheap), _lists(dear), pa.array(np.array(need, np.int32)), pa.array(h, pa.int64())], ["id", "n", "cheap", "dear", "need", "h"])


def _adapted(docs: DataFrame, ngram: int, percent: int, costs: tuple[np.ndarray, np.ndarray], costly: int) -> DataFrame:
    """The prefixes, lengthened by the cost table: cheap and costly shingles, and the matches that are needed.

    ``h`` counts the costly shingles of those that have too few others.
    """
    table = docs.sparkSession.sparkContext.broadcast(costs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets, heads, found = shingle_sets(part.column("text"), ngram), [], []
                for s in sets:
                    p = prefix_length(len(s), percent)
                    head = s[: 2 * p + 64]
                    cost = _costs(table.value, head)
                    if (cost <= costly).sum() <= p and len(head) < len(s):
                        head, cost = s, _costs(table.value, s)
                    heads.append(head)
                    found.append(cost)
                yield _chosen(part.column("id").to_pylist(), [len(s) for s in sets], heads, found, percent, costly)

    return docs.mapInArrow(run, _INDEX)


def _adapted_by_join(docs: DataFrame, ngram: int, percent: int, costly: int) -> DataFrame:
    """As ``_adapted``, where too many shingles have a cost for a broadcast: their counts over whole sets are joined.

    Heads of the sets first, then whole sets of those that hold too few cheap ones.
    """

    def tokens(whole: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, "text"):
                    sets = shingle_sets(part.column("text"), ngram)
                    heads = sets if whole else [s[: 2 * prefix_length(len(s), percent) + 64] for s in sets]
                    size = [len(x) for x in heads]
                    columns = [np.repeat(part.column("id").to_numpy(), size), np.repeat([len(s) for s in sets], size), np.concatenate([np.zeros(0, np.uint64), *heads]).view(np.int64)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["id", "n", "token"])

        return run

    schema = "id long, n long, token long"
    every = docs.mapInArrow(tokens(True), schema)
    counts = staged(every.groupBy("token").agg(F.count(F.lit(1)).alias("cost")).filter(F.col("cost") >= min(WARM, costly)))
    most = docs.count()
    signed = F.col("token").bitwiseXOR(F.lit(-(1 << 63)))  # sorts as unsigned

    def weighed(rows: DataFrame) -> DataFrame:
        costs = split_join(rows, counts, ["token"], "cost", most, left=True).select("id", "n", F.struct(signed.alias("order"), F.coalesce("cost", F.lit(0)).alias("cost")).alias("t"))
        lists = costs.groupBy("id").agg(F.first("n").alias("n"), F.sort_array(F.collect_list("t")).alias("t"))
        return lists.select("id", "n", F.transform("t", lambda t: t["order"].bitwiseXOR(F.lit(-(1 << 63)))).alias("head"), F.transform("t", lambda t: t["cost"]).alias("cost"))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [[np.array(x, np.int64) for x in batch.column(c).to_pylist()] for c in ("head", "cost")]
            yield _chosen(batch.column("id").to_pylist(), batch.column("n").to_pylist(), [x.view(np.uint64) for x in lists[0]], lists[1], percent, costly)

    heads = staged(weighed(docs.mapInArrow(tokens(False), schema)))
    p = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    short = (F.size(F.filter("cost", lambda c: c <= costly)) <= p) & (F.size("head") < F.col("n"))
    again = docs.join(heads.filter(short).select("id").hint("merge"), "id", "left_semi").mapInArrow(tokens(True), schema)
    return heads.filter(~short).mapInArrow(choose, _INDEX).unionByName(weighed(again).mapInArrow(choose, _INDEX))


def _bounded(pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs whose histograms leave room for the intersection that a link needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ha, hb = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(-1, 64).astype(np.int64) for c in ("ha", "hb"))
            na, nb = (batch.column(c).to_numpy() for c in ("na", "nb"))
            room = np.minimum(ha, hb).sum(1)
            keep = (100 * room >= percent * (na + nb - room)) | (ha.max(1) >= 65535) | (hb.max(1) >= 65535)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return pairs.mapInArrow(run, "a long, b long")


def _linked(pairs: DataFrame, docs: DataFrame, ngram: int, percent: int) -> DataFrame:
    """The pairs (a, b) that pass the exact test, from the texts of the classes (id, text).

    The text of b is joined to the pair where it is read, and meets that of a by one shuffle; texts take less room in it than
    their sets.  Pairs come sorted by a, so the set of a is made once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, x = None, None
        for batch in batches:
            for part in slices(batch, "tb"):
                a, keep = part.column("a").to_pylist(), []
                for i, y in enumerate(shingle_sets(part.column("tb"), ngram)):
                    if a[i] != last:
                        last, x = a[i], shingle_sets(part.column("ta").slice(i, 1), ngram)[0]
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(100 * both >= percent * (len(x) + len(y) - both))
                yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    pairs = staged(pairs)
    firsts = staged(pairs.select("a").distinct())
    few = pairs.count() <= IDS_MOST
    side = lambda df: F.broadcast(df) if few else df.hint("merge")
    ta = docs.select(F.col("id").alias("a"), F.col("text").alias("ta")).join(side(firsts), "a", "left_semi")
    tb = docs.select(F.col("id").alias("b"), F.col("text").alias("tb")).join(side(pairs), "b")
    out = staged(ta.hint("shuffle_merge").join(tb.hint("shuffle_merge"), "a").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long"))
    release(pairs, firsts)
    return out


def _apart(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs whose ends are in different components."""
    ca = found.select(F.col("node").alias("a"), F.col("component").alias("ca")).hint("merge")
    cb = found.select(F.col("node").alias("b"), F.col("component").alias("cb")).hint("merge")
    ends = pairs.join(ca, "a", "left").join(cb, "b", "left")
    return ends.filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")


def _met_in_lists(pivots: DataFrame, members: DataFrame, lot: int) -> DataFrame:
    """Pairs of a pivot and a member of its list (token, size), which is dealt over a task for every ``lot`` members; pivots go to all of them."""
    lots = F.ceil(F.col("size") / lot).cast("int")
    dealt = members.withColumn("salt", F.pmod(F.xxhash64("b"), lots).cast("int")).drop("size")
    copies = pivots.withColumn("salt", F.explode(F.sequence(F.lit(0), lots - 1))).drop("size")
    return copies.hint("shuffle_merge").join(dealt.hint("shuffle_merge"), ["token", "salt"])


def _costly_links(dear: DataFrame, found: DataFrame, links: DataFrame, docs: DataFrame, ngram: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """More links and components, from pairs that share costly shingles alone.

    The first pivot of a list is compared with all members.  Every member that is not in its component when its turn comes
    is compared with all members of other components, MORE times as many in each round as before; so of two members one
    has met the other, or both are in the first pivot's component.
    """
    room = F.least("ha", "hb")
    fits = (room * 100 >= (F.col("na") + F.col("nb") - room) * percent) & (F.col("ca") != F.col("cb"))
    side = lambda rows, x: rows.select("token", "size", F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("h").alias(f"h{x}"), F.col("component").alias(f"c{x}"))
    total = dear.count()
    lot = max(LOT, total // (4 * max(1, int(dear.sparkSession.conf.get("spark.sql.shuffle.partitions")))))
    # the member with the fewest shingles of its own begins
    lead = staged(dear.groupBy("token").agg(F.min_by("id", F.struct(F.col("n") - F.col("h"), "id")).alias("lead"), F.count(F.lit(1)).alias("size")))
    share = (F.pmod(F.xxhash64("id"), F.lit(1 << 40)) + 1) / float(1 << 40)
    done, until = -1.0, 0.0
    while True:
        place = staged(found.select(F.col("node").alias("id"), "component"))
        centre = staged(lead.join(place.withColumnRenamed("id", "lead").hint("merge"), "lead", "left").select("token", "lead", "size", F.coalesce("component", "lead").alias("centre")))
        turn = F.when(F.col("id") == F.col("lead"), 0.0).otherwise(share * F.col("size"))
        members = split_join(dear, centre, ["token"], "size", total).withColumn("turn", turn)
        placed = staged(members.join(place.hint("merge"), "id", "left").withColumn("component", F.coalesce("component", "id")))
        open_ = placed.filter((F.col("turn") > done) & ((F.col("component") != F.col("centre")) | (F.col("turn") == 0)))
        if open_.isEmpty():
            break
        pivots = open_.filter(F.col("turn") <= until)
        pairs = staged(_met_in_lists(side(pivots, "a"), side(placed, "b"), lot).filter(fits).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        new = _linked(pairs, docs, ngram, percent)
        if not new.isEmpty():
            links = links.unionByName(new)
            found = components(links)
        release(pairs, placed, centre, place)
        done, until = until, max(1.0, until) * MORE
    release(placed, centre, place, lead)
    return links, found


def grouped(docs: DataFrame, ngram: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", costly: int = COSTLY) -> DataFrame:
    """One row per document: doc_id, text_hash, n, group (null without words), component_id."""
    text = F.col(text_col).cast("string")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_hash"), text.alias("text"))
    every = staged(_summaries(docs, ngram).withColumn("row", F.monotonically_increasing_id()), "zstd")
    classes = staged(every.filter("n > 0").groupBy("n", "d1", "d2").agg(F.min("row").alias("id"), F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("times")))
    total, most = every.count(), classes.count()
    own = classes.select(F.col("id").alias("row"))
    own = F.broadcast(own) if most <= IDS_MOST else own.hint("merge")
    one = every.join(own, "row", "left_semi")
    reps = one.select(F.col("row").alias("id"), "text")
    if most > IDS_MOST:
        reps = staged(reps)

    least = min(WARM, costly)
    table = staged(_prefixes(reps, ngram, percent).groupBy("token").count().filter(F.col("count") >= least))
    few = table.count() <= COSTLY_MOST
    if few:
        counts = table.toArrow()
        costs = _sorted_table(counts)
        if counts.num_rows:
            often = staged(_costly_sets(reps, ngram, percent, costs, costly).groupBy("token").count().filter(F.col("count") > costly))
            few = often.count() <= COSTLY_MOST
            if few:
                costs = _sorted_table(counts, often.toArrow())
            release(often)
    release(table)
    index = staged(_adapted(reps, ngram, percent, costs, costly) if few else _adapted_by_join(reps, ngram, percent, costly))
    while few:
        # shingles behind the plain prefixes may be common where prefixes were lengthened; then these count as costly too
        again = staged(index.select(F.explode("cheap").alias("token")).groupBy("token").count().filter(F.col("count") > 4 * max(costly, least)))
        more = again.count()
        if not more:
            break
        release(index)
        few = more + len(costs[0]) <= COSTLY_MOST
        if few:
            costs = _sorted_table(pa.table({"token": costs[0].view(np.int64), "count": costs[1]}), again.toArrow())
        index = staged(_adapted(reps, ngram, percent, costs, costly) if few else _adapted_by_join(reps, ngram, percent, costly))
        release(again)
    near = (F.col("a.n") * 100 >= F.col("b.n") * percent) & (F.col("b.n") * 100 >= F.col("a.n") * percent)
    h = one.select(F.col("row").alias("id"), "hist")
    met = None
    for i in range(PARTS):
        # both sides are one exchange, as they are the same rows
        cheap = index.select(F.explode("cheap").alias("token"), "id", "n", "need").filter(F.pmod(F.xxhash64("token"), F.lit(PARTS)) == i)
        cheap = cheap.repartition("token")
        part = cheap.alias("a").hint("merge").join(cheap.alias("b").hint("merge"), "token").filter(F.col("a.id") < F.col("b.id")).filter(near)
        part = part.groupBy(F.col("a.id").alias("a"), F.col("b.id").alias("b"), F.col("a.n").alias("na"), F.col("b.n").alias("nb"), F.least("a.need", "b.need").alias("need")).count()
        part = staged(part)
        met = part if met is None else met.unionByName(part)
    met = met.groupBy("a", "b", "na", "nb", "need").agg(F.sum("count").alias("count")).filter(F.col("count") >= F.col("need"))
    shaped = met.join(h.select(F.col("id").alias("a"), F.col("hist").alias("ha")).hint("shuffle_merge"), "a").join(h.select(F.col("id").alias("b"), F.col("hist").alias("hb")).hint("shuffle_merge"), "b")
    pairs = staged(_bounded(shaped.select("a", "b", "na", "nb", "ha", "hb"), percent))

    dear = staged(index.filter("size(dear) > 0").select(F.explode("dear").alias("token"), "id", "n", "h"))
    release(index)
    tries = staged(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"))
    links = _linked(tries, reps, ngram, percent)
    found = components(links)
    left = _apart(pairs, found).join(tries.hint("merge"), ["a", "b"], "left_anti")
    links = links.unionByName(_linked(left, reps, ngram, percent))
    found = components(links)
    if not dear.isEmpty():
        links, found = _costly_links(dear, found, links, reps, ngram, percent)
    release(dear, pairs, tries)

    node = classes.join(found.select(F.col("node").alias("id"), "component").hint("merge"), "id", "left").withColumn("group", F.coalesce("component", "id")).drop("component")
    node = staged(node)
    smallest = staged(node.groupBy("group").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("classes")))
    label = split_join(node.select("n", "d1", "d2", "times", "group"), smallest, ["group"], "classes", most)
    label = staged(label.select("n", "d1", "d2", "times", "group", "component_id"))
    rows = every.select("doc_id", "text_hash", "n", "d1", "d2")
    with_words = split_join(rows.filter("n > 0"), label, ["n", "d1", "d2"], "times", total)
    out = ["doc_id", "text_hash", "n", "group", "component_id"]
    without = rows.filter("n = 0").select("doc_id", "text_hash", "n", F.lit(None).cast("long").alias("group"), F.col("doc_id").alias("component_id"))
    return with_words.select(*out).unionByName(without)


def jaccard_groups(docs: DataFrame, ngram: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", costly: int = COSTLY) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest doc_id it reaches by links)."""
    return grouped(docs, ngram, percent, id_col, text_col, costly).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def drop_near_copies(docs: DataFrame, ngram: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each group: that with the smallest id (null last), of repeated ids by text hash.

    Documents without words are in no group and stay.
    """
    rows = staged(grouped(docs, ngram, percent, id_col, text_col).filter("group IS NOT NULL"))
    best = staged(rows.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("best"), F.count(F.lit(1)).alias("times")).filter("times > 1"))
    other = ~(F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("text_hash") == F.col("best.text_hash")))
    members = split_join(rows, best, ["group"], "times", rows.count())
    gone = staged(members.filter(other).select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct())
    mark = F.xxhash64(F.coalesce(docs[text_col].cast("string"), F.lit("")))
    side = F.broadcast(gone) if gone.count() <= IDS_MOST else gone.hint("merge")
    left = docs.join(side, docs[id_col].cast("long").eqNullSafe(gone["__id"]) & (mark == gone["__hash"]), "left_anti")
    # of rows that repeat id and text one stays
    twice = rows.groupBy("doc_id", "text_hash").count().filter("count > 1")
    if twice.isEmpty():
        return left
    hashed, worded = spare_name(docs, "text_hash"), F.regexp_like(F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]"))
    return left.filter(worded).withColumn(hashed, F.xxhash64(text_col)).dropDuplicates([id_col, hashed]).drop(hashed).unionByName(left.filter(~worded))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
sh AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])
                                      WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * i >= 90 * (nx.n + ny.n - i)),
r(x, y) AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(m.y, d.doc_id)) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT x, min(y) AS y FROM r GROUP BY x) m ON m.x = d.doc_id
"""
