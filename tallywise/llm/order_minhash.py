"""Order MinHash fingerprints, in DataFrame functions only.

Each k-mer of words is numbered among its equals, so that repeats count.  Every (k-mer, number)
pair has one 64-bit hash, a point on a circle.  ``2 ** bin_bits`` evenly spaced starts each select
the next ``length`` points; these are put back in text order, and that tuple is hashed.  For
each start this is the selection by a random order of its own, also in texts with fewer k-mers
than starts: two texts agree at a start only if they select the same k-mers in the same order, so
the share of agreeing starts falls with the edit distance, not only with the word overlap.

A fingerprint is the list of tuple hashes by start, as text 8 hex digits each.  Likeness is the share
of equal entries; texts without words have empty fingerprints, which are alike, and unlike any
other.  Null counts as empty.  Fewer words than k are one k-mer; fewer k-mers than ``length`` are
selected all.  A text is sorted once; hashes take 38 bits, positions 26 (beyond 67 million words
they start again from 0, which can only blur the order of k-mers so far apart).

Documents are taken in descending order of doc_id (null last), of repeated ids by text hash.  Every
row gives a row: after a row that repeats doc_id and text comes its repetition.  Very long texts are one
array each; an empty table gives an empty one; other columns stay behind.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywise.llm.common import spare_name
from tallywise.sources.staging import staged


#: 2 ** BIN_BITS starts.
BIN_BITS, LENGTH, K = 5, 2, 3
_POSITION_BITS = 26
_POSITION = (1 << _POSITION_BITS) - 1


def _high(x: Column) -> Column:
    return F.shiftright(x, _POSITION_BITS)


def _packed(h: Column, position: Column) -> Column:
    return F.shiftleft(_high(h), _POSITION_BITS).bitwiseOR(F.lit(_POSITION).bitwiseAND(position))


def _runs(array: Column, same: Callable[[Column, Column], Column], make: Callable[[Column], Column]) -> Column:
    """``make`` of each maximal run of neighbours of ``array`` that are the same."""
    starts = F.filter(F.transform(array, lambda x, i: F.when((i == 0) | ~same(F.get(array, i - 1), x), i).otherwise(-1)), lambda i: i >= 0)
    following = F.concat(F.slice(starts, 2, F.greatest(F.size(starts) - 1, F.lit(0))), F.array(F.size(array)))
    return F.transform(F.arrays_zip(starts.alias("s"), following.alias("e")), lambda z: make(F.slice(array, z["s"] + 1, z["e"] - z["s"])))


def with_fingerprint(rows: DataFrame, text: Column, name: str, k: int = K, length: int = LENGTH, bin_bits: int = BIN_BITS) -> DataFrame:
    """``rows`` with the fingerprint of ``text`` as an array of longs, start << 32 | tuple hash.

    One column a step, since arrays between columns stay primitive where those within a lambda would be boxed.
    """
    starts = 1 << bin_bits
    step = spare_name(rows, "fp_step")
    s = F.col(step)
    words = F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")
    rows = rows.withColumn(step, F.transform(words, lambda w: F.xxhash64(w)))
    kmers = F.transform(s, lambda x, i: _packed(F.xxhash64(x, *[F.get(s, i + j) for j in range(1, k)]), i.cast("long")))
    rows = rows.withColumn(step, F.sort_array(F.slice(kmers, 1, F.greatest(F.size(s) - (k - 1), F.least(F.size(s), F.lit(1))))))
    # positions in the sorted list of k-mers that equal the one before
    again, a = spare_name(rows, "fp_again"), F.col(spare_name(rows, "fp_again"))
    rows = rows.withColumn(again, F.filter(F.transform(s, lambda x, i: F.when((i > 0) & (_high(x) == _high(F.get(s, i - 1))), i).otherwise(-1)), lambda i: i >= 0))
    first = F.filter(s, lambda x, i: (i == 0) | (_high(x) != _high(F.get(s, i - 1))))
    later = F.flatten(_runs(a, lambda x, y: y == x + 1, lambda run: F.transform(run, lambda at, o: _packed(F.xxhash64(_high(F.get(s, at)), o + 1), F.get(s, at)))))
    rows = rows.withColumn(step, F.when(F.size(a) == 0, s).otherwise(F.sort_array(F.concat(first, later)))).drop(again)
    # the first points from each start; the arcs between starts are numbered in the order of signed hashes
    arc = lambda x: F.shiftright(x, 64 - bin_bits) + (starts >> 1)
    rows = rows.withColumn(step, F.filter(s, lambda x, j: (j < length) | (arc(x) != arc(F.get(s, j - length)))))
    circle, c = spare_name(rows, "fp_circle"), F.col(spare_name(rows, "fp_circle"))
    rows = rows.withColumn(circle, F.concat(s, F.slice(s, 1, length)))
    turned = lambda x: F.shiftleft(x.bitwiseAND(F.lit(_POSITION)), 37).bitwiseOR(F.shiftrightunsigned(x, 27))
    chosen = lambda i: F.slice(c, i + 1, F.least(F.lit(length), F.size(s)))
    in_order = lambda i: F.transform(F.sort_array(F.transform(chosen(i), turned)), lambda y: y.bitwiseAND(F.lit((1 << 37) - 1)))
    tuple_hash = lambda i: F.xxhash64(in_order(i)).bitwiseAND(F.lit(0xFFFFFFFF))
    # the arcs from which the points of each filled arc are the next: those after the filled arc before
    entry = lambda x, i: F.when(i == 0, F.struct(F.lit(-1).cast("long").alias("before"), arc(x).alias("arc"), tuple_hash(i).alias("h"))).when(arc(x) != arc(F.get(s, i - 1)), F.struct(arc(F.get(s, i - 1)).alias("before"), arc(x).alias("arc"), tuple_hash(i).alias("h")))
    rows = rows.withColumn(circle, F.filter(F.transform(s, entry), lambda e: e.isNotNull()))
    each = F.flatten(F.transform(c, lambda e: F.array_repeat(e["h"], (e["arc"] - e["before"]).cast("int"))))
    rest = F.array_repeat(F.get(c, F.lit(0))["h"], (F.lit(starts - 1) - F.get(c, F.size(c) - 1)["arc"]).cast("int"))
    rows = rows.withColumn(circle, F.concat(each, F.coalesce(rest, F.array().cast("array<bigint>"))))
    return rows.withColumn(name, F.transform(c, lambda h, b: F.shiftleft(b.cast("long"), 32).bitwiseOR(h))).drop(step, circle)


def likeness(a: Column, b: Column) -> Column:
    """Share of the starts that agree; 1 for two empty fingerprints."""
    most = F.greatest(F.size(a), F.size(b))
    return F.when(most == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / most)


def as_text(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda v: F.lpad(F.lower(F.hex(v.bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")), "")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """doc_id, text_hash, n_chars, fp (array of longs) for each row; other columns stay behind."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.length(text).cast("long").alias("n_chars"), text.alias("text"))
    return with_fingerprint(rows, F.col("text"), "fp", **params).drop("text")


def with_next(rows: DataFrame, parts: int) -> DataFrame:
    """Each row with the next in descending (doc_id, text_hash): columns next_*; after the last comes the first.

    Rows are dealt by range, so no task sees more than its range; the ends of the ranges meet in
    a table of one row a range.
    """
    order = [F.col("doc_id").desc_nulls_last(), F.col("text_hash").desc()]
    dealt = staged(rows.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()))
    inside = Window.partitionBy("part").orderBy(*order)
    columns = [c for c in rows.columns]
    here = F.struct(*columns)
    heads = dealt.groupBy("part").agg(F.max(F.struct(F.struct("doc_id", "text_hash").alias("key"), here.alias("row")))["row"].alias("head"))
    ends = Window.orderBy("part")
    after = heads.select("part", F.coalesce(F.lead("head").over(ends), F.first("head").over(ends.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("head"))
    led = dealt.withColumn("lead", F.lead(here).over(inside)).join(F.broadcast(after), "part")
    nxt = F.coalesce("lead", "head")
    return led.select(*columns, *[nxt[c].alias(f"next_{c}") for c in columns])


def edited_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """Fingerprints of every text and of its edited form, and how alike they and the next text are.

    The edited form has the last floor(n_chars / 3) code points replaced by as many from the start of the next document.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    rows = staged(fingerprints(docs, **params))
    key, next_key = ["doc_id", "text_hash"], ["next_doc_id", "next_text_hash"]
    repeated = staged(rows.groupBy(*key).agg(F.count(F.lit(1)).alias("times")).filter("times > 1"))
    repeats = not repeated.isEmpty()
    single = rows.dropDuplicates(key) if repeats else rows
    parts = max(2, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ring = staged(with_next(single, parts))
    # what each document gives to the one before it: so many of its first code points
    gives = ring.select(*[F.col(n).alias(k) for k, n in zip(key, next_key, strict=True)], F.floor(F.col("n_chars") / 3).alias("n_given"), *[F.col(k).alias(f"to_{k}") for k in key])
    texts = docs.select(*key, "text")
    if repeats:
        texts = texts.dropDuplicates(key)
    same = lambda a, b, left, right: [a[x].eqNullSafe(b[y]) for x, y in zip(left, right, strict=True)]
    met = texts.join(gives.hint("merge"), same(texts, gives, key, key))
    given = met.select("to_doc_id", "to_text_hash", F.expr("substring(text, 1, int(n_given))").alias("given"))
    own = texts.join(ring.hint("merge"), same(texts, ring, key, key)).select(*[ring[c] for c in ring.columns], "text")
    joined = own.join(given.hint("merge"), same(own, given, key, ["to_doc_id", "to_text_hash"]))
    head = F.expr("substring(text, 1, int(n_chars - floor(n_chars / 3)))")
    edited = joined.select("doc_id", "n_chars", "fp", "next_fp", F.concat(head, "given").alias("edited"))
    if repeats:
        # the next of a repeated row is the same text
        own = own.join(repeated.hint("merge"), same(own, repeated, key, key)).select(*[own[c] for c in own.columns], "times")
        copy = F.explode(F.sequence(F.lit(2).cast("long"), "times")).alias("copy")
        twice = own.select("doc_id", "n_chars", "fp", F.col("fp").alias("next_fp"), F.concat(head, F.expr("substring(text, 1, int(floor(n_chars / 3)))")).alias("edited"), copy)
        edited = edited.unionByName(twice.drop("copy"))
    out = with_fingerprint(edited, F.col("edited"), "efp", **params)
    digest = F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256")
    return out.select("doc_id", "n_chars", digest, as_text(F.col("fp")).alias("fingerprint"), as_text(F.col("efp")).alias("edited_fingerprint"), likeness(F.col("fp"), F.col("efp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"))
