"""Mixing sources to target weights, in DataFrame functions only.

Capped water-filling gives each source its share of all words, clamps sources at
``max_epochs`` times their size, and reshares the excess by weight among the others until none
is above.  In closed form: in order of cap per weight, a source is clamped while its cap is
below its share of what the clamped ones before it leave.

A source whose target is r times its size is taken floor(r) times whole; the rest is a seeded
sample of its documents: in the order of a hash of seed, doc_id and text, as many as fit into the word
count that remains; then, of the others from long to short, one of each length that still fits; then the one,
if any, that comes nearest to what is left.  The running sums are taken within 4096 hash buckets per source over the sums of earlier buckets; only
the one bucket in which the rest ends is sorted, so no source is sorted in one task.

Null text counts as no words, a null source is a source of its own (the last).  Documents without words
are taken as often as their source is taken whole.  Rows that repeat a doc_id are documents of their
own.  Empty tables, or tables without words, take nothing.  The windows over sources hold one row
a source.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallywise.llm.common import spare_name
from tallywise.sources.staging import staged


#: Rows picked out of a source (documents of one bucket, one document each) are broadcast up to this number.
MOST_FEW = 1_000_000
#: A word, as the contract states it.
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, weights: Sequence[int], max_epochs: int) -> DataFrame:
    """``sizes`` (source, source_size) with the target of each source in words.

    The windows here run over one row per source, not over documents.
    """
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    all_rows = Window.partitionBy()
    t = (
        sizes.withColumn("rank", F.row_number().over(in_order) - 1)
        .withColumn("weight", weight.cast("long"))
        .withColumn("cap", F.col("source_size") * max_epochs)
        .withColumn("total", F.sum("source_size").over(all_rows))
        .withColumn("capped_before", F.coalesce(F.sum("cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("weight_left", F.sum("weight").over(by_cap.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("clamped", F.col("cap") * F.col("weight_left") < (F.col("total") - F.col("capped_before")) * F.col("weight"))
        .withColumn("clamped_sum", F.sum(F.when(F.col("clamped"), F.col("cap")).otherwise(0)).over(all_rows))
        .withColumn("free_weight", F.sum(F.when(F.col("clamped"), 0).otherwise(F.col("weight"))).over(all_rows))
    )
    share = ((F.col("total") - F.col("clamped_sum")) * F.col("weight")).cast("double") / F.col("free_weight").cast("double")
    return t.select("source", "source_size", F.when(F.col("clamped"), F.col("cap").cast("double")).otherwise(share).alias("target"))


def mix_sources(
    docs: DataFrame, weights: Sequence[int] = (1, 2, 3), max_epochs: int = 3, seed: str = "mix-1", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, copies."""
    return _mixed(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(source_col).alias("source"), F.lit(0).cast("long").alias("key")), weights, max_epochs, seed).drop("key")


def _mixed(docs: DataFrame, weights: Sequence[int], max_epochs: int, seed: str) -> DataFrame:
    """``mix_sources`` of (doc_id, text, source, key), with the key."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    order = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.encode(text, "UTF-8"))))
    size = F.regexp_count(text, F.lit(WORD)).cast("long")
    sized = docs.select("doc_id", "key", F.col("source").cast("string").alias("source"), size.alias("size"), order.alias("order"))
    sized = staged(sized.withColumn("bucket", F.substring("order", 1, 3)).withColumn("row", F.monotonically_increasing_id()))
    buckets = staged(sized.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size")))
    targets = source_targets(buckets.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    b = buckets.withColumn("before", F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0))).alias("b")
    t = targets.alias("t").hint("merge")
    plan = staged(
        b.join(t, F.col("b.source").eqNullSafe(F.col("t.source")))
        .select("b.source", "bucket", "bucket_size", "before", "source_size", "target", whole.alias("whole"))
        .withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    )
    at = lambda x, y: F.col(f"{x}.source").eqNullSafe(F.col(f"{y}.source")) & (F.col(f"{x}.bucket") == F.col(f"{y}.bucket"))
    # the bucket in which the rest ends: the documents that still fit
    ends = plan.filter("before <= rest AND rest < before + bucket_size")
    inside = Window.partitionBy("s.source", "s.bucket").orderBy("order", "doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.col("before") + F.sum("size").over(inside)
    cut = sized.alias("s").join(ends.alias("e").hint("merge"), at("s", "e")).select("row", "e.source", "size", "before", "rest", upto.alias("upto"))
    cut = staged(cut.withColumn("fits", (F.col("upto") <= F.col("rest")) & (F.col("size") > 0)))
    left = cut.groupBy("source").agg(F.min(F.col("rest") - F.greatest(F.col("before"), F.when(F.col("fits"), F.col("upto")).otherwise(F.col("before")))).alias("left"))
    # the one other document that comes nearest to what is left
    cuts = staged(ends.select("source", "bucket").withColumn("end", F.lit(True)).alias("e").join(left.alias("l").hint("merge"), F.col("e.source").eqNullSafe(F.col("l.source"))).select("e.source", F.col("bucket").alias("last"), "left"))
    p = plan.alias("p").join(cuts.alias("c").hint("merge"), F.col("p.source").eqNullSafe(F.col("c.source")), "left").select("p.*", "last", "left").withColumn("in_full", F.col("before") + F.col("bucket_size") <= F.col("rest"))
    fitting = cut.filter("fits").select(F.col("row").alias("fit_row"))
    rows = sized.alias("s").join(p.alias("p").hint("merge"), at("s", "p")).select("row", "doc_id", "key", "s.source", "size", "order", "source_size", "target", "whole", "left", "in_full", "last", "s.bucket")
    rows = rows.join(F.broadcast(fitting) if fitting.count() <= MOST_FEW else fitting.hint("merge"), F.col("row") == F.col("fit_row"), "left")
    rows = staged(rows.withColumn("in_rest", (F.col("size") > 0) & (F.col("in_full") | F.col("fit_row").isNotNull())))
    by_source = lambda found: found["source"].eqNullSafe(F.col("s.source"))
    few = lambda found: F.broadcast(found) if found.count() <= MOST_FEW else found.hint("merge")
    tie = ["order", "doc_id", "row"]
    open_ = rows.filter(~F.col("in_rest") & (F.col("size") > 0) & F.col("left").isNotNull())
    # lengths that fit are fewer than the words of one document, so each source's are one array
    fill = open_.filter(F.col("size") <= F.col("left")).groupBy("source", "size").agg(F.min(F.struct(*tie))["row"].alias("r"), F.first("left").alias("left"))
    fill = fill.groupBy("source").agg(F.first("left").alias("left"), F.sort_array(F.collect_list(F.struct("size", "r")), asc=False).alias("lengths"))
    start = F.struct(F.col("left").alias("goal"), F.array().cast("array<bigint>").alias("taken"))
    take = lambda acc, x: F.when(x["size"] <= acc["goal"], F.struct((acc["goal"] - x["size"]).alias("goal"), F.concat(acc["taken"], F.array(x["r"])).alias("taken"))).otherwise(acc)
    fill = staged(fill.select("source", F.aggregate("lengths", start, take).alias("f")).select("source", "f.goal", "f.taken"))
    filled = staged(fill.select(F.explode("taken").alias("fill_row")))
    then = open_.join(few(filled), F.col("row") == F.col("fill_row"), "left_anti").alias("s")
    then = then.join(few(fill.select("source", F.col("goal").alias("now"))), by_source(fill), "left").select("s.*", F.coalesce("now", "left").alias("goal"))
    off = F.abs(F.col("size") - F.col("goal"))
    nearest = then.filter(off < F.col("goal")).groupBy("source").agg(F.min(F.struct(off.alias("off"), *tie))["row"].alias("more"))
    more = staged(filled.select(F.col("fill_row").alias("more")).unionByName(nearest.select("more")))
    out = rows.join(few(more), F.col("row") == F.col("more"), "left")
    copies = F.col("whole") + (F.col("in_rest") | F.col("more").isNotNull()).cast("long")
    return out.withColumn("copies", copies).select("doc_id", "key", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def mixed_documents(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), max_epochs: int = 3, seed: str = "mix-1", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` as the mix takes them: each row as many times as it has copies.

    Rows that are equal in all columns share their copies.
    """
    key, times, one = (spare_name(docs, n) for n in ("row_hash", "copies", "copy"))
    marked = docs.withColumn(key, F.xxhash64(*docs.columns))
    mixed = _mixed(marked.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(source_col).alias("source"), F.col(key).alias("key")), weights, max_epochs, seed)
    copies = staged(mixed.groupBy(F.col("key").alias(key)).agg(F.sum("copies").cast("int").alias(times), F.count(F.lit(1)).alias("n_equal")))
    if not copies.filter("n_equal > 1").isEmpty():
        marked = marked.dropDuplicates([key])
    joined = marked.join(copies.filter(F.col(times) > 0).drop("n_equal").hint("merge"), key)
    return joined.select(*docs.columns, F.explode(F.array_repeat(F.lit(0), F.col(times))).alias(one)).drop(one)


ORACLE = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS k
  FROM documents),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, CAST(1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS BIGINT) AS weight,
                  row_number() OVER (ORDER BY source NULLS LAST) AS r, 3 * source_size AS cap,
                  CAST(sum(source_size) OVER () AS BIGINT) AS total FROM src),
run AS (SELECT *, CAST(coalesce(sum(cap) OVER (ORDER BY cap / weight, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS c,
               CAST(sum(weight) OVER (ORDER BY cap / weight, r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS w FROM ranked),
cl AS (SELECT *, cap * w < (total - c) * weight AS clamped FROM run),
agg AS (SELECT *, CAST(sum(CASE WHEN clamped THEN cap ELSE 0 END) OVER () AS BIGINT) AS cs,
               CAST(sum(CASE WHEN clamped THEN 0 ELSE weight END) OVER () AS BIGINT) AS fw FROM cl),
tg AS (SELECT source, source_size, CASE WHEN clamped THEN CAST(cap AS DOUBLE)
              ELSE CAST((total - cs) * weight AS DOUBLE) / CAST(fw AS DOUBLE) END AS target FROM agg),
pl AS (SELECT *, CAST(CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS BIGINT) AS whole FROM tg),
cum AS (SELECT s.doc_id, s.source, s.size, s.k, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size AS rest,
               sum(s.size) OVER (PARTITION BY s.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
        FROM sized s JOIN pl p ON s.source IS NOT DISTINCT FROM p.source),
fit AS (SELECT *, size > 0 AND upto <= rest AS fits FROM cum),
lf AS (SELECT *, rest - CAST(coalesce(sum(CASE WHEN fits THEN size END) OVER (PARTITION BY source), 0) AS BIGINT) AS remains FROM fit),
ln AS (SELECT source, remains, size, row_number() OVER (PARTITION BY source ORDER BY size DESC) AS i, k, doc_id FROM (
        SELECT *, row_number() OVER (PARTITION BY source, size ORDER BY k, doc_id) AS j FROM lf WHERE NOT fits AND size > 0 AND size <= remains) WHERE j = 1),
fl(source, i, goal, k, doc_id, taken) AS (
  SELECT source, CAST(0 AS BIGINT), max(remains), '', CAST(NULL AS BIGINT), false FROM ln GROUP BY source
  UNION ALL
  SELECT ln.source, ln.i, CASE WHEN ln.size <= fl.goal THEN fl.goal - ln.size ELSE fl.goal END, ln.k, ln.doc_id, ln.size <= fl.goal
  FROM fl JOIN ln ON ln.source IS NOT DISTINCT FROM fl.source AND ln.i = fl.i + 1),
gl AS (SELECT source, min(goal) AS goal FROM fl GROUP BY source),
one AS (SELECT lf.*, coalesce(gl.goal, lf.remains) AS goal,
               NOT lf.fits AND f.k IS NOT NULL AND row_number() OVER (PARTITION BY lf.source, lf.k, lf.doc_id, lf.fits ORDER BY lf.size) = 1 AS filled
        FROM lf LEFT JOIN gl ON lf.source IS NOT DISTINCT FROM gl.source
        LEFT JOIN (SELECT * FROM fl WHERE taken) f ON lf.source IS NOT DISTINCT FROM f.source AND lf.k = f.k AND lf.doc_id IS NOT DISTINCT FROM f.doc_id),
near AS (SELECT *, row_number() OVER (PARTITION BY source, NOT fits AND NOT filled AND size > 0 AND abs(size - goal) < goal ORDER BY abs(size - goal), k, doc_id) = 1
                   AND NOT fits AND NOT filled AND size > 0 AND abs(size - goal) < goal AS more FROM one),
cp AS (SELECT *, whole + CASE WHEN fits OR filled OR more THEN 1 ELSE 0 END AS copies FROM near)
SELECT doc_id, size, source_size, target, CAST(size * copies AS BIGINT) AS taken, CAST(copies AS BIGINT) AS copies FROM cp
"""
