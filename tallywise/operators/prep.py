"""Preparing annotation tables: domains and codes of labels, candidates, availability, subsets, features."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywise.functions.arrays import l2_normalised, normalised, total
from tallywise.tables import small, uniform


def merge_splits(*parts: DataFrame) -> DataFrame:
    """Rows of all splits, columns by name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def label_domain(*columns: DataFrame, order: str = "text", declared: list | None = None) -> DataFrame:
    """(code, value) of the declared names, or else of the distinct values of all tables of one column.

    Numbers sort as text by default (10 before 2), or with ``order="numeric"`` as numbers.  Null is no value.
    """
    spark = columns[0].sparkSession
    if declared is not None:
        return spark.createDataFrame(list(enumerate(declared)), ["code", "value"])
    values = reduce(DataFrame.union, [c.toDF("value") for c in columns]).filter("value IS NOT NULL").distinct()
    key = F.col("value").cast("string") if order == "text" else F.col("value")
    return values.select((F.row_number().over(Window.orderBy(key)) - 1).cast("int").alias("code"), "value")


def encode_labels(rows: DataFrame, domain: DataFrame, column: str = "y") -> DataFrame:
    """``rows`` with ``column`` as its code in the domain; values outside it become null."""
    names = domain.select(F.col("value").alias("__value"), F.col("code").alias("__code"))
    joined = rows.join(small(names), rows[column] == names["__value"], "left")
    return joined.select(*[F.col("__code").alias(c) if c == column else F.col(c) for c in rows.columns])


def is_labelled(label: Column, missing: int = -1) -> Column:
    """Present, not the missing marker, not NaN."""
    return label.isNotNull() & (label != missing) & ~F.isnan(label.cast("double"))


def pairs_from_matrix(rows: DataFrame, item: str = "item_id", z: str = "z") -> DataFrame:
    """(item_id, annotator_id, label) of the labelled entries of a row of labels per item."""
    long = rows.select(F.col(item).alias("item_id"), F.posexplode(z).alias("annotator_id", "label"))
    return long.filter(is_labelled(F.col("label"))).select("item_id", F.col("annotator_id").cast("long").alias("annotator_id"), "label")


def matrix_from_pairs(annotations: DataFrame, n_annotators: int, missing: int = -1) -> DataFrame:
    """(item_id, z): a row of labels per item, ``missing`` where an annotator gave none."""
    known = F.map_from_entries(F.collect_list(F.struct("annotator_id", "label")))
    row = F.transform(F.sequence(F.lit(0), F.lit(n_annotators - 1)), lambda a: F.coalesce(F.col("known")[a.cast("long")], F.lit(missing)))
    return annotations.groupBy("item_id").agg(known.alias("known")).select("item_id", row.alias("z"))


def candidate_items(items: DataFrame, acquired: DataFrame, n_annotators: int | None = None) -> DataFrame:
    """Items without any label, or given ``n_annotators`` those with an open slot."""
    ids = items.select("item_id").distinct()
    if n_annotators is None:
        return ids.join(acquired.select("item_id").distinct(), "item_id", "left_anti")
    used = acquired.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    return ids.join(used, "item_id", "left").filter(F.coalesce("n", F.lit(0)) < n_annotators).select("item_id")


def available_pairs(pool: DataFrame, acquired: DataFrame) -> DataFrame:
    """Pairs of the pool that are not acquired yet."""
    return pool.join(acquired.select("item_id", "annotator_id"), ["item_id", "annotator_id"], "left_anti")


def candidate_pairs(chosen: DataFrame, available: DataFrame) -> DataFrame:
    """Available pairs of the chosen items."""
    return available.join(chosen.select("item_id").distinct(), "item_id", "left_semi").select("item_id", "annotator_id")


def open_pairs(chosen: DataFrame, annotators: DataFrame) -> DataFrame:
    """Every annotator with every chosen item, for a pool without restrictions (its size is the product)."""
    return chosen.select("item_id").distinct().crossJoin(annotators.select("annotator_id").distinct())


def remaining_counts(pool: DataFrame, acquired: DataFrame, capacity: float | None = None) -> DataFrame:
    """(annotator_id, used, remaining) of annotators that can still label something."""
    used = acquired.groupBy("annotator_id").agg(F.count(F.lit(1)).alias("used"))
    left = available_pairs(pool, acquired).groupBy("annotator_id").agg(F.count(F.lit(1)).alias("remaining"))
    out = left.join(used, "annotator_id", "left").select("annotator_id", F.coalesce("used", F.lit(0)).alias("used"), "remaining")
    if capacity is not None:
        out = out.withColumn("remaining", F.least("remaining", F.greatest(F.lit(int(capacity)) - F.col("used"), F.lit(0))))
    return out.filter("remaining > 0")


def equal_share_capacity(annotators: DataFrame, total_budget: int, multiplier: float = 1.0) -> DataFrame:
    """(annotator_id, capacity): ceil(multiplier * budget / annotators) for each."""
    n = annotators.select("annotator_id").distinct().agg(F.count(F.lit(1)).alias("n"))
    share = F.ceil(F.lit(multiplier) * total_budget / F.col("n")).cast("long").alias("capacity")
    return annotators.select("annotator_id").distinct().crossJoin(F.broadcast(n)).select("annotator_id", share)


def annotator_values(annotators: DataFrame, values: DataFrame, column: str, default: float = 0) -> DataFrame:
    """A value for every annotator, ``default`` where none is given; negative ones are an error."""
    v = F.coalesce(F.col(column), F.lit(default))
    checked = F.when(v >= 0, v).otherwise(F.raise_error(F.concat(F.lit(f"{column} is negative: "), v.cast("string"))).cast("double"))
    return annotators.select("annotator_id").distinct().join(values, "annotator_id", "left").select("annotator_id", checked.alias(column))


def subsample(rows: DataFrame, n: int, seed: int = 0, drawn: Column | None = None, key: str = "item_id") -> DataFrame:
    """At most ``n`` rows, uniformly; the result does not depend on partitions."""
    u = uniform(seed, key) if drawn is None else drawn
    return rows.withColumn("__u", u).orderBy("__u", key).limit(n).drop("__u")


def argmax_label(scores: DataFrame, seed: int = 0, drawn: Column | None = None) -> DataFrame:
    """(item_id, annotator_id, class) of the largest value of (item_id, annotator_id, class, value); ties at random, of equal draws the lowest class."""
    u = uniform(seed, "item_id", "annotator_id", "class") if drawn is None else drawn
    return scores.groupBy("item_id", "annotator_id").agg(F.max_by("class", F.struct(F.col("value"), u, -F.col("class"))).alias("class"))


def likelihood_pairs(raw: DataFrame, items: DataFrame, annotators: DataFrame, classes: DataFrame) -> DataFrame:
    """(item_id, annotator_id, p) of raw annotations with a map ``likelihoods``, for known items and annotators.

    p has the classes in order of code; it is normalised only where every class is given and the sum is positive.
    """
    known = raw.join(items.select("item_id").distinct(), "item_id", "left_semi").join(small(annotators.select("annotator_id").distinct()), "annotator_id", "left_semi")
    names = classes.agg(F.transform(F.array_sort(F.collect_list(F.struct("code", "name"))), lambda e: e["name"]).alias("names"))
    p = F.transform("names", lambda n: F.col("likelihoods")[n])
    rows = known.crossJoin(F.broadcast(names)).select("item_id", "annotator_id", p.alias("p"))
    whole = ~F.exists("p", lambda v: v.isNull()) & (total(F.transform("p", lambda v: F.coalesce(v, F.lit(0.0)))) > 0)
    return rows.select("item_id", "annotator_id", F.when(whole, normalised(F.col("p"))).otherwise(F.col("p")).alias("p"))


def annotation_subset(annotations: DataFrame, kind: str, n: int, truth: DataFrame | None = None, seed: int = 0, pair_draw: Column | None = None, item_draw: Column | None = None) -> DataFrame:
    """A subset of the labels of each item.

    ``rand``: n at random.  ``worst``: n, wrong ones first.  ``rand-var`` and ``worst-var``: all but a random number below n,
    which go at random or correct ones first.  ``truth`` (item_id, y) is needed for the worst ones.
    """
    u = uniform(seed, "item_id", "annotator_id") if pair_draw is None else pair_draw
    v = uniform(seed, "item_id") if item_draw is None else item_draw
    rows = annotations if truth is None else annotations.join(truth.select("item_id", F.col("y").alias("__y")), "item_id")
    wrong = (F.col("label") != F.col("__y")).cast("int") if truth is not None else None
    rows = rows.withColumn("__u", u).withColumn("__v", v)
    if kind == "rand":
        order, keep = F.col("__u").desc(), F.col("__r") <= n
    elif kind == "worst":
        order, keep = (wrong + F.col("__u")).desc(), F.col("__r") <= n
    elif kind == "rand-var":
        order, keep = F.col("__u").desc(), F.col("__r") > F.floor(F.col("__v") * n)
    elif kind == "worst-var":
        order, keep = (1 - wrong + F.col("__u")).desc(), F.col("__r") > F.floor(F.col("__v") * n)
    else:
        raise ValueError(f"kind: {kind}")
    w = Window.partitionBy("item_id").orderBy(order, "annotator_id")
    return rows.withColumn("__r", F.row_number().over(w)).filter(keep).select(*annotations.columns)


def normalised_features(features: DataFrame) -> DataFrame:
    return features.withColumn("x", l2_normalised(F.col("x")))


def standardised_features(fit: DataFrame, apply: DataFrame, eps: float = 1e-12) -> DataFrame:
    """(item_id, x) in units of the mean and population deviation (at least eps) of the fitted table."""
    dims = fit.select(F.posexplode("x").alias("d", "v")).groupBy("d").agg(F.avg(F.col("v").cast("double")).alias("m"), F.greatest(F.stddev_pop(F.col("v").cast("double")), F.lit(eps)).alias("s"))
    stats = dims.agg(F.array_sort(F.collect_list(F.struct("d", "m", "s"))).alias("stats"))
    z = F.zip_with("x", "stats", lambda v, t: (v.cast("double") - t["m"]) / t["s"])
    return apply.crossJoin(F.broadcast(stats)).select("item_id", z.alias("x"))


def last_rows(history: DataFrame, n: int, columns: list[str], order: str = "cycle") -> DataFrame:
    """The chosen columns of the last n rows in ``order``."""
    return history.orderBy(F.col(order).desc()).limit(n).select(*columns)


def pooled_tokens(tokens: DataFrame, how: str = "mean") -> DataFrame:
    """(item_id, x) from tokens (item_id, pos, mask, x): masked mean, or the first vector for ``cls``."""
    if how == "cls":
        return tokens.groupBy("item_id").agg(F.min_by("x", "pos").alias("x"))
    if how != "mean":
        raise ValueError(f"how: {how}")
    long = tokens.select("item_id", "mask", F.posexplode("x").alias("d", "v"))
    sums = long.groupBy("item_id", "d").agg((F.sum(F.col("v").cast("double") * F.col("mask")) / F.greatest(F.sum("mask"), F.lit(1))).alias("v"))
    return sums.groupBy("item_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "v"))), lambda e: e["v"]).alias("x"))
