"""Choosing items to label: at random, by margin, by typicality of clusters, by spread of gradients or of uncertain items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywise.functions.arrays import argmax, as_doubles, uncertainty
from tallywise.operators import kernel, prep
from tallywise.operators.learn import clusters
from tallywise.sources.staging import staged
from tallywise.tables import uniform


def random_items(candidates: DataFrame, budget: int, seed: int = 0, drawn: Column | None = None) -> DataFrame:
    return prep.subsample(candidates.select("item_id"), budget, seed, drawn)


def margin_items(posteriors: DataFrame, budget: int) -> DataFrame:
    """Items (item_id, p array) with the smallest lead of the top class; leads that are equal to 9 places are ties, which go by id."""
    return posteriors.select("item_id", F.round(uncertainty(F.col("p"), "margin"), 9).alias("m")).orderBy(F.col("m").desc(), "item_id").limit(budget).select("item_id")


def typical_items(features: DataFrame, labelled: DataFrame, budget: int, neighbours: int = 20, seed: int = 0) -> DataFrame:
    """The most typical item (1 / mean distance to its neighbours) of each of the largest clusters that have no label.

    There are as many clusters as labelled items and budget together, of the features' neighbours within the cluster.
    """
    k = labelled.select("item_id").distinct().count() + budget
    k = max(2, min(k, features.count()))
    c = staged(clusters(features, k, seed))
    size = c.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    covered = c.join(labelled.select("item_id").distinct(), "item_id", "left_semi").select("cluster").distinct()
    open_ = size.join(covered, "cluster", "left_anti")
    inside = features.join(c, "item_id").join(open_.hint("merge"), "cluster")
    near = kernel.nearest(inside.select("item_id", "x", "cluster"), neighbours, by="cluster").select("item_id", F.sqrt("d2").alias("d"))
    mean = near.groupBy("item_id").agg((1 / F.greatest(F.avg("d"), F.lit(1e-12))).alias("t"))
    typical = inside.select("item_id", "cluster", "n").join(mean.hint("merge"), "item_id", "left")
    best = typical.withColumn("r", F.row_number().over(Window.partitionBy("cluster").orderBy(F.col("t").desc_nulls_last(), "item_id"))).filter("r = 1")
    return best.orderBy(F.col("n").desc(), "cluster").limit(budget).select("item_id")


def spread_items(points: DataFrame, budget: int, rounds: int = 5, weight: Column | None = None, seed: int = 0) -> DataFrame:
    """``budget`` items of (item_id, x) that lie far apart: oversampling rounds weighted by squared distance to those chosen.

    Each round draws about 2 * budget / rounds items at once; of all drawn ones the budget with the largest keys stays.  ``weight`` adds to
    the distance.
    """
    extra = F.lit(0.0) if weight is None else weight
    state = staged(points.withColumn("d2", F.lit(None).cast("double")).withColumn("w", extra.cast("double")))
    first = state.orderBy(uniform(seed, "item_id"), "item_id").limit(1)
    chosen = staged(first.select("item_id", "x", F.lit(-1).alias("round"), F.lit(0.0).alias("key")))
    new = chosen
    per = max(1, -(-2 * budget // rounds))
    for t in range(rounds):
        d = kernel.least_distance2(state.select("item_id", "x"), new.select("item_id", "x")).withColumnRenamed("d2", "n2").hint("merge")
        state = staged(state.join(new.select("item_id"), "item_id", "left_anti").join(d, "item_id").select("item_id", "x", F.least(F.coalesce("d2", "n2"), F.col("n2")).alias("d2"), "w"))
        key = -F.ln(uniform(seed, F.lit(t), "item_id")) / F.greatest(F.col("d2") + F.col("w"), F.lit(1e-12))
        new = staged(state.orderBy(key, "item_id").limit(per).select("item_id", "x", F.lit(t).alias("round"), key.alias("key")))
        chosen = chosen.unionByName(new)
    return chosen.orderBy("round" if budget <= 1 else "key", "item_id").limit(budget).select("item_id")


def gradient_items(features: DataFrame, posteriors: DataFrame, budget: int, seed: int = 0) -> DataFrame:
    """Spread of gradient embeddings (p - onehot(argmax)) times x."""
    k = F.size("p")
    rows = features.join(posteriors, "item_id")
    hot = F.transform(F.sequence(F.lit(0), k - 1), lambda c: (c == argmax(F.col("p"))).cast("double"))
    g = F.zip_with(as_doubles(F.col("p")), hot, lambda a, b: a - b)
    wide = rows.select("item_id", F.flatten(F.transform(g, lambda a: F.transform("x", lambda v: a * v))).alias("x"))
    return spread_items(wide, budget, seed=seed)


def uncertain_spread_items(posteriors: DataFrame, budget: int, seed: int = 0) -> DataFrame:
    """Spread in probability space, with the margin uncertainty added to the distance."""
    rows = posteriors.select("item_id", as_doubles(F.col("p")).alias("x"), uncertainty(F.col("p"), "margin").alias("u"))
    return spread_items(rows, budget, weight=F.col("u"), seed=seed)


