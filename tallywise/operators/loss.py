"""Losses of log-predictions of several heads, as grouped sums over long tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywise.sources.staging import staged
from tallywise.tables import small, uniform

TINY = 1e-12
#: Bins of the draws of ``bootstrap_mask``.
BINS = 4096


def bootstrap_mask(rows: DataFrame, share: float, seed: int = 0, drawn: Column | None = None) -> DataFrame:
    """(head, item_id, masked): in each head exactly round(share * items) of its items, at random, are masked."""
    u = uniform(seed, "head", "item_id") if drawn is None else drawn
    each = staged(rows.select("head", "item_id").distinct().withColumn("u", u).withColumn("bin", F.least(F.floor(F.col("u") * BINS), F.lit(BINS - 1))))
    # the bin of draws in which the share is reached; only its items are ranked
    bins = each.groupBy("head", "bin").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy("head")
    bins = bins.withColumn("upto", F.sum("c").over(w.orderBy("bin"))).withColumn("k", F.round(F.sum("c").over(w) * share).cast("long"))
    cut = bins.filter("upto - c < k AND upto >= k").select("head", F.col("bin").alias("cut"), (F.col("k") - F.col("upto") + F.col("c")).alias("room"))
    placed = each.join(small(staged(cut)), "head", "left")
    inside = placed.filter("bin = cut").withColumn("r", F.row_number().over(Window.partitionBy("head").orderBy("u", "item_id")))
    rest = placed.filter("cut IS NULL OR bin <> cut").select("head", "item_id", F.coalesce(F.col("bin") < F.col("cut"), F.lit(False)).alias("masked"))
    return rest.unionByName(inside.select("head", "item_id", (F.col("r") <= F.col("room")).alias("masked")))


def divergence(log_predictions: DataFrame, targets: DataFrame, reduction: str = "batchmean", log_target: bool = False, ignore: int = -100, mask: DataFrame | None = None) -> DataFrame:
    """KL divergence of targets from predictions (head, item_id, class, logp).

    ``targets`` are soft (item_id, class, t) or hard (item_id, label); for hard ones it is the negative log-likelihood, and ``ignore`` is no
    label.  Masked items don't count.  ``none`` gives (head, item_id, loss), ``sum`` and ``batchmean`` one row (loss); the mean is over
    the items of all heads that count, 0 without any.
    """
    if "label" in targets.columns:
        hard = targets.filter(F.col("label") != ignore).select("item_id", F.col("label").alias("class"))
        each = log_predictions.join(hard, ["item_id", "class"]).select("head", "item_id", (-F.col("logp")).alias("loss"))
    else:
        t = F.exp("t") if log_target else F.col("t")
        rows = log_predictions.join(targets, ["item_id", "class"]).withColumn("t", t)
        point = F.when(F.col("t") > 0, F.col("t") * (F.ln(F.greatest("t", F.lit(TINY))) - F.col("logp"))).otherwise(0.0)
        each = rows.groupBy("head", "item_id").agg(F.sum(point).alias("loss"))
    if mask is not None:
        each = each.join(mask.filter("masked"), ["head", "item_id"], "left_anti")
    if reduction == "none":
        return each
    if reduction not in ("sum", "batchmean"):
        raise ValueError(f"reduction: {reduction}")
    return each.agg(F.coalesce(F.sum("loss") if reduction == "sum" else F.avg("loss"), F.lit(0.0)).alias("loss"))
