"""Measures of a labelling round, each one row (or one row a cycle) from long tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallywise.functions.arrays import argmax
from tallywise.operators.aggregate import majority_vote, votes
from tallywise.operators.order import positions

TINY = 1e-15


def annotator_report(annotations: DataFrame, items: DataFrame, annotators: DataFrame | None = None) -> DataFrame:
    """(annotator_id, n_labels, accuracy, coverage) of every annotator; accuracy is 0 without labels, coverage the share of items."""
    n_items = items.agg(F.count(F.lit(1)).alias("n_items"))
    every = (annotators if annotators is not None else annotations).select("annotator_id").distinct()
    scored = annotations.join(items.select("item_id", "y"), "item_id").groupBy("annotator_id").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("label") == F.col("y")).cast("double")).alias("acc"))
    out = every.join(scored, "annotator_id", "left").crossJoin(F.broadcast(n_items))
    return out.select("annotator_id", F.coalesce("n", F.lit(0)).alias("n_labels"), F.coalesce("acc", F.lit(0.0)).alias("accuracy"), F.coalesce(F.coalesce("n", F.lit(0)) / F.nullif(F.col("n_items"), F.lit(0)), F.lit(0.0)).alias("coverage"))


def pool_report(report: DataFrame, annotations: DataFrame, items: DataFrame) -> DataFrame:
    """One row: labels, overall accuracy, coverage of all pairs, mean and population deviation of the annotators' accuracies."""
    joined = annotations.join(items.select("item_id", "y"), "item_id").agg(F.count(F.lit(1)).alias("n_labels"), F.avg((F.col("label") == F.col("y")).cast("double")).alias("accuracy"))
    each = report.agg(F.avg("accuracy").alias("mean_accuracy"), F.stddev_pop("accuracy").alias("std_accuracy"), F.count(F.lit(1)).alias("n_annotators"))
    n = items.agg(F.count(F.lit(1)).alias("n_items"))
    return joined.crossJoin(each).crossJoin(n).select("n_labels", "accuracy", F.coalesce(F.col("n_labels") / F.nullif(F.col("n_items") * F.col("n_annotators"), F.lit(0)), F.lit(0.0)).alias("coverage"), "mean_accuracy", "std_accuracy")


def coverage_metrics(annotations: DataFrame, items: DataFrame) -> DataFrame:
    """Labels per item that has any: their number, mean, median, upper quartile, extremes, and shares with 2 and 3."""
    per = annotations.groupBy("item_id").agg(F.count(F.lit(1)).alias("c"))
    n = items.agg(F.count(F.lit(1)).alias("n"))
    zero = lambda e: F.coalesce(e, F.lit(0.0))
    one = per.agg(
        zero(F.sum("c").cast("double")).alias("label_total_pairs"),
        F.count(F.lit(1)).cast("double").alias("label_unique_samples"),
        zero(F.avg("c")).alias("label_labels_per_sample_mean_covered"),
        zero(F.percentile("c", F.lit(0.5))).alias("label_labels_per_sample_median_covered"),
        zero(F.percentile("c", F.lit(0.75))).alias("label_labels_per_sample_p75_covered"),
        zero(F.min("c").cast("double")).alias("label_labels_per_sample_min_covered"),
        zero(F.max("c").cast("double")).alias("label_labels_per_sample_max_covered"),
        zero(F.avg((F.col("c") >= 2).cast("double"))).alias("label_frac_covered_ge2"),
        zero(F.avg((F.col("c") >= 3).cast("double"))).alias("label_frac_covered_ge3"),
    )
    return one.crossJoin(F.broadcast(n)).withColumn("label_frac_covered", zero(F.col("label_unique_samples") / F.nullif(F.col("n"), F.lit(0)))).drop("n")


def pair_accuracy(annotations: DataFrame, items: DataFrame) -> DataFrame:
    hits = annotations.join(items.select("item_id", "y"), "item_id").agg(F.avg((F.col("label") == F.col("y")).cast("double")).alias("a"))
    return hits.select(F.coalesce("a", F.lit(0.0)).alias("acc_pair_micro"))


def majority_accuracy(annotations: DataFrame, items: DataFrame) -> DataFrame:
    hits = majority_vote(annotations).join(items.select("item_id", "y"), "item_id").agg(F.avg((F.col("label") == F.col("y")).cast("double")).alias("a"))
    return hits.select(F.coalesce("a", F.lit(0.0)).alias("acc_majority_vote"))


def tie_rate(annotations: DataFrame) -> DataFrame:
    """Share of covered items with more than one label of most votes."""
    top = votes(annotations).withColumn("top", F.max("votes").over(Window.partitionBy("item_id")))
    tied = top.groupBy("item_id").agg((F.sum((F.col("votes") == F.col("top")).cast("int")) > 1).cast("double").alias("t"))
    return tied.agg(F.coalesce(F.avg("t"), F.lit(0.0)).alias("acc_majority_vote_tie_rate"))


def disagreement_rate(annotations: DataFrame) -> DataFrame:
    """Share with different labels of the items with two labels or more."""
    per = annotations.groupBy("item_id").agg(F.count(F.lit(1)).alias("c"), F.countDistinct("label").alias("d")).filter("c >= 2")
    return per.agg(F.coalesce(F.avg((F.col("d") > 1).cast("double")), F.lit(0.0)).alias("acc_disagreement_rate_multi"))


def allocation_metrics(annotations: DataFrame, annotators: DataFrame) -> DataFrame:
    """Entropy of the labels over annotators, the same over its largest value, and the Gini coefficient; idle annotators count."""
    used = annotations.groupBy("annotator_id").agg(F.count(F.lit(1)).alias("c"))
    every = annotators.select("annotator_id").distinct().join(used, "annotator_id", "left").select("annotator_id", F.coalesce("c", F.lit(0)).alias("c"))
    # annotators with equally many labels stand together: m of them with c each add up to m * before + c * m * (m + 1) / 2
    sizes = every.groupBy("c").agg(F.count(F.lit(1)).alias("m")).withColumn("w", F.col("c") * F.col("m"))
    rows = positions(sizes, ["c"], sums={"cum": "w"})
    one = rows.agg(
        F.sum(F.when(F.col("c") > 0, -F.col("w") * F.ln(F.col("c").cast("double"))).otherwise(0.0)).alias("l"),
        F.coalesce(F.sum("m"), F.lit(0)).alias("n"),
        F.coalesce(F.sum("w"), F.lit(0)).alias("t"),
        F.sum(F.col("m") * (F.col("cum") - F.col("w")) + F.col("c") * F.col("m") * (F.col("m") + 1) / 2).alias("s"),
    )
    # -sum(p ln p) with p = c / t
    total = F.nullif(F.col("t"), F.lit(0))
    one = one.select("n", "t", (F.col("l") / total + F.ln(total.cast("double"))).alias("h"), (F.col("s") / total).alias("s"))
    some = F.coalesce(F.col("t") > 0, F.lit(False))
    return one.select(
        F.when(some, F.col("h")).otherwise(0.0).alias("alloc_entropy"),
        F.when(some & (F.col("n") > 1), F.col("h") / F.ln("n")).otherwise(0.0).alias("alloc_entropy_norm"),
        F.when(some, (F.col("n") + 1 - 2 * F.col("s")) / F.col("n")).otherwise(0.0).alias("alloc_gini"),
    )


def delta_metrics(current: DataFrame, previous: DataFrame | None, items: DataFrame) -> DataFrame:
    """New pairs, their accuracy, and new items against the labels before; zeros without a before."""
    if previous is None:
        return items.agg(F.lit(0.0).alias("delta_new_pairs"), F.lit(0.0).alias("delta_new_pair_acc"), F.lit(0.0).alias("delta_new_unique_samples"))
    new = current.join(previous.select("item_id", "annotator_id"), ["item_id", "annotator_id"], "left_anti").join(items.select("item_id", "y"), "item_id")
    fresh = current.select("item_id").distinct().join(previous.select("item_id").distinct(), "item_id", "left_anti").agg(F.count(F.lit(1)).cast("double").alias("delta_new_unique_samples"))
    one = new.agg(F.count(F.lit(1)).cast("double").alias("delta_new_pairs"), F.coalesce(F.avg((F.col("label") == F.col("y")).cast("double")), F.lit(0.0)).alias("delta_new_pair_acc"))
    return one.crossJoin(fresh)


def prediction_metrics(posteriors: DataFrame, items: DataFrame, n_classes: int) -> DataFrame:
    """Accuracy, balanced accuracy, log loss and Brier score of (item_id, p array) against (item_id, y); NaN without items."""
    rows = posteriors.join(items.select("item_id", "y"), "item_id").select(
        "y",
        (argmax(F.col("p")) == F.col("y")).cast("double").alias("hit"),
        (-F.ln(F.greatest(F.get("p", F.col("y")), F.lit(TINY)))).alias("loss"),
        (F.aggregate(F.transform("p", lambda v, k: (v - (k == F.col("y")).cast("double")) * (v - (k == F.col("y")).cast("double"))), F.lit(0.0), lambda s, v: s + v) / n_classes).alias("brier"),
    )
    recall = rows.groupBy("y").agg(F.avg("hit").alias("r")).agg(F.avg("r").alias("b"))
    one = rows.agg(F.avg("hit").alias("a"), F.avg("loss").alias("l"), F.avg("brier").alias("s")).crossJoin(recall)
    nan = lambda c: F.coalesce(c, F.lit(float("nan")))
    return one.select(nan("a").alias("test_acc"), nan("b").alias("test_balanced_acc"), nan("l").alias("test_log_loss"), nan("s").alias("test_brier_ovr"))


def round_metrics(acquired: DataFrame, items: DataFrame, annotators: DataFrame, previous: DataFrame | None = None, posteriors: DataFrame | None = None, test_items: DataFrame | None = None, n_classes: int = 2) -> DataFrame:
    """All 24 measures of a round in one row; those of predictions are NaN without them."""
    parts = [
        coverage_metrics(acquired, items),
        pair_accuracy(acquired, items),
        majority_accuracy(acquired, items),
        tie_rate(acquired),
        disagreement_rate(acquired),
        allocation_metrics(acquired, annotators),
        delta_metrics(acquired, previous, items),
    ]
    if posteriors is not None:
        parts.append(prediction_metrics(posteriors, test_items if test_items is not None else items, n_classes))
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(F.broadcast(p))
    for name in ("test_acc", "test_balanced_acc", "test_log_loss", "test_brier_ovr") if posteriors is None else ():
        out = out.withColumn(name, F.lit(float("nan")))
    return out


def history_metrics(acquired: DataFrame, items: DataFrame) -> DataFrame:
    """One row a cycle over all labels up to it: pairs, items, pair accuracy, new pairs and their accuracy.

    Labels are counted in their own cycle first; the running sums are over one row a cycle.
    """
    hit = acquired.join(items.select("item_id", "y"), "item_id")
    first = acquired.groupBy("item_id").agg(F.min("cycle").alias("cycle")).groupBy("cycle").agg(F.count(F.lit(1)).alias("items"))
    per = hit.groupBy("cycle").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("label") == F.col("y")).cast("long")).alias("right"))
    w = Window.orderBy("cycle").rowsBetween(Window.unboundedPreceding, 0)
    joined = per.join(first, "cycle", "left").withColumn("items", F.coalesce("items", F.lit(0)))
    return joined.select(
        "cycle",
        F.sum("n").over(w).alias("label_total_pairs"),
        F.sum("items").over(w).alias("label_unique_samples"),
        (F.sum("right").over(w) / F.sum("n").over(w)).alias("acc_pair_micro"),
        F.col("n").alias("delta_new_pairs"),
        (F.col("right") / F.col("n")).alias("delta_new_pair_acc"),
        F.col("items").alias("delta_new_unique_samples"),
    )
