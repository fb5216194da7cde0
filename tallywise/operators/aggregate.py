"""Votes and what can be estimated from them in one pass: consensus labels, confusions, class priors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywise.tables import uniform


def votes(annotations: DataFrame) -> DataFrame:
    """(item_id, label, votes)."""
    return annotations.groupBy("item_id", "label").agg(F.count(F.lit(1)).alias("votes"))


def majority_vote(annotations: DataFrame, ties: str = "lowest", seed: int = 0) -> DataFrame:
    """(item_id, label) with most votes; ties go to the lowest class, or at random with ``ties="random"``."""
    tie: Column = -F.col("label") if ties == "lowest" else uniform(seed, "item_id", "label")
    return votes(annotations).groupBy("item_id").agg(F.max_by("label", F.struct(F.col("votes"), tie)).alias("label"))


def soft_votes(annotations: DataFrame) -> DataFrame:
    """(item_id, class, p): shares of the votes; classes without votes are absent."""
    w = Window.partitionBy("item_id")
    return votes(annotations).select("item_id", F.col("label").alias("class"), (F.col("votes") / F.sum("votes").over(w)).alias("p"))


def classes(n_classes: int, like: DataFrame, name: str = "class") -> DataFrame:
    return like.sparkSession.range(n_classes).select(F.col("id").cast("int").alias(name))


def dense(posteriors: DataFrame, n_classes: int) -> DataFrame:
    """Long posteriors with a row for every class of every item."""
    grid = posteriors.select("item_id").distinct().crossJoin(F.broadcast(classes(n_classes, posteriors)))
    return grid.join(posteriors.hint("merge"), ["item_id", "class"], "left").select("item_id", "class", F.coalesce("p", F.lit(0.0)).alias("p"))


def confusions(annotations: DataFrame, posteriors: DataFrame, n_classes: int, smoothing: float = 0.0, diagonal: float = 0.0) -> DataFrame:
    """(annotator_id, truth, label, p) of posterior-weighted label counts.

    ``smoothing`` is added to every count and ``diagonal`` to the correct ones; rows without mass are even.
    """
    counts = annotations.join(posteriors.hint("merge"), "item_id").groupBy("annotator_id", F.col("class").alias("truth"), "label").agg(F.sum("p").alias("n"))
    truth, label = classes(n_classes, annotations, "truth"), classes(n_classes, annotations, "label")
    grid = annotations.select("annotator_id").distinct().crossJoin(F.broadcast(truth)).crossJoin(F.broadcast(label))
    prior = F.lit(smoothing) + F.when(F.col("truth") == F.col("label"), diagonal).otherwise(0.0)
    full = grid.join(counts, ["annotator_id", "truth", "label"], "left").withColumn("n", F.coalesce("n", F.lit(0.0)) + prior)
    mass = F.sum("n").over(Window.partitionBy("annotator_id", "truth"))
    return full.select("annotator_id", "truth", "label", F.when(mass > 0, F.col("n") / mass).otherwise(1.0 / n_classes).alias("p"))


def confusions_with_prior(annotations: DataFrame, posteriors: DataFrame, n_classes: int, full: float = 1.0, diag: float = 0.0) -> DataFrame:
    """Confusions at the mode of a Dirichlet prior: counts plus ``full - 1``, plus ``diag`` where correct."""
    return confusions(annotations, posteriors, n_classes, full - 1, diag)


def class_prior(posteriors: DataFrame) -> DataFrame:
    """(class, p): the mean posterior."""
    n = posteriors.agg(F.countDistinct("item_id").alias("n"))
    return posteriors.groupBy("class").agg(F.sum("p").alias("s")).crossJoin(F.broadcast(n)).select("class", (F.col("s") / F.col("n")).alias("p"))


def pair_accuracy_model(posteriors: DataFrame, confusion: DataFrame) -> DataFrame:
    """(item_id, annotator_id, p_correct): class probabilities times the diagonal of the confusions."""
    right = confusion.filter("truth = label").select("annotator_id", F.col("truth").alias("class"), F.col("p").alias("c"))
    return posteriors.join(right, "class").groupBy("item_id", "annotator_id").agg(F.sum(F.col("p") * F.col("c")).alias("p_correct"))


def pair_label_model(posteriors: DataFrame, confusion: DataFrame) -> DataFrame:
    """(item_id, annotator_id, label, p): class probabilities times the confusion rows."""
    c = confusion.select("annotator_id", F.col("truth").alias("class"), "label", F.col("p").alias("c"))
    return posteriors.join(c, "class").groupBy("item_id", "annotator_id", "label").agg(F.sum(F.col("p") * F.col("c")).alias("p"))
