"""Aggregation, consensus, metrics and preparation on hand-made tables."""

import math

import pytest
from pyspark.sql import functions as F

from tallywise.operators import aggregate, dawid_skene, metrics, prep
from tallywise.tables import view

LABELS = "item_id long, annotator_id long, label int"


def test_majority_and_ties(spark):
    a = spark.createDataFrame([(1, 1, 2), (1, 2, 0), (2, 1, 1), (2, 2, 1), (2, 3, 0)], LABELS)
    assert {r[0]: r[1] for r in aggregate.majority_vote(a).collect()} == {1: 0, 2: 1}
    seeded = [tuple(r) for r in aggregate.majority_vote(a, "random", 3).orderBy("item_id").collect()]
    assert seeded == [tuple(r) for r in aggregate.majority_vote(a.repartition(5), "random", 3).orderBy("item_id").collect()]
    assert metrics.tie_rate(a).first()[0] == 0.5 and metrics.disagreement_rate(a).first()[0] == 1.0
    assert metrics.tie_rate(a.limit(0)).first()[0] == 0.0


def test_consensus_on_degenerate_pools(spark):
    single = spark.createDataFrame([(1, 1, 2), (2, 2, 0)], LABELS)
    post, _, _, info = dawid_skene.dawid_skene(single, 3)
    assert info["iterations"] == 0 and {(r["item_id"], r["class"]) for r in post.filter("p = 1").collect()} == {(1, 2), (2, 0)}
    items = spark.createDataFrame([(7,), (8,)], "item_id long")
    post, _, prior, _ = dawid_skene.dawid_skene(single.limit(0), 4, items=items)
    assert {r["p"] for r in post.collect()} == {0.25} and post.count() == 8 and prior.count() == 4


def test_consensus_beats_majority(spark, sf_dir):
    a, items = view(spark, sf_dir, "x2"), view(spark, sf_dir, "x8")
    post, conf, prior, info = dawid_skene.dawid_skene(a, 4, max_iter=20, items=items)
    best = post.groupBy("item_id").agg(F.max_by("class", "p").alias("c")).join(items, "item_id").agg(F.avg((F.col("c") == F.col("y")).cast("double"))).first()[0]
    assert best > metrics.majority_accuracy(a, items).first()[0] + 0.02
    sums = post.groupBy("item_id").agg(F.sum("p").alias("s")).agg(F.min("s"), F.max("s"), F.count("s")).first()
    assert sums[0] == pytest.approx(1) and sums[1] == pytest.approx(1) and sums[2] == items.count()
    assert conf.groupBy("annotator_id", "truth").agg(F.sum("p").alias("s")).filter("abs(s - 1) > 1e-9").count() == 0


def test_likelihood_does_not_fall_without_smoothing(spark, sf_dir):
    a = view(spark, sf_dir, "x2").filter("item_id < 150")
    values = [dawid_skene.log_likelihood(a, *dawid_skene.dawid_skene(a, 4, max_iter=n, tol=0, smoothing=0.0)[1:3]) for n in (1, 3, 5)]
    assert values[0] <= values[1] + 1e-6 <= values[2] + 2e-6


def test_metrics_of_nothing(spark):
    none = spark.createDataFrame([], LABELS)
    items, annotators = spark.createDataFrame([(1, 0)], "item_id long, y int"), spark.createDataFrame([(1,), (2,)], "annotator_id long")
    row = metrics.round_metrics(none, items, annotators).first().asDict()
    assert len(row) == 24 and all(v == 0 for k, v in row.items() if not k.startswith("test_")) and all(math.isnan(v) for k, v in row.items() if k.startswith("test_"))


def test_domains(spark):
    y = spark.createDataFrame([(2,), (10,), (2,), (None,)], "y int")
    assert [r["value"] for r in prep.label_domain(y).orderBy("code").collect()] == [10, 2]
    assert [r["value"] for r in prep.label_domain(y, order="numeric").orderBy("code").collect()] == [2, 10]
    assert [r["value"] for r in prep.label_domain(y, declared=["b", "a"]).orderBy("code").collect()] == ["b", "a"]


def test_negative_values_and_ragged_rows_are_errors(spark):
    from tallywise.functions.arrays import of_length

    v = spark.createDataFrame([(1, -2.0)], "annotator_id long, v double")
    with pytest.raises(Exception, match="negative"):
        prep.annotator_values(v, v, "v").collect()
    with pytest.raises(Exception, match="expected 2 entries"):
        spark.createDataFrame([([1.0],)], "x array<double>").select(of_length(F.col("x"), 2)).collect()


def test_rounds_keep_to_the_plan(spark, sf_dir):
    from tallywise.plans.round import labelling_rounds

    rows = labelling_rounds(view(spark, sf_dir, "x2").drop("cycle"), view(spark, sf_dir, "x8"), 4, cycles=2, pairs_per_cycle=32, em_steps=1).orderBy("cycle").collect()
    assert [r["planned_pairs"] for r in rows] == [32, 64]
    assert all(r["label_total_pairs"] <= r["planned_pairs"] for r in rows) and rows[1]["delta_new_pairs"] > 0
