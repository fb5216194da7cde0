"""Learners with a table of annotators: gradients, hidden layers, very many annotators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallywise.operators import learn


@pytest.mark.parametrize("hidden", [None, 5])
def test_gradients_of_the_network(hidden):
    r = np.random.default_rng(2)
    net = learn._Network(3, 4, hidden, r)
    theta, x, y = net.start + r.normal(0, 0.3, len(net.start)), r.normal(size=(9, 3)), r.integers(0, 4, 9)
    value = lambda t: -np.log(net.forward(x, t)[0][np.arange(9), y]).sum()
    f, inputs = net.forward(x, theta)
    got = net.backward(inputs, theta, f - np.eye(4)[y])
    want = [(value(theta + e) - value(theta - e)) / 2e-6 for e in np.eye(len(theta)) * 1e-6]
    assert np.allclose(got, want, atol=1e-5)


def crowd(spark, n_items=150, n_annotators=4):
    r = np.random.default_rng(3)
    x = r.normal(size=(n_items, 2))
    y = (x[:, 0] * x[:, 1] > 0).astype(int)  # not linear
    f = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(n_items)], "item_id long, x array<double>")
    a = spark.createDataFrame([(i, j, int(y[i] if r.random() < 0.9 else 1 - y[i])) for i in range(n_items) for j in range(n_annotators)], "item_id long, annotator_id long, label int")
    return a, f


def test_a_hidden_layer_fits_what_a_line_cannot(spark, monkeypatch):
    a, f = crowd(spark)
    line = learn.crowd_layer(a, f, 2, steps=25, rate=1.0)
    monkeypatch.setattr(learn, "HELD", 1)  # tasks pass annotators on
    deep = learn.crowd_layer(a, f, 2, steps=25, rate=1.0, hidden=8)
    assert deep["loss"][-1] < line["loss"][-1] - 0.01
    table = deep["confusion_table"].groupBy("annotator_id", "truth").agg(F.sum("p").alias("p")).collect()
    assert len(table) == 8 and all(v["p"] == pytest.approx(1) for v in table)
    assert np.allclose([v["p"] for v in deep["confusion_table"].orderBy("annotator_id", "truth", "label").collect()], deep["confusions"].ravel())


def test_very_many_annotators(spark):
    a = spark.range(100_000).select((F.col("id") % 500).alias("item_id"), F.col("id").alias("annotator_id"), (F.col("id") % 2).cast("int").alias("label"))
    f = spark.range(500).select(F.col("id").alias("item_id"), F.array((F.col("id") % 2).cast("double"), F.lit(1.0)).alias("x"))
    found = learn.crowd_layer(a, f, 2, steps=2, rate=0.01)
    assert found["loss"][1] < found["loss"][0] and "confusions" not in found and found["confusion_table"].count() == 400_000
    low = learn.low_rank_expertise(a, f, 2, steps=2, rate=0.01, dim=2)
    assert low["loss"][1] < low["loss"][0] and low["annotator_vectors"].count() == 100_000
