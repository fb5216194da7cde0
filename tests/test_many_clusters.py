"""K-means with many clusters, and neighbours within many small groups."""

import numpy as np
import pytest

from tallywise.operators import kernel, learn, lloyd

SMALL = {"BLOCK": 16, "POINTS": 32, "SLICE": 8, "CENTRES": 4}


def points(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "item_id long, x array<double>")


def refuse(*_, **__):
    raise AssertionError("not for this many clusters, or for groups this small")


def test_rounds_end_where_every_point_is_at_its_nearest_mean(spark, monkeypatch):
    import pyspark.ml.clustering

    for name, value in SMALL.items():
        monkeypatch.setattr(lloyd, name, value)
    monkeypatch.setattr(learn, "FEW_CLUSTERS", 8)
    # it chooses first centres on the driver, which takes the square of their number
    monkeypatch.setattr(pyspark.ml.clustering, "KMeans", refuse)
    x = np.random.default_rng(4).normal(1e4, 1, (120, 3))
    rows = learn.clusters(points(spark, x), 12, seed=2).orderBy("item_id").collect()
    own = np.array([r["cluster"] for r in rows])
    assert [r["item_id"] for r in rows] == list(range(120)) and set(own) == set(range(12))
    means = np.array([x[own == c].mean(0) for c in range(12)])
    assert (np.square(x[:, None] - means[None]).sum(2).argmin(1) == own).all()


def test_a_round_is_that_of_a_plain_loop(spark, monkeypatch):
    for name, value in SMALL.items():
        monkeypatch.setattr(lloyd, name, value)
    x = np.round(np.random.default_rng(6).normal(0, 1, (90, 2)), 1)
    seen = []
    whole = lloyd._assigned

    def watched(*args):
        out = whole(*args)
        state = sorted((i, c, d) for r in out.collect() for i, c, d in zip(r["ids"], r["cs"], r["ds"], strict=True))
        seen.append((args[1].collect(), [c for _, c, _ in state], [d for *_, d in state]))
        return out

    monkeypatch.setattr(lloyd, "_assigned", watched)
    lloyd.clusters(points(spark, x), 12, seed=1)
    assert len(seen) > lloyd.DRAWS + 2
    for centres, own, d2 in seen[lloyd.DRAWS :]:
        at = {r["cluster"]: np.array(r["x"]) for r in centres}
        all_ = np.array([np.square(x - at[c]).sum(1) for c in range(len(at))])
        assert (all_.argmin(0) == own).all() and d2 == pytest.approx(all_.min(0))


def test_fewer_points_than_clusters(spark):
    x = [[0.0, 0.0]] * 5 + [[1.0, 1.0]] * 3
    found = {r["item_id"]: r["cluster"] for r in lloyd.clusters(points(spark, x), 6).collect()}
    assert len({found[i] for i in range(5)}) == len({found[i] for i in range(5, 8)}) == 1 and found[0] != found[7]


def test_small_groups_need_no_cells(spark, monkeypatch):
    monkeypatch.setattr(kernel, "searched_cells", refuse)
    r = np.random.default_rng(8)
    x, g = np.round(r.normal(0, 1, (300, 2)), 1), np.sort(r.integers(0, 40, 300))
    rows = spark.createDataFrame([(i, [float(v) for v in x[i]], int(g[i])) for i in range(300)] + [(999, [0.0, 0.0], 77)], "item_id long, x array<double>, g int")
    got = sorted((v["item_id"], v["rank"], v["other_id"], v["d2"]) for v in kernel.nearest(rows, 4, by="g").collect())
    want = []
    for i in range(300):
        others = sorted((float(np.square(x[i] - x[j]).sum()), j) for j in np.flatnonzero(g == g[i]) if j != i)[:4]
        want += [(i, n + 1, j, pytest.approx(d)) for n, (d, j) in enumerate(others)]
    assert got == want


def test_small_and_large_groups_together(spark, monkeypatch):
    monkeypatch.setattr(kernel, "WITHIN", 30)
    r = np.random.default_rng(9)
    x, g = r.normal(0, 1, (200, 2)), np.array([0] * 120 + [1] * 50 + [2] * 25 + [3] * 5)
    rows = spark.createDataFrame([(i, [float(v) for v in x[i]], int(g[i])) for i in range(200)], "item_id long, x array<double>, g int")
    got = sorted((v["item_id"], v["rank"], v["other_id"]) for v in kernel.nearest(rows, 3, by="g").collect())
    want = [(i, n + 1, j) for i in range(200) for n, (_, j) in enumerate(sorted((np.square(x[i] - x[j]).sum(), j) for j in np.flatnonzero(g == g[i]) if j != i)[:3])]
    assert got == want
