"""Mean distances to peers from sums by item."""

import numpy as np
import pytest

from tallywise.operators import scorers


def test_peers_are_summed_without_a_row_for_each_entry(spark, monkeypatch):
    monkeypatch.setattr(scorers, "PAIRS_AT_ONCE", 4)
    f = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(6)], "item_id long, x array<double>")
    seen = spark.createDataFrame([(i, a, (i * a) % 2) for i in range(6) for a in range(3)], "item_id long, annotator_id long, label int")
    cand = spark.createDataFrame([(i, a) for i in range(6) for a in range(5) if (i + a) % 4], "item_id long, annotator_id long")
    out = scorers.representation_diversity(cand, f, seen, 2)
    assert "posexplode" not in out._jdf.queryExecution().executedPlan().toString()
    got = {(r["item_id"], r["annotator_id"]): r["u"] for r in out.collect()}
    x = np.array([[1.0, i] for i in range(6)])
    x /= np.sqrt((x * x).sum(1))[:, None]
    v = {}
    for a in range(3):
        joint = np.concatenate([x, np.eye(2)[[(i * a) % 2 for i in range(6)]]], 1)
        m = (joint / np.sqrt((joint * joint).sum(1))[:, None]).mean(0)
        v[a] = m / np.sqrt(m @ m)
    pairs = [(r["item_id"], r["annotator_id"]) for r in cand.collect()]
    want = {}
    for i, a in pairs:
        peers = [1 - v[a] @ v[b] for j, b in pairs if j == i and b != a and b in v] if a in v else []
        want[i, a] = 2.0 if a not in v else np.mean(peers) if peers else 0.0
    assert got == pytest.approx(want)
