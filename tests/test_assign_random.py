"""Randomised assigners under coverage and capacities, against sequential loops with the same draws."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallywise.operators import assign
from tallywise.tables import uniform


def case(seed, n=7, a=5):
    r = random.Random(seed)
    pairs = {(i, j): r.randint(0, 12) / 8 for i in range(n) for j in range(a) if r.random() > 0.2}
    return pairs, {j: r.randint(0, 4) for j in range(a)}


def feasible(left, ni, na, coverage, per_item, caps):
    ok = [k for k in left if (per_item is None or ni.get(k[0], 0) < per_item) and (caps is None or na.get(k[1], 0) < caps.get(k[1], 0))]
    least = min((ni.get(k[0], 0) for k in ok), default=0)
    return [k for k in ok if coverage != "hard" or ni.get(k[0], 0) == least], least


def loop(pairs, budget, choose, coverage, per_item=None, caps=None):
    """One pair at a time; ``choose`` gets the slot, the feasible pairs, the level and the labels of each item."""
    left, ni, na, out = dict(pairs), {}, {}, []
    while len(out) < budget:
        ok, level = feasible(left, ni, na, coverage, per_item, caps)
        if not ok:
            break
        k = choose(len(out), ok, level if coverage == "hard" else 0, ni)
        out.append(k)
        del left[k]
        ni[k[0]], na[k[1]] = ni.get(k[0], 0) + 1, na.get(k[1], 0) + 1
    return out


def tables(spark, pairs, caps, cycle, seed, budget):
    u = spark.createDataFrame([(*k, float(v)) for k, v in pairs.items()], "item_id long, annotator_id long, u double")
    c = None if caps is None else spark.createDataFrame(list(caps.items()), "annotator_id long, cap long")
    levels = [uniform(seed, F.lit(cycle), *([F.lit(v)] if v else []), "item_id", "annotator_id").alias(f"x{v}") for v in range(5)]
    x = {(r[0], r[1]): r[2:] for r in u.select("item_id", "annotator_id", *levels).collect()}
    draws = spark.range(budget).select(*[uniform(seed, F.lit(cycle), F.lit(n), F.col("id")) for n in ("slot", "pick")]).collect()
    return u, c, x, draws


def got(df):
    rows = df.orderBy("slot").collect()
    assert [r["slot"] for r in rows] == list(range(len(rows)))
    return [(r["item_id"], r["annotator_id"]) for r in rows]


@pytest.mark.parametrize(
    ("coverage", "capped", "per_item", "top_m"),
    [("none", True, None, None), ("none", True, 2, 3), ("hard", True, None, None), ("hard", True, 2, 3), ("soft", False, None, None), ("soft", True, 2, None), ("soft", True, None, 3)],
)
def test_epsilon_greedy_with_capacities(spark, coverage, capped, per_item, top_m):
    pairs, caps = case(31)
    caps, lam, eps, budget = caps if capped else None, 0.25, 0.5, 17
    u, c, x, draws = tables(spark, pairs, caps, 2, 4, budget)

    def choose(slot, ok, level, ni):
        score = {k: pairs[k] - (lam * ni.get(k[0], 0) if coverage == "soft" else 0) for k in ok}
        order = sorted(ok, key=lambda k: (-score[k], *k))
        if draws[slot][0] >= eps:
            return order[0]
        return min(ok, key=lambda k: (x[k][level], *k)) if top_m is None else order[math.floor(draws[slot][1] * min(top_m, len(order)))]

    want = loop(pairs, budget, choose, coverage, per_item, caps)
    assert got(assign.epsilon_greedy(u, budget, eps, 2, 4, coverage, top_m, lam if coverage == "soft" else 0.0, per_item, c)) == want
    assert want and (not capped or len(want) <= sum(caps.values()))


def race_loop(pairs, noise, t, lam, budget, coverage, per_item, caps):
    """The loop of softmax with given noise; a label of an item slows its race under soft coverage."""
    when = {k: math.exp(-(u / t + noise[k][0])) for k, u in pairs.items()}

    def choose(slot, ok, level, ni):
        if coverage == "hard":
            return min(ok, key=lambda k: (-(pairs[k] / t + noise[k][level]), *k))
        k = min(ok, key=lambda k: (when[k], *k))
        if coverage == "soft":
            for other in pairs:
                if other[0] == k[0] and when[other] > when[k]:
                    when[other] = when[k] + (when[other] - when[k]) * math.exp(lam / t)
        return k

    return loop(pairs, budget, choose, coverage, per_item, caps)


@pytest.mark.parametrize(("coverage", "capped", "per_item"), [("none", True, 2), ("hard", False, None), ("hard", True, 2), ("soft", False, None), ("soft", True, 2)])
def test_softmax_with_capacities(spark, coverage, capped, per_item):
    pairs, caps = case(37)
    caps, lam, t, budget = caps if capped else None, 0.2, 0.3, 16
    u, c, x, _ = tables(spark, pairs, caps, 3, 9, budget)
    noise = {k: [-math.log(-math.log(v)) for v in row] for k, row in x.items()}
    want = race_loop(pairs, noise, t, lam, budget, coverage, per_item, caps)
    assert got(assign.softmax_sample(u, budget, t, 3, 9, coverage, lam, per_item, c)) == want


@pytest.mark.parametrize("coverage", ["hard", "soft"])
def test_frequencies_of_the_third_slot(coverage):
    """The race gives the frequencies of drawing one pair at a time by the weights of the scores of that moment."""
    pairs, t, lam, runs = {(0, 0): 2.0, (0, 1): 0.0, (1, 0): 0.0, (1, 1): 0.0}, 1.0, 0.7, 40_000
    r, keys = np.random.default_rng(5), list(pairs)
    count = {"race": 0, "draws": 0}
    for _ in range(runs):
        noise = {k: r.gumbel(size=2) for k in keys}
        count["race"] += race_loop(pairs, noise, t, lam, 3, coverage, None, None)[2][0] == 0

        def choose(slot, ok, level, ni):
            w = np.exp([(pairs[k] - (lam * ni.get(k[0], 0) if coverage == "soft" else 0)) / t for k in ok])
            return ok[int(np.searchsorted(np.cumsum(w / w.sum()), r.random()))]

        count["draws"] += loop(pairs, 3, choose, coverage)[2][0] == 0
    assert abs(count["race"] - count["draws"]) / runs < 0.01


def test_every_selection_keeps_the_capacities(spark):
    u = spark.range(24).select((F.col("id") % 6).alias("item_id"), (F.col("id") / 6).cast("long").alias("annotator_id"), (F.col("id") % 7 / 7).alias("u"))
    caps = spark.range(4).select(F.col("id").alias("annotator_id"), F.lit(1).cast("long").alias("cap"))
    for selection in ("greedy", "quota", "epsilon", "softmax"):
        rows = assign.assign(u, 12, selection, cycle=1, seed=2, caps=caps).collect()
        assert sorted(r["annotator_id"] for r in rows) == [0, 1, 2, 3]
    rows = assign.assign(u, 12, "epsilon", "soft", cycle=1, seed=2, caps=caps, max_per_item=1, soft_lambda=5.0, epsilon_schedule="constant").collect()
    assert len({r["item_id"] for r in rows}) == len(rows) == 4
    with pytest.raises(ValueError, match="quotas take no"):
        assign.assign(u, 12, "quota", max_per_item=1)
    with pytest.raises(ValueError, match="epsilon_schedule"):
        assign.assign(u, 12, "epsilon", epsilon_schedule="step")
