"""Assigners against plain sequential loops on random small inputs."""

import random

import pytest
from pyspark.sql import functions as F

from tallywise.operators import assign


def loop(pairs, budget, coverage="none", lam=0.0, per_item=None, caps=None, history=None, quota=False):
    """The sequential choice: one pair at a time, the best that is left."""
    left, ni, na, out = dict(pairs), {}, {}, []
    while left and len(out) < budget:
        ok = {k: u for k, u in left.items() if (per_item is None or ni.get(k[0], 0) < per_item) and (caps is None or na.get(k[1], 0) < caps.get(k[1], 0))}
        if not ok:
            break

        def key(k, ok=ok):
            u = ok[k] - (lam * ni.get(k[0], 0) if coverage == "soft" else 0)
            first = ((history or {}).get(k[1], 0) + na.get(k[1], 0),) if quota else ()
            cover = (ni.get(k[0], 0),) if coverage == "hard" else ()
            return (*first, *cover, -u, *k)

        best = min(ok, key=key)
        out.append(best)
        del left[best]
        ni[best[0]], na[best[1]] = ni.get(best[0], 0) + 1, na.get(best[1], 0) + 1
    return out


def random_case(seed):
    r = random.Random(seed)
    n, a = r.randint(1, 6), r.randint(1, 5)
    tied = r.random() < 0.5
    pairs = {(i, j): (r.randint(0, 3) / 4 if tied else r.random()) for i in range(n) for j in range(a) if r.random() > 0.25}
    return pairs, r.randint(0, 12), {j: r.randint(0, 4) for j in range(a)}, {j: r.randint(0, 3) for j in range(a)}, r.randint(1, 3)


def run(spark, pairs, budget, how, caps=None, history=None, **kw):
    u = spark.createDataFrame([(*k, float(v)) for k, v in pairs.items()], "item_id long, annotator_id long, u double")
    c = None if caps is None else spark.createDataFrame(list(caps.items()), "annotator_id long, cap long")
    h = None if history is None else spark.createDataFrame(list(history.items()), "annotator_id long, n long")
    args = {"caps": c} | ({"history": h} if how is assign.quota else {}) | kw
    return [(r["item_id"], r["annotator_id"]) for r in how(u, budget, **args).orderBy("slot").collect()]


@pytest.mark.parametrize("seed", range(4))
def test_greedy(spark, seed):
    pairs, budget, caps, _, per = random_case(seed)
    assert run(spark, pairs, budget, assign.greedy) == loop(pairs, budget)
    assert run(spark, pairs, budget, assign.greedy, max_per_item=per) == loop(pairs, budget, per_item=per)
    assert run(spark, pairs, budget, assign.greedy, caps) == loop(pairs, budget, caps=caps)
    assert run(spark, pairs, budget, assign.greedy, coverage="hard") == loop(pairs, budget, "hard")
    assert run(spark, pairs, budget, assign.greedy, coverage="soft", soft_lambda=0.25) == loop(pairs, budget, "soft", 0.25)


@pytest.mark.parametrize("seed", range(20, 25))
def test_greedy_with_both_caps(spark, seed):
    pairs, budget, caps, _, per = random_case(seed)
    assert run(spark, pairs, budget, assign.greedy, caps, max_per_item=per) == loop(pairs, budget, per_item=per, caps=caps)
    assert run(spark, pairs, budget, assign.greedy, caps, coverage="hard") == loop(pairs, budget, "hard", caps=caps)


@pytest.mark.parametrize("seed", range(60, 66))
def test_soft_coverage_with_annotator_caps(spark, seed):
    pairs, budget, caps, _, per = random_case(seed)
    assert run(spark, pairs, budget, assign.greedy, caps, coverage="soft", soft_lambda=0.25) == loop(pairs, budget, "soft", 0.25, caps=caps)
    assert run(spark, pairs, budget, assign.greedy, caps, coverage="soft", soft_lambda=0.1, max_per_item=per) == loop(pairs, budget, "soft", 0.1, per, caps)


@pytest.mark.parametrize(("coverage", "top_m"), [("none", None), ("none", 3), ("hard", None), ("hard", 3)])
def test_epsilon_greedy_slot_by_slot(spark, coverage, top_m):
    from tallywise.tables import uniform

    pairs, _, _, _, _ = random_case(71)
    pairs |= {(i, 7): i / 50 for i in range(9)}
    budget, eps = 14, 0.5
    u = spark.createDataFrame([(*k, float(v)) for k, v in pairs.items()], "item_id long, annotator_id long, u double")
    # every level of hard coverage has random numbers of its own
    x = [{(r[0], r[1]): r[2] for r in u.select("item_id", "annotator_id", uniform(4, F.lit(2), *([F.lit(level)] if level else []), "item_id", "annotator_id")).collect()} for level in range(4)]
    draws = spark.range(budget).select(*[uniform(4, F.lit(2), F.lit(n), F.col("id")) for n in ("slot", "pick")]).collect()
    left, n, want = dict(pairs), {}, []
    for flip, pick in draws:
        least = min((n.get(k[0], 0) for k in left), default=0)
        ok = sorted((k for k in left if coverage == "none" or n.get(k[0], 0) == least), key=lambda k: (-left[k], *k))
        if not ok:
            break
        if flip >= eps:
            got = ok[0]
        elif top_m is None:
            got = min(ok, key=lambda k: (x[least if coverage == "hard" else 0][k], *k))
        else:
            got = ok[int(pick * min(top_m, len(ok)))]
        want.append(got)
        del left[got]
        n[got[0]] = n.get(got[0], 0) + 1
    out = assign.epsilon_greedy(u, budget, eps, cycle=2, seed=4, coverage=coverage, top_m=top_m).orderBy("slot").collect()
    assert [(r["item_id"], r["annotator_id"]) for r in out] == want and [r["slot"] for r in out] == list(range(len(want)))


@pytest.mark.parametrize("seed", range(40, 44))
def test_quota(spark, seed):
    pairs, budget, caps, history, _ = random_case(seed)
    assert run(spark, pairs, budget, assign.quota, None, history) == loop(pairs, budget, history=history, quota=True)
    assert run(spark, pairs, min(budget, 6), assign.quota, caps, history, coverage="hard") == loop(pairs, min(budget, 6), "hard", caps=caps, history=history, quota=True)


def test_random_ones_are_unique_seeded_and_within_budget(spark):
    u = spark.range(60).select((F.col("id") % 10).alias("item_id"), (F.col("id") % 6).alias("annotator_id"), (F.col("id") / 60).alias("u")).dropDuplicates(["item_id", "annotator_id"])
    for name in ("epsilon_greedy_global", "epsilon_greedy_sample", "softmax_greedy_global", "softmax_greedy_sample"):
        first = [tuple(r) for r in assign.assign(u, 8, cycle=2, seed=5, **assign.PRESETS[name]).orderBy("slot").collect()]
        again = [tuple(r) for r in assign.assign(u.repartition(7), 8, cycle=2, seed=5, **assign.PRESETS[name]).orderBy("slot").collect()]
        assert first == again and len({r[1:] for r in first}) == 8
    greedy = [tuple(r) for r in assign.greedy(u, 8).orderBy("slot").collect()]
    assert [tuple(r) for r in assign.epsilon_greedy(u, 8, 0.0).orderBy("slot").collect()] == greedy
    assert assign.cosine_value(0.2, 0.01, 0, 10) == 0.2 and assign.cosine_value(0.2, 0.01, 10, 10) == pytest.approx(0.01)


def test_no_budget_and_no_pairs(spark):
    u = spark.createDataFrame([(1, 1, 0.5)], "item_id long, annotator_id long, u double")
    assert assign.greedy(u, 0).count() == assign.quota(u.limit(0), 5, "hard").count() == assign.greedy(u.limit(0), 3).count() == 0
    with pytest.raises(ValueError, match="coverage"):
        assign.greedy(u, 1, "most")
