"""Queries on assignment, schedules, and consensus by EM."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallywise.functions import schedules
from tallywise.operators import assign, dawid_skene, prep
from tallywise.queries.labels import _SOFT, PAIR, K, _r, _until
from tallywise.queries.registry import query
from tallywise.tables import draw, view, with_views

#: Utilities of every open pair: the fixed generator, in hundredths so that ties occur.
_U = f"floor({draw(PAIR, 11)} * 100) / 100"
_OPEN = "ut AS (SELECT item_id, annotator_id, " + _U + " AS u FROM x2 WHERE cycle >= 5)"
_V = with_views("x2", "x8")
BUDGET = 256


def _utilities(spark, sf_dir):
    pool = view(spark, sf_dir, "x2")
    return prep.available_pairs(pool, _until(pool, 5)).select("item_id", "annotator_id", F.expr(_U).alias("u"))


def _caps(spark, sf_dir):
    """Capacities left: those of an equal share, less the labels given."""
    pool = view(spark, sf_dir, "x2")
    return prep.remaining_counts(pool, _until(pool, 5), 40).select("annotator_id", F.col("remaining").alias("cap"))


_CAPS = "cp AS (SELECT annotator_id, least(count(*) FILTER (cycle >= 5), greatest(40 - count(*) FILTER (cycle < 5), 0)) AS cap FROM x2 GROUP BY 1)"
_TAKE = " SELECT CAST(row_number() OVER (ORDER BY {order}) - 1 AS INT) AS slot, item_id, annotator_id FROM (SELECT * FROM ({rows}) ORDER BY {order} LIMIT 256)"
_RANK = "SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY u DESC, annotator_id) AS r FROM ut"


@query(_V + f", {_OPEN}" + _TAKE.format(order="u DESC, item_id, annotator_id", rows="SELECT * FROM ut"))
def p1_f1_greedy(spark, sf_dir):
    return assign.greedy(_utilities(spark, sf_dir), BUDGET)


@query(_V + f", {_OPEN}" + _TAKE.format(order="u DESC, item_id, annotator_id", rows=f"SELECT * FROM ({_RANK}) WHERE r <= 1"))
def p2_greedy_item_cap(spark, sf_dir):
    return assign.greedy(_utilities(spark, sf_dir), BUDGET, max_per_item=1)


@query(_V + f", {_OPEN}, {_CAPS}" + _TAKE.format(order="u DESC, item_id, annotator_id", rows="SELECT * FROM (SELECT ut.*, cap, row_number() OVER (PARTITION BY ut.annotator_id ORDER BY u DESC, item_id) AS r FROM ut JOIN cp ON cp.annotator_id = ut.annotator_id) WHERE r <= cap"))
def p2_greedy_annotator_cap(spark, sf_dir):
    return assign.greedy(_utilities(spark, sf_dir), BUDGET, caps=_caps(spark, sf_dir))


@query()
def p3_greedy_both_caps(spark, sf_dir):
    return assign.greedy(_utilities(spark, sf_dir), BUDGET, max_per_item=1, caps=_caps(spark, sf_dir))


@query(_V + f", {_OPEN}" + _TAKE.format(order="r, u DESC, item_id, annotator_id", rows=_RANK))
def p4_greedy_hard_coverage(spark, sf_dir):
    return assign.greedy(_utilities(spark, sf_dir), BUDGET, "hard")


@query()
def p4_greedy_hard_coverage_caps(spark, sf_dir):
    return assign.greedy(_utilities(spark, sf_dir), BUDGET, "hard", caps=_caps(spark, sf_dir))


@query(_V + f", {_OPEN}" + _TAKE.format(order="v DESC, item_id, annotator_id", rows=f"SELECT *, u - 0.25 * (r - 1) AS v FROM ({_RANK})"))
def p5_greedy_soft_coverage(spark, sf_dir):
    return assign.greedy(_utilities(spark, sf_dir), BUDGET, "soft", 0.25)


@query()
def p6_f3_epsilon_greedy(spark, sf_dir):
    return assign.assign(_utilities(spark, sf_dir), BUDGET, cycle=3, seed=1, top_m=1024, **assign.PRESETS["epsilon_greedy_global"])


@query()
def p6_epsilon_greedy_hard_coverage(spark, sf_dir):
    return assign.assign(_utilities(spark, sf_dir), BUDGET, cycle=3, seed=1, **assign.PRESETS["epsilon_greedy_sample"])


@query()
def p5_soft_coverage_caps(spark, sf_dir):
    return assign.greedy(_utilities(spark, sf_dir), BUDGET, "soft", 0.25, caps=_caps(spark, sf_dir))


@query(_V + f", {_OPEN}" + _TAKE.format(order="u DESC, item_id, annotator_id", rows="SELECT * FROM ut"))
def p10_annealed_to_greedy(spark, sf_dir):
    """The cycle is all the state of an annealed assigner: far beyond its period, an epsilon that anneals to 0 is greedy."""
    return assign.assign(_utilities(spark, sf_dir), BUDGET, "epsilon", cycle=50, seed=1, epsilon_max=0.5, epsilon_min=0.0, period=10)


@query()
def p6_epsilon_greedy_caps(spark, sf_dir):
    """Exploration under annotator capacities, at most two labels an item, and soft coverage."""
    return assign.assign(_utilities(spark, sf_dir), 96, "epsilon", "soft", cycle=3, seed=1, caps=_caps(spark, sf_dir), soft_lambda=0.25, max_per_item=2, epsilon_max=0.2, epsilon_min=0.01, period=10)


@query()
def p7_softmax_caps(spark, sf_dir):
    """Softmax with hard coverage under annotator capacities."""
    return assign.assign(_utilities(spark, sf_dir), BUDGET, cycle=3, seed=1, caps=_caps(spark, sf_dir), **assign.PRESETS["softmax_greedy_sample"])


@query()
def p7_softmax(spark, sf_dir):
    return assign.assign(_utilities(spark, sf_dir), BUDGET, cycle=3, seed=1, **assign.PRESETS["softmax_greedy_global"])


_HIST = "hs AS (SELECT annotator_id, count(*) AS h FROM x2 WHERE cycle < 5 GROUP BY 1)"


def _history(spark, sf_dir):
    return _until(view(spark, sf_dir, "x2"), 5).groupBy("annotator_id").agg(F.count(F.lit(1)).alias("n"))


@query(_V + f", {_OPEN}, {_HIST}" + _TAKE.format(order="lvl, u DESC, item_id, annotator_id", rows="SELECT ut.*, coalesce(h, 0) + row_number() OVER (PARTITION BY ut.annotator_id ORDER BY u DESC, item_id) - 1 AS lvl FROM ut LEFT JOIN hs ON hs.annotator_id = ut.annotator_id"))
def p8_quota(spark, sf_dir):
    return assign.quota(_utilities(spark, sf_dir), BUDGET, history=_history(spark, sf_dir))


@query()
def p9_quota_hard_coverage(spark, sf_dir):
    return assign.quota(_utilities(spark, sf_dir), 64, "hard", _history(spark, sf_dir))


@query(_V + f", {_OPEN}" + ", t AS (SELECT item_id, annotator_id FROM ut ORDER BY u DESC, item_id, annotator_id LIMIT 256) SELECT item_id, annotator_id, label FROM x2 WHERE cycle < 5 UNION ALL SELECT item_id, annotator_id, label FROM x2 JOIN t USING (item_id, annotator_id)")
def c5_acquire(spark, sf_dir):
    from tallywise.plans.round import acquire

    pool = view(spark, sf_dir, "x2")
    return acquire(_until(pool, 5).drop("cycle"), pool.drop("cycle"), assign.greedy(_utilities(spark, sf_dir), BUDGET))


@query("WITH c AS (SELECT DISTINCT CAST(o_custkey % 30 AS BIGINT) AS cycle FROM orders) SELECT cycle, CASE WHEN cycle BETWEEN 0 AND 4 THEN 2.0 WHEN cycle BETWEEN 3 AND 9 THEN 1.5 ELSE 1.0 END::DOUBLE AS ratio FROM c")
def g15_step_schedule(spark, sf_dir):
    return _cycles(spark, sf_dir).select("cycle", schedules.step_value(F.col("cycle"), 1.0, [(0, 4, 2.0), (3, 9, 1.5)]).alias("ratio"))


def _cycles(spark, sf_dir):
    """The cycles that customers' orders fall into."""
    from tallywise.tables import table

    return table(spark, sf_dir, "orders").select((F.col("o_custkey") % 30).cast("long").alias("cycle")).distinct()


_CYCLES = "WITH c AS (SELECT DISTINCT CAST(o_custkey % 30 AS BIGINT) AS cycle FROM orders)"


@query(_CYCLES + " SELECT cycle, round(1 + (2 - 1) * (1 + cos(pi() * greatest(least(cycle, 25) - 2, 0) / 23.0)) / 2, 6) AS ratio FROM c")
def g16_cosine_schedule(spark, sf_dir):
    return _r(_cycles(spark, sf_dir).select("cycle", schedules.cosine_value(F.col("cycle"), 2.0, 1.0, 30, t_start=2, t_end=25).alias("ratio")), "ratio")


@query(_CYCLES + """, k AS (SELECT cycle, CASE WHEN cycle < 4 THEN 0 WHEN cycle < 12 THEN 1 WHEN cycle < 28 THEN 2 ELSE 3 END AS k FROM c)
SELECT cycle, round(1 + power(0.5, k) * (1 + cos(pi() * (least(cycle, 29) - 4.0 * (power(2, k) - 1)) / (4 * power(2, k)))) / 2, 6) AS ratio FROM k""")
def g16_cosine_restarts(spark, sf_dir):
    return _r(_cycles(spark, sf_dir).select("cycle", schedules.cosine_value(F.col("cycle"), 2.0, 1.0, 30, t_0=4, t_mult=2.0, gamma=0.5).alias("ratio")), "ratio")


@query(_CYCLES + """ SELECT cycle, round(1 + (1 + cos(pi() * (cycle % 4) / 4.0)) / 2, 6) AS ratio FROM c""")
def g16_cosine_restarts_beyond_the_end(spark, sf_dir):
    """Restarts go on after ``t_end``."""
    return _r(_cycles(spark, sf_dir).select("cycle", schedules.cosine_value(F.col("cycle"), 2.0, 1.0, 30, t_0=4, t_end=5).alias("ratio")), "ratio")


@query(_CYCLES + " SELECT cycle, round(0.01 + (0.2 - 0.01) * (1 + cos(pi() * least(cycle, 10) / 10.0)) / 2, 6) AS epsilon FROM c")
def g17_annealed_epsilon(spark, sf_dir):
    return _r(_cycles(spark, sf_dir).select("cycle", schedules.cosine_value(F.col("cycle"), 0.2, 0.01, 30, t_end=10).alias("epsilon")), "epsilon")


@query(_CYCLES + " SELECT cycle, CASE WHEN cycle BETWEEN 0 AND 4 THEN 2.0 ELSE 1.0 END::DOUBLE AS ratio, CAST(256 AS BIGINT) AS n_pairs, CAST(ceil(256 / CASE WHEN cycle BETWEEN 0 AND 4 THEN 2.0 ELSE 1.0 END) AS BIGINT) AS n_items, CAST(256 * row_number() OVER (ORDER BY cycle) AS BIGINT) AS total_pairs FROM c")
def g18_e7_budget_plan(spark, sf_dir):
    return schedules.budget_plan(_cycles(spark, sf_dir), 256, schedules.step_value(F.col("cycle"), *schedules.PRESETS["ratio_2_1"]))


def em_sql(iterations: int, add: str = "0.01") -> str:
    """SQL of so many steps of Dawid-Skene as one chain of CTEs; the last is ``p<iterations>``."""
    out = [_SOFT, f"p0 AS (SELECT i.item_id, k AS class, coalesce(p, 0.0) AS p FROM (SELECT DISTINCT item_id FROM x2) i CROSS JOIN range({K}) r(k) LEFT JOIN sv ON sv.item_id = i.item_id AND sv.class = k)"]
    for t in range(iterations):
        out += [
            f"pi{t} AS MATERIALIZED (SELECT class, avg(p) AS p FROM p{t} GROUP BY 1)",
            f"n{t} AS (SELECT annotator_id, class AS truth, label, sum(p) AS n FROM x2 JOIN p{t} USING (item_id) GROUP BY 1, 2, 3)",
            f"g{t} AS (SELECT a.annotator_id, t.k AS truth, l.k AS label, coalesce(n, 0) + {add} AS n FROM (SELECT DISTINCT annotator_id FROM x2) a CROSS JOIN range({K}) t(k) CROSS JOIN range({K}) l(k) LEFT JOIN n{t} n ON n.annotator_id = a.annotator_id AND n.truth = t.k AND n.label = l.k)",
            f"c{t} AS MATERIALIZED (SELECT annotator_id, truth, label, n / sum(n) OVER (PARTITION BY annotator_id, truth) AS p FROM g{t})",
            f"s{t} AS (SELECT item_id, truth AS class, sum(ln(greatest(c.p, 1e-12))) + max(ln(greatest(pi.p, 1e-12))) AS s FROM x2 JOIN c{t} c ON c.annotator_id = x2.annotator_id AND c.label = x2.label JOIN pi{t} pi ON pi.class = truth GROUP BY 1, 2)",
            f"e{t} AS (SELECT item_id, class, exp(s - max(s) OVER (PARTITION BY item_id)) AS e FROM s{t})",
            f"p{t + 1} AS MATERIALIZED (SELECT item_id, class, e / sum(e) OVER (PARTITION BY item_id) AS p FROM e{t})",
        ]
    return ", ".join(out)


@query(with_views("x2") + f", {em_sql(2)} SELECT item_id, CAST(class AS INT) AS class, round(p, 6) AS p FROM p2")
def k1_dawid_skene_two_steps(spark, sf_dir):
    return _r(dawid_skene.dawid_skene(view(spark, sf_dir, "x2"), K, max_iter=2)[0].withColumn("class", F.col("class").cast("int")), "p")


@query(with_views("x2", "x8") + f""", {em_sql(10)} SELECT item_id, CAST(class AS INT) AS class, round(p, 5) AS p FROM p10
UNION ALL SELECT item_id, CAST(class AS INT), round(p, 5) FROM x8 CROSS JOIN (SELECT class, avg(p) AS p FROM p10 GROUP BY 1) WHERE item_id NOT IN (SELECT item_id FROM x2)""")
def k1_dawid_skene(spark, sf_dir):
    post = dawid_skene.dawid_skene(view(spark, sf_dir, "x2"), K, max_iter=10, items=view(spark, sf_dir, "x8"))[0]
    return post.select("item_id", F.col("class").cast("int").alias("class"), F.round("p", 5).alias("p"))


@query()
def k3_crowd_em(spark, sf_dir):
    return dawid_skene.crowd_em(view(spark, sf_dir, "x2"), K, view(spark, sf_dir, "x8v").select("item_id", "x"), max_iter=2)[0]


@query(with_views("x2") + f", {em_sql(3, '0.1 + CAST(t.k = l.k AS INT)')} SELECT item_id, CAST(class AS INT) AS class, round(p, 6) AS p FROM p3")
def k3_crowd_em_without_features(spark, sf_dir):
    post = dawid_skene.crowd_em(view(spark, sf_dir, "x2"), K, max_iter=3, prior_full=1.1, prior_diag=1.0)[0]
    return _r(post.withColumn("class", F.col("class").cast("int")), "p")


@query()
def k2_aggregate_then_classify(spark, sf_dir):
    from tallywise.operators.learn import aggregate_classifier

    return aggregate_classifier(view(spark, sf_dir, "x2"), view(spark, sf_dir, "x8v").select("item_id", "x"), K)["posteriors"]


@query()
def l1_labelling_rounds(spark, sf_dir):
    """Three rounds over the pool; one row of measures for each."""
    from tallywise.plans.round import labelling_rounds

    return labelling_rounds(view(spark, sf_dir, "x2").drop("cycle"), view(spark, sf_dir, "x8"), K, cycles=3, pairs_per_cycle=64)


@query()
def l1_labelling_rounds_with_capacities(spark, sf_dir):
    """Two rounds in which nobody labels more than five items, two labels an item in the first and one in the second."""
    from tallywise.plans.round import labelling_rounds

    return labelling_rounds(view(spark, sf_dir, "x2").drop("cycle"), view(spark, sf_dir, "x8"), K, cycles=2, pairs_per_cycle=64, ratio=lambda cycle: 2.0 if cycle == 0 else 1.0, capacity=5)


