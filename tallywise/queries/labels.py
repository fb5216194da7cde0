"""Queries on preparing, aggregating and measuring labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallywise.functions import arrays as A
from tallywise.operators import aggregate, metrics, prep
from tallywise.queries.registry import query
from tallywise.tables import draw, table, view, with_views

K = 4
PAIR, ITEM = "item_id * 20 + annotator_id", "item_id"


def _r(df, *columns):
    """Columns rounded to 6 places."""
    return df.select(*[F.round(c, 6).alias(c) if c in columns else F.col(c) for c in df.columns])


def _until(annotations, cycle=15):
    return annotations.filter(F.col("cycle") < cycle)


@query("SELECT o_orderkey AS item_id, 'train' AS split FROM orders WHERE o_orderstatus <> 'P' UNION ALL SELECT o_orderkey, 'test' FROM orders WHERE o_orderstatus = 'P'")
def a2_merge_splits(spark, sf_dir):
    o, item = table(spark, sf_dir, "orders"), F.col("o_orderkey").alias("item_id")
    return prep.merge_splits(o.filter("o_orderstatus <> 'P'").select(item, F.lit("train").alias("split")), o.filter("o_orderstatus = 'P'").select(item, F.lit("test").alias("split")))


@query("SELECT c_custkey AS item_id, 0 AS dim, round(CAST(CAST(c_acctbal AS FLOAT) AS DOUBLE), 2) AS v FROM customer UNION ALL SELECT c_custkey, 1, CAST(c_nationkey AS DOUBLE) FROM customer")
def b1_stack_features(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    x = A.of_length(A.stacked("c_acctbal", "c_nationkey").cast("array<double>"), 2)
    return c.select(F.col("c_custkey").alias("item_id"), F.posexplode(x).alias("dim", "v")).withColumn("v", F.round("v", 2))


@query(with_views("x7") + " SELECT CAST(row_number() OVER (ORDER BY value) - 1 AS INT) AS code, value FROM (SELECT DISTINCT lang AS value FROM x7 WHERE lang IS NOT NULL)")
def b3_label_domain(spark, sf_dir):
    return prep.label_domain(view(spark, sf_dir, "x7").select("lang"))


@query("SELECT CAST(row_number() OVER (ORDER BY CAST(value AS VARCHAR)) - 1 AS INT) AS code, value FROM (SELECT DISTINCT p_size AS value FROM part)")
def b3_label_domain_numbers_as_text(spark, sf_dir):
    return prep.label_domain(table(spark, sf_dir, "part").select("p_size"))


@query(with_views("x7") + ", d AS (SELECT CAST(row_number() OVER (ORDER BY value) - 1 AS INT) AS code, value FROM (SELECT DISTINCT source AS value FROM x7 WHERE source IS NOT NULL)) SELECT item_id, d.code AS source FROM x7 LEFT JOIN d ON source = value")
def b4_encode_labels(spark, sf_dir):
    rows = view(spark, sf_dir, "x7").select("item_id", "source")
    return prep.encode_labels(rows, prep.label_domain(rows.select("source")), "source")


@query(with_views("x3") + " SELECT item_id, annotator_id, label FROM x3 WHERE label <> 4")
def b5_labelled(spark, sf_dir):
    marked = view(spark, sf_dir, "x3").withColumn("label", F.when(F.col("label") == 4, -1).otherwise(F.col("label")))
    return marked.filter(prep.is_labelled(F.col("label")))


@query(with_views("x2") + " SELECT item_id, annotator_id, label FROM x2")
def b6_matrix_round_trip(spark, sf_dir):
    return prep.pairs_from_matrix(prep.matrix_from_pairs(view(spark, sf_dir, "x2").select("item_id", "annotator_id", "label"), 20))


@query(with_views("x2", "x8") + " SELECT item_id FROM x8 WHERE item_id NOT IN (SELECT item_id FROM x2 WHERE cycle < 5)")
def b7_unlabelled_items(spark, sf_dir):
    return prep.candidate_items(view(spark, sf_dir, "x8"), _until(view(spark, sf_dir, "x2"), 5))


@query(with_views("x2", "x8") + " SELECT x8.item_id FROM x8 LEFT JOIN (SELECT item_id, count(*) n FROM x2 WHERE cycle < 5 GROUP BY 1) u ON u.item_id = x8.item_id WHERE coalesce(n, 0) < 2")
def b7_items_with_open_slots(spark, sf_dir):
    return prep.candidate_items(view(spark, sf_dir, "x8"), _until(view(spark, sf_dir, "x2"), 5), 2)


@query(with_views("x2") + " SELECT item_id, annotator_id FROM x2 WHERE cycle >= 15")
def b8_available_pairs(spark, sf_dir):
    pool = view(spark, sf_dir, "x2")
    return prep.available_pairs(pool.select("item_id", "annotator_id"), _until(pool))


@query(with_views("x2") + """, u AS (SELECT annotator_id, count(*) FILTER (cycle < 15) AS used, count(*) FILTER (cycle >= 15) AS a FROM x2 GROUP BY 1)
SELECT annotator_id, CAST(used AS BIGINT) AS used, CAST(least(a, greatest(60 - used, 0)) AS BIGINT) AS remaining FROM u WHERE least(a, greatest(60 - used, 0)) > 0""")
def b9_remaining_counts(spark, sf_dir):
    pool = view(spark, sf_dir, "x2")
    return prep.remaining_counts(pool.select("item_id", "annotator_id"), _until(pool), 60).withColumn("remaining", F.col("remaining").cast("long"))


@query(with_views("x2") + " SELECT annotator_id, CAST(ceil(1.25 * 7680 / (SELECT count(DISTINCT annotator_id) FROM x2)) AS BIGINT) AS capacity FROM (SELECT DISTINCT annotator_id FROM x2)")
def b10_capacity(spark, sf_dir):
    return prep.equal_share_capacity(view(spark, sf_dir, "x2"), 7680, 1.25)


@query(with_views("x2") + ", q AS (SELECT annotator_id, count(*) q FROM x2 WHERE cycle = 0 GROUP BY 1) SELECT a.annotator_id, CAST(coalesce(q, 0) AS DOUBLE) AS quota FROM (SELECT DISTINCT annotator_id FROM x2) a LEFT JOIN q ON q.annotator_id = a.annotator_id")
def b11_annotator_values(spark, sf_dir):
    pool = view(spark, sf_dir, "x2")
    given = pool.filter("cycle = 0").groupBy("annotator_id").agg(F.count(F.lit(1)).cast("double").alias("quota"))
    return prep.annotator_values(pool, given, "quota", 0.0)


@query(with_views("x8") + f" SELECT item_id FROM x8 ORDER BY {draw(ITEM, 5)}, item_id LIMIT 100")
def b12_subsample(spark, sf_dir):
    return prep.subsample(view(spark, sf_dir, "x8").select("item_id"), 100, drawn=F.expr(draw(ITEM, 5)))


@query("SELECT vec_id AS item_id, CAST(i - 1 AS INT) AS dim, round(CAST(embedding[i] AS DOUBLE) / greatest(sqrt(list_sum(list_transform(embedding, lambda v: CAST(v AS DOUBLE) * CAST(v AS DOUBLE)))), 1e-12), 6) AS v FROM embeddings, range(1, 65) r(i)")
def b25_l2_normalised(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("x"))
    return _r(prep.normalised_features(e).select("item_id", F.posexplode("x").alias("dim", "v")), "v")


@query(with_views("x8v", "x2") + """, it AS MATERIALIZED (SELECT DISTINCT item_id FROM x2), l AS MATERIALIZED (SELECT item_id, unnest(range(0, len(x))) AS dim, CAST(unnest(x) AS DOUBLE) AS v FROM x8v),
s AS (SELECT dim, avg(v) m, greatest(stddev_pop(v), 1e-12) s FROM l JOIN it USING (item_id) GROUP BY 1)
SELECT item_id, CAST(l.dim AS INT) AS dim, round((v - m) / s, 6) AS v FROM l JOIN s ON s.dim = l.dim""")
def b26_standardised(spark, sf_dir):
    x = view(spark, sf_dir, "x8v").select("item_id", "x")
    return _r(prep.standardised_features(x.join(view(spark, sf_dir, "x2"), "item_id", "left_semi"), x).select("item_id", F.posexplode("x").alias("dim", "v")), "v")


@query(with_views("x2", "x8") + f""", c AS (SELECT item_id, k, count(label) FILTER (label = k) AS n FROM x8 LEFT JOIN x2 USING (item_id), range({K}) r(k) GROUP BY 1, 2)
SELECT item_id, CAST(k AS INT) AS class, round(CASE WHEN sum(n) OVER w = 0 THEN 0.25 ELSE n / sum(n) OVER w END, 6) AS p FROM c WINDOW w AS (PARTITION BY item_id)""")
def b27_normalised_rows(spark, sf_dir):
    counts = view(spark, sf_dir, "x8").select("item_id").join(view(spark, sf_dir, "x2"), "item_id", "left").groupBy("item_id").agg(F.array(*[F.count(F.when(F.col("label") == k, 1)).cast("double") for k in range(K)]).alias("v"))
    return _r(counts.select("item_id", F.posexplode(A.normalised(F.col("v"), "uniform")).alias("class", "p")), "p")


@query(with_views("x2") + f""", s AS (SELECT item_id, annotator_id, k, CASE WHEN k = label THEN 1 WHEN k = (label + 1) % {K} THEN 1 ELSE 0 END v FROM x2, range({K}) r(k))
SELECT item_id, annotator_id, CAST(arg_max(k, (v, {draw(f'({PAIR}) * 4 + k', 6)})) AS INT) AS class FROM s GROUP BY 1, 2""")
def b28_random_argmax(spark, sf_dir):
    scores = view(spark, sf_dir, "x2").select("item_id", "annotator_id", F.posexplode(F.expr(f"transform(sequence(0, {K - 1}), k -> IF(k = label OR k = (label + 1) % {K}, 1, 0))")).alias("class", "value"))
    return prep.argmax_label(scores, drawn=F.expr(draw(f"({PAIR}) * 4 + class", 6)))


@query(with_views("x2") + f" SELECT item_id, annotator_id, CAST(k AS INT) AS class, CAST(k = label AS INT) AS hot FROM x2, range({K}) r(k)")
def b29_one_hot(spark, sf_dir):
    return view(spark, sf_dir, "x2").select("item_id", "annotator_id", F.posexplode(A.one_hot(F.col("label"), K)).alias("class", "hot")).withColumn("hot", F.col("hot").cast("int"))


@query(with_views("x2") + " SELECT cycle, count(*) AS n FROM x2 GROUP BY 1 ORDER BY 1 DESC LIMIT 5")
def b30_last_rows(spark, sf_dir):
    return prep.last_rows(view(spark, sf_dir, "x2").groupBy("cycle").agg(F.count(F.lit(1)).alias("n")), 5, ["cycle", "n"])


@query(with_views("x8v") + """, t AS (SELECT item_id // 10 AS g, item_id % 10 AS pos, CASE WHEN item_id % 3 = 0 THEN 0 ELSE 1 END AS mask, x FROM x8v),
l AS (SELECT g, mask, i - 1 AS dim, CAST(x[i] AS DOUBLE) v FROM t, range(1, 65) r(i))
SELECT g AS item_id, CAST(dim AS INT) AS dim, round(sum(v * mask) / greatest(sum(mask), 1), 6) AS v FROM l GROUP BY 1, 2""")
def b31_pooled_tokens(spark, sf_dir):
    t = view(spark, sf_dir, "x8v").select(F.expr("item_id div 10").alias("item_id"), F.expr("item_id % 10").alias("pos"), F.expr("IF(item_id % 3 = 0, 0, 1)").alias("mask"), "x")
    return _r(prep.pooled_tokens(t).select("item_id", F.posexplode("x").alias("dim", "v")), "v")


@query(with_views("x8v") + ", t AS (SELECT item_id // 10 AS g, min_by(x, item_id % 10) AS x FROM x8v GROUP BY 1) SELECT g AS item_id, CAST(i - 1 AS INT) AS dim, round(CAST(x[i] AS DOUBLE), 6) AS v FROM t, range(1, 65) r(i)")
def b31_first_token(spark, sf_dir):
    t = view(spark, sf_dir, "x8v").select(F.expr("item_id div 10").alias("item_id"), F.expr("item_id % 10").alias("pos"), "x")
    return _r(prep.pooled_tokens(t, "cls").select("item_id", F.posexplode("x").alias("dim", "v")).withColumn("v", F.col("v").cast("double")), "v")


@query(with_views("x2", "x8") + " SELECT a.item_id, a.annotator_id FROM x2 a WHERE cycle >= 15 AND item_id NOT IN (SELECT item_id FROM x2 WHERE cycle < 5)")
def c6_candidate_pairs(spark, sf_dir):
    pool = view(spark, sf_dir, "x2")
    return prep.candidate_pairs(prep.candidate_items(view(spark, sf_dir, "x8"), _until(pool, 5)), pool.filter("cycle >= 15"))


@query(with_views("x2", "x8") + " SELECT item_id, a AS annotator_id FROM x8, range(20) r(a) WHERE item_id NOT IN (SELECT item_id FROM x2 WHERE cycle < 5)")
def c6_open_pairs(spark, sf_dir):
    return prep.open_pairs(prep.candidate_items(view(spark, sf_dir, "x8"), _until(view(spark, sf_dir, "x2"), 5)), spark.range(20).withColumnRenamed("id", "annotator_id"))


_LIKELIHOOD = """, l AS (SELECT a.item_id, a.annotator_id, k, CASE WHEN k = 3 AND a.item_id % 11 = 0 THEN NULL WHEN k = label THEN 3.0 ELSE CAST((k * 7 + a.annotator_id) % 3 AS DOUBLE) END v
 FROM x2 a, range(4) r(k) WHERE a.item_id IN (SELECT item_id FROM x8 WHERE y < 3) AND a.annotator_id < 15)
SELECT item_id, annotator_id, CAST(k AS INT) AS class, round(CASE WHEN count(v) OVER w = 4 AND sum(v) OVER w > 0 THEN v / sum(v) OVER w ELSE v END, 6) AS p FROM l WINDOW w AS (PARTITION BY item_id, annotator_id)"""


@query(with_views("x2", "x8") + _LIKELIHOOD)
def c7_likelihood_pairs(spark, sf_dir):
    a = view(spark, sf_dir, "x2")
    value = "CASE WHEN k = 3 AND item_id % 11 = 0 THEN NULL WHEN k = label THEN 3D ELSE CAST((k * 7 + annotator_id) % 3 AS DOUBLE) END"
    raw = a.withColumn("likelihoods", F.expr(f"map_from_entries(transform(sequence(0, 3), k -> struct(concat('c', k), {value})))"))
    names = spark.range(4).select(F.col("id").cast("int").alias("code"), F.concat(F.lit("c"), F.col("id")).alias("name"))
    rows = prep.likelihood_pairs(raw, view(spark, sf_dir, "x8").filter("y < 3"), a.filter("annotator_id < 15"), names)
    return _r(rows.select("item_id", "annotator_id", F.posexplode("p").alias("class", "p")), "p")


_U, _V = draw(PAIR, 7), draw(ITEM, 8)
_SUBSET = " SELECT item_id, annotator_id, label FROM (SELECT a.*, row_number() OVER (PARTITION BY a.item_id ORDER BY {order} DESC, annotator_id) rn, {v} AS v FROM (SELECT item_id, annotator_id, label, y FROM x2 JOIN x8 USING (item_id)) a) t WHERE {keep}"


@query(with_views("x2", "x8") + _SUBSET.format(order=_U, v=_V, keep="rn <= 2"))
def e4_random_labels(spark, sf_dir):
    return prep.annotation_subset(view(spark, sf_dir, "x2").drop("cycle"), "rand", 2, pair_draw=F.expr(_U), item_draw=F.expr(_V))


@query(with_views("x2", "x8") + _SUBSET.format(order=f"(CASE WHEN label <> y THEN 1 ELSE 0 END + {_U})", v=_V, keep="rn <= 2"))
def e5_worst_labels(spark, sf_dir):
    return prep.annotation_subset(view(spark, sf_dir, "x2").drop("cycle"), "worst", 2, view(spark, sf_dir, "x8"), pair_draw=F.expr(_U), item_draw=F.expr(_V))


@query(with_views("x2", "x8") + _SUBSET.format(order=_U, v=_V, keep="rn > floor(v * 3)"))
def e6_random_number_of_labels(spark, sf_dir):
    return prep.annotation_subset(view(spark, sf_dir, "x2").drop("cycle"), "rand-var", 3, pair_draw=F.expr(_U), item_draw=F.expr(_V))


@query(with_views("x2", "x8") + _SUBSET.format(order=f"(CASE WHEN label = y THEN 1 ELSE 0 END + {_U})", v=_V, keep="rn > floor(v * 3)"))
def e6_worst_number_of_labels(spark, sf_dir):
    return prep.annotation_subset(view(spark, sf_dir, "x2").drop("cycle"), "worst-var", 3, view(spark, sf_dir, "x8"), pair_draw=F.expr(_U), item_draw=F.expr(_V))


@query(with_views("x1") + " SELECT item_id, label, count(*) AS votes FROM x1 GROUP BY 1, 2")
def d1_votes(spark, sf_dir):
    return aggregate.votes(view(spark, sf_dir, "x1"))


_MV = "mv AS (SELECT item_id, arg_max(label, (n, -label)) AS label FROM (SELECT item_id, label, count(*) n FROM x2 GROUP BY 1, 2) GROUP BY 1)"


@query(with_views("x2") + f", {_MV} SELECT * FROM mv")
def d2_majority_vote(spark, sf_dir):
    return aggregate.majority_vote(view(spark, sf_dir, "x2"))


@query(with_views("x1") + " SELECT item_id, label AS class, round(count(*) / sum(count(*)) OVER (PARTITION BY item_id), 6) AS p FROM x1 GROUP BY 1, 2")
def d3_soft_votes(spark, sf_dir):
    return _r(aggregate.soft_votes(view(spark, sf_dir, "x1")), "p")


_SOFT = "sv AS (SELECT item_id, label AS class, count(*) / sum(count(*)) OVER (PARTITION BY item_id) AS p FROM x2 GROUP BY 1, 2)"
_CONF = _SOFT + """, n AS (SELECT annotator_id, class AS truth, label, sum(p) AS n FROM x2 JOIN sv USING (item_id) GROUP BY 1, 2, 3),
g AS (SELECT a.annotator_id, t.k AS truth, l.k AS label, coalesce(n, 0) + {prior} AS n FROM (SELECT DISTINCT annotator_id FROM x2) a, range(4) t(k), range(4) l(k) LEFT JOIN n ON n.annotator_id = a.annotator_id AND n.truth = t.k AND n.label = l.k)"""
_CONF_OUT = " SELECT annotator_id, CAST(truth AS INT) AS truth, CAST(label AS INT) AS label, round(CASE WHEN sum(n) OVER w > 0 THEN n / sum(n) OVER w ELSE 0.25 END, 6) AS p FROM g WINDOW w AS (PARTITION BY annotator_id, truth)"


@query(with_views("x2") + ", " + _CONF.format(prior="0.01") + _CONF_OUT)
def d4_confusions(spark, sf_dir):
    a = view(spark, sf_dir, "x2")
    return _r(aggregate.confusions(a, aggregate.soft_votes(a), K, 0.01), "p")


@query(with_views("x2") + ", " + _CONF.format(prior="0.5 + CASE WHEN t.k = l.k THEN 2.0 ELSE 0 END") + _CONF_OUT)
def d5_confusions_with_prior(spark, sf_dir):
    a = view(spark, sf_dir, "x2")
    return _r(aggregate.confusions_with_prior(a, aggregate.soft_votes(a), K, 1.5, 2.0), "p")


@query(with_views("x2") + f", {_SOFT} SELECT class, round(sum(p) / (SELECT count(DISTINCT item_id) FROM sv), 6) AS p FROM sv GROUP BY 1")
def d6_class_prior(spark, sf_dir):
    return _r(aggregate.class_prior(aggregate.soft_votes(view(spark, sf_dir, "x2"))), "p")


@query(with_views("x2", "x8") + """ SELECT a AS annotator_id, count(label) AS n_labels, round(coalesce(avg(CAST(label = y AS INT)), 0), 6) AS accuracy, round(count(label) / (SELECT count(*) FROM x8), 6) AS coverage
FROM range(21) r(a) LEFT JOIN (SELECT annotator_id, label, y FROM x2 JOIN x8 USING (item_id)) t ON annotator_id = a GROUP BY 1""")
def d7_annotator_report(spark, sf_dir):
    every = spark.range(21).withColumnRenamed("id", "annotator_id")
    return _r(metrics.annotator_report(view(spark, sf_dir, "x2"), view(spark, sf_dir, "x8"), every), "accuracy", "coverage")


@query(with_views("x2", "x8") + """, r AS (SELECT annotator_id, avg(CAST(label = y AS INT)) a FROM x2 JOIN x8 USING (item_id) GROUP BY 1)
SELECT count(*) AS n_labels, round(avg(CAST(label = y AS INT)), 6) AS accuracy, round(count(*) / ((SELECT count(*) FROM x8) * 20.0), 6) AS coverage,
 (SELECT round(avg(a), 6) FROM r) AS mean_accuracy, (SELECT round(stddev_pop(a), 6) FROM r) AS std_accuracy FROM x2 JOIN x8 USING (item_id)""")
def d7_pool_report(spark, sf_dir):
    a, items = view(spark, sf_dir, "x2"), view(spark, sf_dir, "x8")
    return _r(metrics.pool_report(metrics.annotator_report(a, items), a, items), "accuracy", "coverage", "mean_accuracy", "std_accuracy")


_COVERAGE = """SELECT CAST(sum(c) AS DOUBLE) AS label_total_pairs, CAST(count(*) AS DOUBLE) AS label_unique_samples, round(avg(c), 6) AS label_labels_per_sample_mean_covered,
 quantile_cont(c, 0.5) AS label_labels_per_sample_median_covered, quantile_cont(c, 0.75) AS label_labels_per_sample_p75_covered,
 CAST(min(c) AS DOUBLE) AS label_labels_per_sample_min_covered, CAST(max(c) AS DOUBLE) AS label_labels_per_sample_max_covered,
 round(avg(CAST(c >= 2 AS INT)), 6) AS label_frac_covered_ge2, round(avg(CAST(c >= 3 AS INT)), 6) AS label_frac_covered_ge3,
 round(count(*) / (SELECT count(*) FROM x8), 6) AS label_frac_covered FROM (SELECT item_id, count(*) c FROM x2 GROUP BY 1)"""
_ROUNDED = ("label_labels_per_sample_mean_covered", "label_frac_covered_ge2", "label_frac_covered_ge3", "label_frac_covered")


@query(with_views("x2", "x8") + " " + _COVERAGE)
def d8_coverage_metrics(spark, sf_dir):
    return _r(metrics.coverage_metrics(view(spark, sf_dir, "x2"), view(spark, sf_dir, "x8")), *_ROUNDED)


_MICRO = "SELECT round(avg(CAST(label = y AS INT)), 6) AS acc_pair_micro FROM x2 JOIN x8 USING (item_id)"
_MAJOR = "SELECT round(avg(CAST(label = y AS INT)), 6) AS acc_majority_vote FROM mv JOIN x8 USING (item_id)"
_TIES = "SELECT round(avg(CAST(t > 1 AS INT)), 6) AS acc_majority_vote_tie_rate FROM (SELECT item_id, count(*) FILTER (n = m) t FROM (SELECT item_id, count(*) n, max(count(*)) OVER (PARTITION BY item_id) m FROM x2 GROUP BY item_id, label) GROUP BY 1)"
_DIS = "SELECT round(avg(CAST(d > 1 AS INT)), 6) AS acc_disagreement_rate_multi FROM (SELECT item_id, count(*) c, count(DISTINCT label) d FROM x2 GROUP BY 1) WHERE c >= 2"
_ALLOC = """SELECT round(sum(CASE WHEN c > 0 THEN -c / t * ln(c / t) ELSE 0 END), 6) AS alloc_entropy, round(sum(CASE WHEN c > 0 THEN -c / t * ln(c / t) ELSE 0 END) / ln(max(n)), 6) AS alloc_entropy_norm,
 round((max(n) + 1 - 2 * sum(cum / t)) / max(n), 6) AS alloc_gini FROM (SELECT c, CAST(sum(c) OVER () AS DOUBLE) t, count(*) OVER () n, sum(c) OVER (ORDER BY c, a ROWS UNBOUNDED PRECEDING) cum
 FROM (SELECT a, count(label) c FROM range(21) r(a) LEFT JOIN x2 ON annotator_id = a GROUP BY 1))"""


@query(with_views("x2", "x8") + " " + _MICRO)
def d9_pair_accuracy(spark, sf_dir):
    return _r(metrics.pair_accuracy(view(spark, sf_dir, "x2"), view(spark, sf_dir, "x8")), "acc_pair_micro")


@query(with_views("x2", "x8") + f", {_MV} " + _MAJOR)
def d10_majority_accuracy(spark, sf_dir):
    return _r(metrics.majority_accuracy(view(spark, sf_dir, "x2"), view(spark, sf_dir, "x8")), "acc_majority_vote")


@query(with_views("x2") + " " + _TIES)
def d11_tie_rate(spark, sf_dir):
    return _r(metrics.tie_rate(view(spark, sf_dir, "x2")), "acc_majority_vote_tie_rate")


@query(with_views("x2") + " " + _DIS)
def d12_disagreement_rate(spark, sf_dir):
    return _r(metrics.disagreement_rate(view(spark, sf_dir, "x2")), "acc_disagreement_rate_multi")


@query(with_views("x2") + " " + _ALLOC)
def d13_d14_allocation(spark, sf_dir):
    every = spark.range(21).withColumnRenamed("id", "annotator_id")
    return _r(metrics.allocation_metrics(view(spark, sf_dir, "x2"), every), "alloc_entropy", "alloc_entropy_norm", "alloc_gini")


_DELTA = """SELECT CAST(count(*) AS DOUBLE) AS delta_new_pairs, round(avg(CAST(label = y AS INT)), 6) AS delta_new_pair_acc,
 CAST(count(DISTINCT CASE WHEN item_id NOT IN (SELECT item_id FROM x2 WHERE cycle < 15) THEN item_id END) AS DOUBLE) AS delta_new_unique_samples FROM x2 JOIN x8 USING (item_id) WHERE cycle >= 15"""


@query(with_views("x2", "x8") + " " + _DELTA)
def d15_delta_metrics(spark, sf_dir):
    a = view(spark, sf_dir, "x2")
    return _r(metrics.delta_metrics(a, _until(a), view(spark, sf_dir, "x8")), "delta_new_pair_acc")


_PRED = """SELECT round(avg(hit), 6) AS test_acc, (SELECT round(avg(r), 6) FROM (SELECT avg(hit) r FROM pr GROUP BY y)) AS test_balanced_acc, round(avg(loss), 6) AS test_log_loss, round(avg(brier), 6) AS test_brier_ovr FROM pr"""
_PRED_ROWS = """pr AS (SELECT x6.item_id, y, CAST(arg_max(class, (p, -class)) = y AS INT) hit, -ln(greatest(sum(CASE WHEN class = y THEN p END), 1e-15)) loss,
 sum((p - CAST(class = y AS INT)) * (p - CAST(class = y AS INT))) / 4 brier FROM x6 JOIN x8 ON x8.item_id = x6.item_id GROUP BY 1, 2)"""
_PRED_NAMES = ("test_acc", "test_balanced_acc", "test_log_loss", "test_brier_ovr")


def posterior_arrays(spark, sf_dir):
    """The class probabilities of view x6 as arrays."""
    return view(spark, sf_dir, "x6").groupBy("item_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("class", "p"))), lambda e: e["p"]).alias("p"))


@query(with_views("x6", "x8") + f", {_PRED_ROWS} " + _PRED)
def d16_d19_prediction_metrics(spark, sf_dir):
    return _r(metrics.prediction_metrics(posterior_arrays(spark, sf_dir), view(spark, sf_dir, "x8"), K), *_PRED_NAMES)


@query(with_views("x2", "x8", "x6") + f", {_MV}, {_PRED_ROWS} SELECT * FROM ({_COVERAGE}), ({_MICRO}), ({_MAJOR}), ({_TIES}), ({_DIS}), ({_ALLOC}), ({_DELTA}), ({_PRED})")
def d20_round_metrics(spark, sf_dir):
    a, items = view(spark, sf_dir, "x2"), view(spark, sf_dir, "x8")
    every = spark.range(21).withColumnRenamed("id", "annotator_id")
    out = metrics.round_metrics(a, items, every, _until(a), posterior_arrays(spark, sf_dir), items, K)
    return _r(out, *_ROUNDED, *_PRED_NAMES, "acc_pair_micro", "acc_majority_vote", "acc_majority_vote_tie_rate", "acc_disagreement_rate_multi", "alloc_entropy", "alloc_entropy_norm", "alloc_gini", "delta_new_pair_acc")


@query(with_views("x2", "x8") + """, f AS (SELECT cycle, count(*) i FROM (SELECT item_id, min(cycle) cycle FROM x2 GROUP BY 1) GROUP BY 1),
c AS (SELECT x2.cycle, count(*) n, sum(CAST(label = y AS INT)) r, max(coalesce(i, 0)) i FROM x2 JOIN x8 USING (item_id) LEFT JOIN f ON f.cycle = x2.cycle GROUP BY 1)
SELECT cycle, CAST(sum(n) OVER w AS BIGINT) AS label_total_pairs, CAST(sum(i) OVER w AS BIGINT) AS label_unique_samples, round(sum(r) OVER w / sum(n) OVER w, 6) AS acc_pair_micro,
 CAST(n AS BIGINT) AS delta_new_pairs, round(r / n, 6) AS delta_new_pair_acc, CAST(i AS BIGINT) AS delta_new_unique_samples FROM c WINDOW w AS (ORDER BY cycle)""")
def d20_e9_history_metrics(spark, sf_dir):
    return _r(metrics.history_metrics(view(spark, sf_dir, "x2"), view(spark, sf_dir, "x8")), "acc_pair_micro", "delta_new_pair_acc")


_CONF4 = ", " + _CONF.format(prior="0.01") + ", cf AS (SELECT annotator_id, truth, label, n / sum(n) OVER (PARTITION BY annotator_id, truth) AS p FROM g)"


@query(with_views("x2", "x6") + _CONF4 + " SELECT x6.item_id, annotator_id, round(sum(x6.p * cf.p), 6) AS p_correct FROM x6 JOIN cf ON truth = class AND label = truth GROUP BY 1, 2")
def c14_pair_correctness(spark, sf_dir):
    a = view(spark, sf_dir, "x2")
    return _r(aggregate.pair_accuracy_model(view(spark, sf_dir, "x6"), aggregate.confusions(a, aggregate.soft_votes(a), K, 0.01)), "p_correct")


@query(with_views("x2", "x6") + _CONF4 + " SELECT x6.item_id, annotator_id, CAST(label AS INT) AS label, round(sum(x6.p * cf.p), 6) AS p FROM x6 JOIN cf ON truth = class GROUP BY 1, 2, 3")
def c14_pair_labels(spark, sf_dir):
    a = view(spark, sf_dir, "x2")
    return _r(aggregate.pair_label_model(view(spark, sf_dir, "x6"), aggregate.confusions(a, aggregate.soft_votes(a), K, 0.01)), "p")
