"""Queries on uncertainty, gains, kernels, scorers, item selection and losses."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallywise.functions import arrays as A
from tallywise.operators import aggregate, kernel, learn, loss, scorers, select
from tallywise.queries.labels import _CONF4, ITEM, PAIR, K, _r, _until, posterior_arrays
from tallywise.queries.registry import query
from tallywise.sources import store
from tallywise.sources.staging import shared_dir
from tallywise.tables import draw, table, view, with_views

LN2 = "ln(2)"


def _confusions(spark, sf_dir):
    a = view(spark, sf_dir, "x2")
    return aggregate.confusions(a, aggregate.soft_votes(a), K, 0.01)


def _candidates(spark, sf_dir):
    """The pairs of the second half of the cycles; the first half is observed."""
    return view(spark, sf_dir, "x2").filter("cycle >= 15").select("item_id", "annotator_id")


def _observed(spark, sf_dir):
    return _until(view(spark, sf_dir, "x2")).select("item_id", "annotator_id", "label")


def _features(spark, sf_dir):
    return view(spark, sf_dir, "x8v").select("item_id", "x")


#: Of any (item_id, class, p): clipped and normalised, then entropy, margin and Brier.
_SCORES = """cl AS (SELECT item_id, class, greatest(p, 1e-12) / sum(greatest(p, 1e-12)) OVER (PARTITION BY item_id) AS p, row_number() OVER (PARTITION BY item_id ORDER BY p DESC) AS r FROM x6),
un AS (SELECT item_id, -sum(p * ln(p)) / ln(2) AS entropy, 1 - (max(p) - max(CASE WHEN r = 2 THEN p END)) AS margin, 1 - sum(p * p) AS brier FROM cl GROUP BY 1)"""


@query(with_views("x6") + f", {_SCORES} SELECT item_id, round(entropy, 6) AS entropy, round(margin, 6) AS margin, round(brier, 6) AS brier FROM un")
def g1_uncertainty(spark, sf_dir):
    p = posterior_arrays(spark, sf_dir)
    return _r(p.select("item_id", *[A.uncertainty(F.col("p"), s).alias(s) for s in ("entropy", "margin", "brier")]), "entropy", "margin", "brier")


def gain_sql(pc: str) -> str:
    """CTEs from ``pc`` (item_id, annotator_id, k, j, p, c) to ``gn`` (item_id, annotator_id, entropy, margin, brier)."""
    return f"""pc AS ({pc}),
jp AS (SELECT item_id, annotator_id, j, k, p * c AS v, sum(p * c) OVER (PARTITION BY item_id, annotator_id, j) AS m FROM pc),
qn AS (SELECT item_id, annotator_id, j, k, m, greatest(v / m, 1e-12) / sum(greatest(v / m, 1e-12)) OVER (PARTITION BY item_id, annotator_id, j) AS q FROM jp WHERE m > 1e-12),
qr AS (SELECT *, row_number() OVER (PARTITION BY item_id, annotator_id, j ORDER BY q DESC) AS r FROM qn),
aj AS (SELECT item_id, annotator_id, j, max(m) AS m, -sum(q * ln(q)) / {LN2} AS h, 1 - (max(q) - max(CASE WHEN r = 2 THEN q END)) AS g, 1 - sum(q * q) AS b FROM qr GROUP BY 1, 2, 3),
af AS (SELECT item_id, annotator_id, sum(m * h) AS h, sum(m * g) AS g, sum(m * b) AS b FROM aj GROUP BY 1, 2),
pk AS (SELECT item_id, annotator_id, k, greatest(p, 1e-12) / sum(greatest(p, 1e-12)) OVER (PARTITION BY item_id, annotator_id) AS p FROM pc WHERE j = 0),
pr AS (SELECT *, row_number() OVER (PARTITION BY item_id, annotator_id ORDER BY p DESC) AS r FROM pk),
bf AS (SELECT item_id, annotator_id, -sum(p * ln(p)) / {LN2} AS h, 1 - (max(p) - max(CASE WHEN r = 2 THEN p END)) AS g, 1 - sum(p * p) AS b FROM pr GROUP BY 1, 2),
gn AS (SELECT af.item_id, af.annotator_id, greatest(bf.h - af.h, 0) AS entropy, bf.g - af.g AS margin, greatest(bf.b - af.b, 0) AS brier FROM af JOIN bf ON bf.item_id = af.item_id AND bf.annotator_id = af.annotator_id)"""


_CAND = "SELECT item_id, annotator_id FROM x2 WHERE cycle >= 15"
_U = " SELECT item_id, annotator_id, round(entropy, 6) AS u FROM gn"
_FULL = f"SELECT a.item_id, a.annotator_id, truth AS k, cf.label AS j, x6.p, cf.p AS c FROM ({_CAND}) a JOIN x6 ON x6.item_id = a.item_id JOIN cf ON cf.annotator_id = a.annotator_id AND cf.truth = x6.class"


@query(with_views("x2", "x6") + _CONF4 + f", {gain_sql(_FULL)} SELECT item_id, annotator_id, round(entropy, 6) AS entropy, round(margin, 6) AS margin, round(brier, 6) AS brier FROM gn")
def g2_g3_expected_gain(spark, sf_dir):
    rows = _candidates(spark, sf_dir).join(posterior_arrays(spark, sf_dir), "item_id").join(scorers.confusion_arrays(_confusions(spark, sf_dir)), "annotator_id")
    return _r(rows.select("item_id", "annotator_id", *[A.expected_gain(F.col("p"), F.col("rows"), s).alias(s) for s in ("entropy", "margin", "brier")]), "entropy", "margin", "brier")


@query(with_views("x2", "x6") + _CONF4 + f", {gain_sql(_FULL)}" + _U)
def s3_information_gain(spark, sf_dir):
    return _r(scorers.information_gain(_candidates(spark, sf_dir), posterior_arrays(spark, sf_dir), scorers.confusion_arrays(_confusions(spark, sf_dir))), "u")


def _channel(spark, sf_dir):
    """theta per class and g (share of each label) of every annotator."""
    a = view(spark, sf_dir, "x2")
    theta = _confusions(spark, sf_dir).filter("truth = label").groupBy("annotator_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("truth", "p"))), lambda e: e["p"]).alias("theta"))
    g = a.groupBy("annotator_id").agg(F.array(*[F.avg((F.col("label") == k).cast("double")) for k in range(K)]).alias("g"))
    return theta.join(g, "annotator_id")


_CHANNEL = _CONF4 + f""", th AS (SELECT annotator_id, truth AS k, p AS t FROM cf WHERE truth = label),
gl AS (SELECT annotator_id, k AS j, avg(CAST(label = k AS INT)) AS g FROM x2, range({K}) r(k) GROUP BY 1, 2),
ch AS (SELECT th.annotator_id, th.k, gl.j, CASE WHEN th.k = gl.j THEN t WHEN 1 - o.g > 1e-12 THEN (1 - t) * gl.g / (1 - o.g) ELSE (1 - t) / 3 END AS c
 FROM th JOIN gl ON gl.annotator_id = th.annotator_id JOIN gl o ON o.annotator_id = th.annotator_id AND o.j = th.k)"""
_BY_CHANNEL = f"SELECT a.item_id, a.annotator_id, ch.k, ch.j, x6.p, ch.c FROM ({_CAND}) a JOIN x6 ON x6.item_id = a.item_id JOIN ch ON ch.annotator_id = a.annotator_id AND ch.k = x6.class"


@query(with_views("x2", "x6") + _CHANNEL + " SELECT annotator_id, CAST(k AS INT) AS truth, CAST(j AS INT) AS label, round(c, 6) AS p FROM ch")
def g4_channel_rows(spark, sf_dir):
    rows = _channel(spark, sf_dir).select("annotator_id", F.posexplode(A.channel_rows(F.col("theta"), F.col("g"))).alias("truth", "row"))
    return _r(rows.select("annotator_id", "truth", F.posexplode("row").alias("label", "p")), "p")


@query(with_views("x2", "x6") + _CHANNEL + " SELECT annotator_id, CAST(k AS INT) AS truth, CAST(j AS INT) AS label, round(CASE WHEN k = j THEN t ELSE (1 - t) / 3 END, 6) AS p FROM th, range(4) r(j)")
def g5_uniform_channel(spark, sf_dir):
    rows = _channel(spark, sf_dir).select("annotator_id", F.posexplode(A.uniform_channel(F.col("theta"))).alias("truth", "row"))
    return _r(rows.select("annotator_id", "truth", F.posexplode("row").alias("label", "p")), "p")


@query(with_views("x2", "x6") + _CHANNEL.replace("avg(CAST(label = k AS INT)) AS g", "(0.25 + count(*) FILTER (label = k)) / (1 + count(*)) AS g") + " SELECT annotator_id, CAST(k AS INT) AS truth, CAST(j AS INT) AS label, round(c, 6) AS p FROM ch")
def g6_wrong_label_channel(spark, sf_dir):
    gamma = view(spark, sf_dir, "x2").groupBy("annotator_id").agg(F.array(*[0.25 + F.count(F.when(F.col("label") == k, 1)) for k in range(K)]).alias("gamma"))
    rows = _channel(spark, sf_dir).join(gamma, "annotator_id").select("annotator_id", F.posexplode(A.wrong_label_channel(F.col("theta"), F.col("gamma"))).alias("truth", "row"))
    return _r(rows.select("annotator_id", "truth", F.posexplode("row").alias("label", "p")), "p")


@query(with_views("x2", "x6") + _CHANNEL + f", {gain_sql(_BY_CHANNEL)}" + _U)
def s3_information_gain_channel(spark, sf_dir):
    return _r(scorers.information_gain(_candidates(spark, sf_dir), posterior_arrays(spark, sf_dir), _channel(spark, sf_dir), "channel"), "u")


_ACC = "ac AS (SELECT annotator_id, avg(CAST(label = y AS INT)) AS t FROM x2 JOIN x8 USING (item_id) GROUP BY 1)"
_BY_UNIFORM = f"SELECT a.item_id, a.annotator_id, k, j, 0.25 AS p, CASE WHEN k = j THEN t ELSE (1 - t) / 3 END AS c FROM ({_CAND}) a JOIN ac ON ac.annotator_id = a.annotator_id JOIN (SELECT DISTINCT item_id FROM x6) i ON i.item_id = a.item_id, range({K}) r(k), range({K}) s(j)"


def _accuracy(spark, sf_dir):
    return view(spark, sf_dir, "x2").join(view(spark, sf_dir, "x8"), "item_id").groupBy("annotator_id").agg(F.avg((F.col("label") == F.col("y")).cast("double")).alias("theta"))


@query(with_views("x2", "x6", "x8") + f", {_ACC}, {gain_sql(_BY_UNIFORM)}" + _U)
def s3_information_gain_uniform(spark, sf_dir):
    return _r(scorers.information_gain(_candidates(spark, sf_dir), posterior_arrays(spark, sf_dir), _accuracy(spark, sf_dir), **scorers.PRESETS["ig_gain"]), "u")


@query(with_views("x2") + f" SELECT item_id, annotator_id, round({draw(PAIR, 12)}, 6) AS u FROM x2 WHERE cycle >= 15")
def s1_random(spark, sf_dir):
    return _r(scorers.random_scores(_candidates(spark, sf_dir), drawn=F.expr(draw(PAIR, 12))), "u")


@query(with_views("x2", "x6") + _CONF4 + f" SELECT a.item_id, a.annotator_id, round(sum(x6.p * cf.p), 6) AS u FROM ({_CAND}) a JOIN x6 ON x6.item_id = a.item_id JOIN cf ON cf.annotator_id = a.annotator_id AND truth = class AND label = truth GROUP BY 1, 2")
def s2_performance(spark, sf_dir):
    long = view(spark, sf_dir, "x6")
    return _r(scorers.performance(_candidates(spark, sf_dir), aggregate.pair_accuracy_model(long, _confusions(spark, sf_dir))), "u")


_UNIT = "dv AS (SELECT item_id, y, CAST(x AS DOUBLE[]) AS x FROM x8v), ux AS (SELECT item_id, y, list_transform(x, lambda v: v / greatest(sqrt(list_dot_product(x, x)), 1e-12)) AS z FROM dv)"
_MEAN = "mv AS (SELECT annotator_id, list(v ORDER BY i) AS m FROM (SELECT annotator_id, i, avg(z[i]) AS v FROM x2 JOIN ux USING (item_id), range(1, 65) r(i) WHERE cycle < 15 GROUP BY 1, 2) GROUP BY 1)"


@query(with_views("x2", "x8v") + f", {_UNIT}, {_MEAN} SELECT a.item_id, a.annotator_id, round(coalesce(1 - list_dot_product(z, m), 2), 6) AS u FROM ({_CAND}) a JOIN ux ON ux.item_id = a.item_id LEFT JOIN mv ON mv.annotator_id = a.annotator_id")
def s4_semantic_diversity(spark, sf_dir):
    return _r(scorers.semantic_diversity(_candidates(spark, sf_dir), _features(spark, sf_dir), _observed(spark, sf_dir)), "u")


_REPR = """jt AS (SELECT annotator_id, list_transform(list_concat(z, [CAST(label = 0 AS DOUBLE), CAST(label = 1 AS DOUBLE), CAST(label = 2 AS DOUBLE), CAST(label = 3 AS DOUBLE)]), lambda v: v / sqrt(list_dot_product(z, z) + 1)) AS w FROM x2 JOIN ux USING (item_id) WHERE cycle < 15),
mm AS (SELECT annotator_id, list(v ORDER BY i) AS m FROM (SELECT annotator_id, i, avg(w[i]) AS v FROM jt, range(1, 69) r(i) GROUP BY 1, 2) GROUP BY 1),
vv AS (SELECT annotator_id, list_transform(m, lambda v: v / sqrt(list_dot_product(m, m))) AS v FROM mm)"""


@query(with_views("x2", "x8v") + f", {_UNIT}, {_REPR}, cd AS ({_CAND}) SELECT a.item_id, a.annotator_id, round(CASE WHEN count(w.v) = 0 THEN 0 ELSE avg(1 - list_dot_product(v.v, w.v)) END, 6) AS u FROM cd a JOIN vv v ON v.annotator_id = a.annotator_id LEFT JOIN (SELECT cd.item_id, cd.annotator_id, v FROM cd JOIN vv ON vv.annotator_id = cd.annotator_id) w ON w.item_id = a.item_id AND w.annotator_id <> a.annotator_id GROUP BY 1, 2")
def s5_representation_diversity(spark, sf_dir):
    return _r(scorers.representation_diversity(_candidates(spark, sf_dir), _features(spark, sf_dir), _observed(spark, sf_dir), K), "u")


_D2 = "d2 AS (SELECT a.item_id, b.item_id AS other_id, power(list_distance(a.x, b.x), 2) AS d2 FROM dv a, dv b)"


@query(with_views("x8v") + f", {_UNIT}, {_D2} SELECT item_id, other_id, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(d2, 9), other_id) r FROM d2 WHERE item_id <> other_id) WHERE r <= 5")
def c8_nearest(spark, sf_dir):
    return kernel.nearest(_features(spark, sf_dir), 5).select("item_id", "other_id", "rank")


_KNN = f"{_UNIT}, {_D2}, nb AS (SELECT d2.item_id, y AS class, row_number() OVER (PARTITION BY d2.item_id ORDER BY d2, other_id) r FROM d2 JOIN dv ON dv.item_id = other_id WHERE d2.item_id <> other_id), nl AS (SELECT item_id, class, count(*) / 10 AS p FROM nb WHERE r <= 10 GROUP BY 1, 2)"


@query(with_views("x8v") + f", {_KNN} SELECT item_id, class, round(p, 6) AS p FROM nl")
def d31_neighbour_labels(spark, sf_dir):
    x = view(spark, sf_dir, "x8v")
    return _r(kernel.neighbour_labels(x.select("item_id", "x"), x, 10), "p")


@query(with_views("x8v") + f", {_KNN}, df AS (SELECT item_id, power(-sum(p * ln(p)) / ln(4), 2) AS d FROM nl GROUP BY 1) SELECT item_id, round(d, 6) AS difficulty, round(d - avg(d) OVER (), 6) AS centred FROM df")
def d32_difficulty(spark, sf_dir):
    x = view(spark, sf_dir, "x8v")
    return _r(kernel.difficulty(kernel.neighbour_labels(x.select("item_id", "x"), x, 10), K, alpha=2.0), "difficulty", "centred")


@query(with_views("x8v") + f""", {_KNN}, ce AS (SELECT item_id, item_id % 7 AS cluster, y FROM dv),
fl AS (SELECT cluster, y, k AS class, coalesce(p, 0) AS p FROM ce CROSS JOIN range({K}) r(k) LEFT JOIN nl ON nl.item_id = ce.item_id AND nl.class = k),
ow AS (SELECT cluster, y, class, avg(p) AS o, count(*) AS n FROM fl GROUP BY 1, 2, 3), ba AS (SELECT y, class, avg(p) AS b FROM fl GROUP BY 1, 2),
rw AS (SELECT cluster, ow.y, ow.class, CASE WHEN ow.y = ow.class THEN 0 WHEN n >= 18 THEN o + 1e-3 ELSE b + 1e-3 END AS v FROM ow JOIN ba ON ba.y = ow.y AND ba.class = ow.class)
SELECT cluster, y, CAST(class AS INT) AS class, round(v / sum(v) OVER (PARTITION BY cluster, y), 6) AS p FROM rw""")
def d30_ambiguity_templates(spark, sf_dir):
    x = view(spark, sf_dir, "x8v")
    cells = x.select("item_id", (F.col("item_id") % 7).alias("cluster"), "y")
    return _r(kernel.ambiguity_templates(kernel.neighbour_labels(x.select("item_id", "x"), x, 10), cells, K, 18), "p")


@query(with_views("x8v") + f", {_UNIT}, {_D2} SELECT round(power(greatest(median(sqrt(d2)), 1e-3), -2), 6) AS gamma FROM d2 WHERE item_id < other_id")
def g9_bandwidth(spark, sf_dir):
    return _r(kernel.bandwidth(_features(spark, sf_dir)), "gamma")


_OBS = "ob AS (SELECT item_id, annotator_id, label FROM x2 WHERE cycle < 15)"
_EV = _OBS + ", ev AS (SELECT ob.item_id, ob.annotator_id, x6.p AS score FROM ob JOIN x6 ON x6.item_id = ob.item_id AND x6.class = ob.label)"


@query(with_views("x2", "x6") + f", {_EV} SELECT annotator_id, round(avg(score), 6) AS accuracy, (SELECT round(avg(score), 6) FROM ev) AS overall FROM ev GROUP BY 1")
def d29_evidence_means(spark, sf_dir):
    return _r(kernel.evidence_means(kernel.model_correctness(_observed(spark, sf_dir), view(spark, sf_dir, "x6"))), "accuracy", "overall")


_BETA = f"""{_UNIT}, {_EV}, pt AS (SELECT ev.*, x FROM ev JOIN dv ON dv.item_id = ev.item_id),
gm AS (SELECT a.annotator_id, coalesce(power(greatest(median(list_distance(a.x, b.x)) FILTER (a.item_id < b.item_id), 1e-3), -2), 1e6) AS g FROM pt a JOIN pt b ON a.annotator_id = b.annotator_id GROUP BY 1),
kw AS (SELECT c.item_id, pt.annotator_id, score, exp(-g * power(list_distance(c.x, pt.x), 2)) AS k FROM (SELECT * FROM dv WHERE item_id IN (SELECT item_id FROM x2 WHERE cycle >= 15)) c, pt JOIN gm ON gm.annotator_id = pt.annotator_id),
sm AS (SELECT item_id, annotator_id, sum(k) AS mass, sum(k * score) AS s, sum(k * k) AS m2 FROM kw GROUP BY 1, 2)"""


@query(with_views("x2", "x6", "x8v") + f""", {_BETA}, ab AS (SELECT a.item_id, a.annotator_id, 9 + coalesce(mass * mass / greatest(m2, 1e-12), 0) * CASE WHEN coalesce(mass, 0) > 1e-12 THEN s / mass ELSE 0.5 END AS al, coalesce(mass * mass / greatest(m2, 1e-12), 0) AS n FROM ({_CAND}) a LEFT JOIN sm ON sm.item_id = a.item_id AND sm.annotator_id = a.annotator_id)
SELECT item_id, annotator_id, round(al / (10 + n), 6) AS u FROM ab""")
def s6_g10_beta_model(spark, sf_dir):
    evidence = kernel.model_correctness(_observed(spark, sf_dir), view(spark, sf_dir, "x6"))
    return _r(scorers.beta_model(_candidates(spark, sf_dir), _features(spark, sf_dir), evidence, **scorers.PRESETS["beta"]), "u")


@query()
def s6_g13_thompson_draws(spark, sf_dir):
    evidence = kernel.model_correctness(_observed(spark, sf_dir), view(spark, sf_dir, "x6"))
    return scorers.beta_model(_candidates(spark, sf_dir), _features(spark, sf_dir), evidence, draw=True, seed=3)


#: Weights between unit vectors at a fixed bandwidth.
_KW = "kw AS (SELECT a.item_id, b.item_id AS other_id, exp(-0.5 * power(list_distance(a.z, b.z), 2)) AS k FROM ux a, ux b WHERE b.item_id IN (SELECT item_id FROM x2 WHERE cycle < 15))"


@query(with_views("x2", "x8v") + f", {_UNIT}, {_KW} SELECT item_id, other_id, round(0.25 + 0.75 * k, 6) AS k FROM kw")
def c9_g7_g8_kernel_weights(spark, sf_dir):
    unit = kernel.unit_vectors(_features(spark, sf_dir))
    seen = unit.join(_observed(spark, sf_dir), "item_id", "left_semi")
    return _r(kernel.kernel_weights(unit, seen, kernel.bandwidth(unit, 0.5), 0.25), "k")


@query(with_views("x2", "x8v") + f", {_UNIT}, {_MEAN} SELECT a.annotator_id, b.annotator_id AS other, round(CASE WHEN a.annotator_id = b.annotator_id THEN 1 ELSE power(greatest(list_dot_product(a.m, b.m) / sqrt(list_dot_product(a.m, a.m)) / sqrt(list_dot_product(b.m, b.m)), 0), 2) END, 6) AS w FROM mv a, mv b")
def c10_annotator_similarity(spark, sf_dir):
    unit = kernel.unit_vectors(_features(spark, sf_dir))
    vectors = scorers._mean_vectors(_observed(spark, sf_dir).join(unit, "item_id").select("annotator_id", "x")).withColumnRenamed("m", "x")
    return _r(kernel.annotator_similarity(vectors, power=2.0), "w")


@query(with_views("x2", "x6", "x8v") + f", {_UNIT}, {_KW}, {_EV}, pa AS (SELECT a.item_id, a.annotator_id, sum(k) AS m, sum(k * CAST(a.label = b.label AS INT)) AS s FROM ob a JOIN kw ON kw.item_id = a.item_id JOIN ob b ON b.item_id = kw.other_id AND b.annotator_id <> a.annotator_id GROUP BY 1, 2) SELECT ev.item_id, ev.annotator_id, round(CASE WHEN coalesce(m, 0) > 1e-12 THEN s / m ELSE score END, 6) AS score FROM ev LEFT JOIN pa ON pa.item_id = ev.item_id AND pa.annotator_id = ev.annotator_id")
def c11_peer_agreement(spark, sf_dir):
    unit, obs = kernel.unit_vectors(_features(spark, sf_dir)), _observed(spark, sf_dir)
    seen = unit.join(obs, "item_id", "left_semi")
    return _r(kernel.peer_agreement(obs, seen, kernel.bandwidth(unit, 0.5), kernel.model_correctness(obs, view(spark, sf_dir, "x6"))), "score")


@query(with_views("x2", "x8v") + f", {_UNIT}, {_KW}, {_OBS}, s AS (SELECT kw.item_id, annotator_id, label, sum(k) AS c FROM kw JOIN ob ON ob.item_id = kw.other_id GROUP BY 1, 2, 3) SELECT p.item_id, p.annotator_id, CAST(j AS INT) AS class, round(0.25 + coalesce(c, 0), 6) AS gamma FROM (SELECT DISTINCT item_id, annotator_id FROM s) p CROSS JOIN range(4) r(j) LEFT JOIN s ON s.item_id = p.item_id AND s.annotator_id = p.annotator_id AND s.label = j")
def g11_dirichlet_posterior(spark, sf_dir):
    unit, obs = kernel.unit_vectors(_features(spark, sf_dir)), _observed(spark, sf_dir)
    seen = unit.join(obs, "item_id", "left_semi")
    return _r(kernel.dirichlet_posterior(unit, seen, obs, kernel.bandwidth(unit, 0.5), K, 0.25).select("item_id", "annotator_id", F.posexplode("gamma").alias("class", "gamma")), "gamma")


_CONC = """ic AS (SELECT item_id, sum(k) AS n FROM kw GROUP BY 1), pn AS (SELECT kw.item_id, annotator_id, sum(k) AS n FROM kw JOIN ob ON ob.item_id = kw.other_id GROUP BY 1, 2)"""
_KEIG = f"""SELECT a.item_id, a.annotator_id, x6.class AS k, j, (0.25 + ic.n * x6.p) / (1 + ic.n * sum(x6.p) OVER (PARTITION BY a.item_id, a.annotator_id, j)) AS p,
 CASE WHEN x6.class = j THEN th ELSE (1 - th) / 3 END AS c FROM (SELECT a.item_id, a.annotator_id, (9.5 + coalesce(pn.n, 0) * t) / (10 + coalesce(pn.n, 0)) AS th FROM ({_CAND}) a JOIN ac ON ac.annotator_id = a.annotator_id LEFT JOIN pn ON pn.item_id = a.item_id AND pn.annotator_id = a.annotator_id) a
 JOIN x6 ON x6.item_id = a.item_id JOIN ic ON ic.item_id = a.item_id CROSS JOIN range({K}) r(j)"""


@query(with_views("x2", "x6", "x8", "x8v") + f", {_UNIT}, {_KW}, {_OBS}, {_ACC}, {_CONC}, {gain_sql(_KEIG)}" + _U)
def s7_g12_kernel_evidence_gain(spark, sf_dir):
    out = scorers.kernel_evidence_gain(_candidates(spark, sf_dir), _features(spark, sf_dir), _observed(spark, sf_dir), posterior_arrays(spark, sf_dir), _accuracy(spark, sf_dir), gamma=0.5)
    return _r(out, "u")


_KS = f"""SELECT a.item_id, a.annotator_id, x6.class AS k, j, x6.p, CASE WHEN x6.class = j THEN th ELSE (1 - th) * g / (tot - own) END AS c FROM (
 SELECT a.item_id, a.annotator_id, k0, j, coalesce(l.c, 0) + 0.25 AS g, sum(coalesce(l.c, 0) + 0.25) OVER (PARTITION BY a.item_id, a.annotator_id, k0) AS tot, sum(CASE WHEN j = k0 THEN coalesce(l.c, 0) + 0.25 END) OVER (PARTITION BY a.item_id, a.annotator_id, k0) AS own,
  (10 * ac + coalesce(b.s, 0)) / (10 + coalesce(b.m, 0)) AS th
 FROM ({_CAND}) a CROSS JOIN (SELECT avg(score) AS ac FROM ev) CROSS JOIN range({K}) r(k0) CROSS JOIN range({K}) q(j)
 LEFT JOIN lc l ON l.item_id = a.item_id AND l.annotator_id = a.annotator_id AND l.label = j LEFT JOIN bs b ON b.item_id = a.item_id AND b.annotator_id = a.annotator_id) a
 JOIN x6 ON x6.item_id = a.item_id AND x6.class = k0"""
_KSUM = "lc AS (SELECT kw.item_id, annotator_id, label, sum(k) AS c FROM kw JOIN ob ON ob.item_id = kw.other_id GROUP BY 1, 2, 3), bs AS (SELECT kw.item_id, annotator_id, sum(k) AS m, sum(k * score) AS s FROM kw JOIN ev ON ev.item_id = kw.other_id GROUP BY 1, 2)"


@query(with_views("x2", "x6", "x8v") + f", {_UNIT}, {_KW}, {_EV}, {_KSUM}, {gain_sql(_KS)}" + _U)
def s8_kernel_smoothed_gain(spark, sf_dir):
    out = scorers.kernel_smoothed_gain(_candidates(spark, sf_dir), _features(spark, sf_dir), _observed(spark, sf_dir), posterior_arrays(spark, sf_dir), K, gamma=0.5)
    return _r(out, "u")


def _smoothed(spark, sf_dir, *args, **kw):
    return scorers.kernel_smoothed_gain(_candidates(spark, sf_dir), _features(spark, sf_dir), _observed(spark, sf_dir), posterior_arrays(spark, sf_dir), K, *args, **kw)


#: P(correct) with the annotator's own mean agreement as prior, and uniform wrong labels.
_KS_OWN = f"""SELECT a.item_id, a.annotator_id, x6.class AS k, j, x6.p, CASE WHEN x6.class = j THEN th ELSE (1 - th) / 3 END AS c FROM (
 SELECT a.item_id, a.annotator_id, (10 * coalesce(oa.ac, al.ac) + coalesce(b.s, 0)) / (10 + coalesce(b.m, 0)) AS th
 FROM ({_CAND}) a CROSS JOIN (SELECT avg(score) AS ac FROM ev) al LEFT JOIN (SELECT annotator_id, avg(score) AS ac FROM ev GROUP BY 1) oa ON oa.annotator_id = a.annotator_id
 LEFT JOIN bs b ON b.item_id = a.item_id AND b.annotator_id = a.annotator_id) a JOIN x6 ON x6.item_id = a.item_id CROSS JOIN range({K}) q(j)"""


@query(with_views("x2", "x6", "x8v") + f", {_UNIT}, {_KW}, {_EV}, {_KSUM}, {gain_sql(_KS_OWN)}" + _U)
def s8_kernel_smoothed_gain_uniform(spark, sf_dir):
    return _r(_smoothed(spark, sf_dir, "uniform", gamma=0.5, accuracy_mean="per_annotator_observed"), "u")


#: Confusion rows from the kernel-weighted soft counts of (class, label) over a Dirichlet prior; the diagonal form keeps P(correct) alone.
_KS_CELLS = f"""cells AS (SELECT kw.item_id, ob.annotator_id, x6.class AS k, label AS j, sum(kw.k * x6.p) AS n FROM kw JOIN ob ON ob.item_id = kw.other_id JOIN x6 ON x6.item_id = ob.item_id GROUP BY 1, 2, 3, 4),
cn AS (SELECT a.item_id, a.annotator_id, k0 AS k, j0 AS j, CASE WHEN k0 = j0 THEN 10 * ac ELSE 10 * (1 - ac) / 3 END + coalesce(n, 0) AS n FROM ({_CAND}) a CROSS JOIN (SELECT avg(score) AS ac FROM ev) CROSS JOIN range({K}) r(k0) CROSS JOIN range({K}) q(j0)
 LEFT JOIN cells ON cells.item_id = a.item_id AND cells.annotator_id = a.annotator_id AND cells.k = k0 AND cells.j = j0),
cf AS (SELECT item_id, annotator_id, k, j, n / sum(n) OVER (PARTITION BY item_id, annotator_id, k) AS c FROM cn)"""
_KS_FULL = "SELECT cf.item_id, cf.annotator_id, cf.k, cf.j, x6.p, cf.c FROM cf JOIN x6 ON x6.item_id = cf.item_id AND x6.class = cf.k"
_KS_DIAGONAL = "SELECT cf.item_id, cf.annotator_id, cf.k, cf.j, x6.p, CASE WHEN cf.k = cf.j THEN d.c ELSE (1 - d.c) / 3 END AS c FROM cf JOIN cf d ON d.item_id = cf.item_id AND d.annotator_id = cf.annotator_id AND d.k = cf.k AND d.j = cf.k JOIN x6 ON x6.item_id = cf.item_id AND x6.class = cf.k"


@query(with_views("x2", "x6", "x8v") + f", {_UNIT}, {_KW}, {_EV}, {_KS_CELLS}, {gain_sql(_KS_FULL)}" + _U)
def s8_kernel_smoothed_gain_confusions(spark, sf_dir):
    return _r(_smoothed(spark, sf_dir, "full", gamma=0.5), "u")


@query(with_views("x2", "x6", "x8v") + f", {_UNIT}, {_KW}, {_EV}, {_KS_CELLS}, {gain_sql(_KS_DIAGONAL)}" + _U)
def s8_kernel_smoothed_gain_diagonal(spark, sf_dir):
    return _r(_smoothed(spark, sf_dir, "diagonal", gamma=0.5), "u")


#: A kernel for each annotator, at the median distance of the items that it labelled.
_KW_OWN = """gs AS (SELECT a.annotator_id, coalesce(power(greatest(median(list_distance(ua.z, ub.z)) FILTER (a.item_id < b.item_id), 1e-3), -2), 1) AS g FROM ob a JOIN ob b ON a.annotator_id = b.annotator_id JOIN ux ua ON ua.item_id = a.item_id JOIN ux ub ON ub.item_id = b.item_id GROUP BY 1),
bs AS (SELECT c.item_id, ev.annotator_id, sum(exp(-g * power(list_distance(c.z, o.z), 2))) AS m, sum(exp(-g * power(list_distance(c.z, o.z), 2)) * score) AS s FROM ev JOIN gs ON gs.annotator_id = ev.annotator_id JOIN ux o ON o.item_id = ev.item_id CROSS JOIN ux c GROUP BY 1, 2)"""


@query(with_views("x2", "x6", "x8v") + f", {_UNIT}, {_EV}, {_KW_OWN}, {gain_sql(_KS_OWN)}" + _U)
def s8_bandwidth_per_annotator(spark, sf_dir):
    return _r(_smoothed(spark, sf_dir, "uniform", gamma_scope="per_annotator", accuracy_mean="per_annotator_observed"), "u")


@query()
def s8_g13_mean_of_draws(spark, sf_dir):
    """Gains averaged over 8 draws of P(correct) and of the label distribution."""
    return _smoothed(spark, sf_dir, gamma=0.5, draws=8, draw_labels=True, seed=3)


@query()
def s7_g13_mean_of_draws(spark, sf_dir):
    """Gains averaged over 8 draws of P(correct) and of the class probabilities."""
    out = scorers.kernel_evidence_gain(_candidates(spark, sf_dir), _features(spark, sf_dir), _observed(spark, sf_dir), posterior_arrays(spark, sf_dir), _accuracy(spark, sf_dir), gamma=0.5, draws=8, draw_classes=True, seed=3)
    return out


@query(with_views("x2") + " SELECT DISTINCT item_id FROM x2 WHERE cycle < 15")
def f9_labelled_items(spark, sf_dir):
    return _observed(spark, sf_dir).select("item_id").distinct()


@query(with_views("x2", "x8v") + " SELECT item_id, len(x) AS dims FROM x8v WHERE item_id IN (SELECT item_id FROM x2 WHERE cycle >= 15 UNION SELECT item_id FROM x2 WHERE cycle < 15)")
def f7_candidate_and_history_items(spark, sf_dir):
    """Features of the items that are candidates or have labels, each item once."""
    either = _candidates(spark, sf_dir).select("item_id").union(_observed(spark, sf_dir).select("item_id")).distinct()
    return _features(spark, sf_dir).join(either, "item_id", "left_semi").select("item_id", F.size("x").cast("long").alias("dims"))


@query()
def k7_clusters(spark, sf_dir):
    return learn.clusters(_features(spark, sf_dir), 8, seed=1)


@query(with_views("x4") + " SELECT run_id, step, 'acc' AS key, value FROM x4 WHERE step % 512 = 0 ORDER BY 1, 2")
def a10_log_run(spark, sf_dir):
    """The metric history through the long tables of the run log."""
    import uuid

    root = f"{shared_dir(spark)}/log-{uuid.uuid4().hex}"
    x4 = view(spark, sf_dir, "x4")
    metrics = x4.select("run_id", "step", F.lit("acc").alias("key"), "value")
    params = x4.select("run_id", F.lit("dataset").alias("key"), F.col("dataset").alias("value")).distinct()
    store.log_run(params, metrics, root, 512)
    return spark.read.parquet(f"{root}/metrics").select("run_id", "step", "key", "value")


@query()
def s8_kernel_smoothed_gain_full(spark, sf_dir):
    return scorers.kernel_smoothed_gain(_candidates(spark, sf_dir), _features(spark, sf_dir), _observed(spark, sf_dir), posterior_arrays(spark, sf_dir), K, "full", class_prior="kernel")


@query()
def s8_g14_upper_quantile(spark, sf_dir):
    return scorers.kernel_smoothed_gain(_candidates(spark, sf_dir), _features(spark, sf_dir), _observed(spark, sf_dir), posterior_arrays(spark, sf_dir), K, top_m=2, ucb=0.9, use_ess=True)


@query(with_views("x6") + ", t AS (SELECT item_id, p, row_number() OVER (PARTITION BY item_id ORDER BY p DESC) AS r FROM x6) SELECT item_id, CAST(least(r, 3) - 1 AS INT) AS slot, round(sum(p) / sum(sum(p)) OVER (PARTITION BY item_id), 6) AS p FROM t GROUP BY item_id, least(r, 3)")
def f2_top_classes(spark, sf_dir):
    return _r(posterior_arrays(spark, sf_dir).select("item_id", F.posexplode(A.top_classes(F.col("p"), 2)).alias("slot", "p")), "p")


@query(with_views("x2", "x8v") + f", {_UNIT}, {_MEAN}, e AS (SELECT item_id, annotator_id, 1 / (1 + exp(-(list_dot_product(z, m) + 0.5))) AS t FROM ux, mv) SELECT item_id, annotator_id, round(t, 6) AS p_correct FROM e")
def g19_low_rank_expertise(spark, sf_dir):
    unit = kernel.unit_vectors(_features(spark, sf_dir))
    v = scorers._mean_vectors(_observed(spark, sf_dir).join(unit, "item_id").select("annotator_id", "x"))
    return _r(unit.crossJoin(F.broadcast(v)).select("item_id", "annotator_id", A.expertise(F.col("x"), F.col("m"), 0.5).alias("p_correct")), "p_correct")


@query(with_views("x8") + f" SELECT item_id FROM x8 ORDER BY {draw(ITEM, 9)}, item_id LIMIT 64")
def q1_random_items(spark, sf_dir):
    return select.random_items(view(spark, sf_dir, "x8"), 64, drawn=F.expr(draw(ITEM, 9)))


@query(with_views("x6") + f", {_SCORES} SELECT item_id FROM un ORDER BY round(margin, 9) DESC, item_id LIMIT 64")
def q2_margin_items(spark, sf_dir):
    return select.margin_items(posterior_arrays(spark, sf_dir), 64)


@query()
def q3_k7_typical_items(spark, sf_dir):
    return select.typical_items(_features(spark, sf_dir), _observed(spark, sf_dir).filter("annotator_id = 0"), 16)


@query()
def q4_gradient_items(spark, sf_dir):
    return select.gradient_items(_features(spark, sf_dir), posterior_arrays(spark, sf_dir), 16)


@query()
def q5_uncertain_spread_items(spark, sf_dir):
    return select.uncertain_spread_items(posterior_arrays(spark, sf_dir), 16)


_HEADS = "lp AS (SELECT h AS head, item_id, class, ln(p * (1 - 0.1 * h) + 0.025 * h) AS logp FROM x6, range(3) r(h))"
_T = "tg AS (SELECT item_id, label AS class, count(*) / sum(count(*)) OVER (PARTITION BY item_id) AS t FROM x2 GROUP BY 1, 2)"


def _heads(spark, sf_dir):
    return view(spark, sf_dir, "x6").crossJoin(spark.range(3).withColumnRenamed("id", "head")).select("head", "item_id", F.col("class").cast("int").alias("class"), F.ln(F.col("p") * (1 - 0.1 * F.col("head")) + 0.025 * F.col("head")).alias("logp"))


@query(with_views("x2", "x6") + f", {_HEADS}, {_T} SELECT head, lp.item_id, round(sum(t * (ln(t) - logp)), 6) AS loss FROM lp JOIN tg ON tg.item_id = lp.item_id AND tg.class = lp.class GROUP BY 1, 2")
def d34_soft_target_divergence(spark, sf_dir):
    t = aggregate.soft_votes(view(spark, sf_dir, "x2")).withColumnRenamed("p", "t")
    return _r(loss.divergence(_heads(spark, sf_dir), t, "none"), "loss")


@query(with_views("x6", "x8") + f", {_HEADS}, rk AS (SELECT head, item_id, row_number() OVER (PARTITION BY head ORDER BY {draw('item_id * 3 + head', 10)}, item_id) r, count(*) OVER (PARTITION BY head) n FROM (SELECT DISTINCT head, item_id FROM lp)) SELECT round(avg(-logp), 6) AS loss FROM lp JOIN x8 ON x8.item_id = lp.item_id AND y = class JOIN rk ON rk.head = lp.head AND rk.item_id = lp.item_id WHERE r > round(n * 0.25)")
def d34_d35_masked_likelihood(spark, sf_dir):
    heads = _heads(spark, sf_dir)
    mask = loss.bootstrap_mask(heads, 0.25, drawn=F.expr(draw("item_id * 3 + head", 10)))
    return _r(loss.divergence(heads, view(spark, sf_dir, "x8").withColumnRenamed("y", "label"), mask=mask), "loss")


@query()
def k4_crowd_layer(spark, sf_dir):
    return learn.crowd_layer(_observed(spark, sf_dir), _features(spark, sf_dir), K, steps=5)["confusion_table"]


@query()
def k4_crowd_layer_hidden(spark, sf_dir):
    """The same over a class model with a hidden layer."""
    return learn.crowd_layer(_observed(spark, sf_dir), _features(spark, sf_dir), K, "geo-reg-f", 0.001, steps=3, hidden=8)["confusion_table"]


@query()
def k5_low_rank_expertise(spark, sf_dir):
    return learn.low_rank_expertise(_observed(spark, sf_dir), _features(spark, sf_dir), K, steps=5)["annotator_vectors"]


@query()
def k6_mixed_pairs(spark, sf_dir):
    pairs = _observed(spark, sf_dir).join(_features(spark, sf_dir), "item_id").select("item_id", "annotator_id", A.as_doubles(F.col("x")).alias("x"), A.one_hot(F.col("annotator_id"), 20).alias("a"), A.one_hot(F.col("label"), K).alias("y"))
    return learn.mixed_pairs(pairs, 5)


@query()
def k8_batch_inference(spark, sf_dir):
    def model(part):
        import numpy as np

        x = np.stack(part["x"].to_numpy()).astype(float)
        return {"norm": np.sqrt((x * x).sum(1)).tolist()}

    return learn.batch_inference(_features(spark, sf_dir), model, {"norm": "double"})


@query()
def k9_text_features(spark, sf_dir):
    return learn.text_features(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), "text"))


@query("SELECT doc_id, source AS split FROM documents WHERE source IN ('src0', 'src1')")
def a1_a9_saved_splits(spark, sf_dir):
    import uuid

    path = f"{shared_dir(spark)}/dataset-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("split"))
    store.save_dataset(docs, path, {"source": "documents"})
    return spark.read.parquet(f"{path}/data").filter("split IN ('src0', 'src1')").select("doc_id", "split")


@query(with_views("x8") + " SELECT item_id, y FROM x8")
def a5_a7_materialised(spark, sf_dir):
    import uuid

    root = f"{shared_dir(spark)}/cache-{uuid.uuid4().hex}"
    first = store.materialise(view(spark, sf_dir, "x8"), {"source": sf_dir, "view": "x8", "verbose": True}, root)
    return store.materialise(first.limit(0), {"source": sf_dir, "view": "x8", "verbose": False}, root)


@query()
def a6_source_signature(spark, sf_dir):
    return store.source_signature(spark, f"{sf_dir}/documents.parquet")


@query()
def a4_attached_paths(spark, sf_dir):
    """Each page with the part of the table it is in, found by base name."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("_metadata.file_path", r"([^/]+)$", 1).alias("file"))
    files = spark.read.format("binaryFile").load(f"{sf_dir}/pages.parquet").select("path")
    return store.attach_paths(pages, files)


