"""Queries on run stores, grids and comparisons of studies."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallywise.functions import texts
from tallywise.plans import study
from tallywise.queries.labels import _r
from tallywise.queries.registry import query
from tallywise.sources import store
from tallywise.tables import table, view, with_views

_STORE = with_views("x4", "x5")


def _params(spark, sf_dir):
    """Parameters of the runs of view x5, long."""
    runs = view(spark, sf_dir, "x5").withColumn("run", F.struct(F.col("dataset").alias("name"), F.struct(F.col("seed")).alias("rng"), F.col("strategy")))
    flat = store.flat_params(runs, "run_id", "run")
    return flat.withColumn("key", F.when(F.col("key") == "strategy", "choice/strategy").otherwise(F.concat(F.lit("dataset/"), F.col("key"))))


_PARAMS = "pm AS (SELECT run_id, 'dataset/name' AS key, dataset AS value FROM x5 UNION ALL SELECT run_id, 'dataset/rng/seed', CAST(seed AS VARCHAR) FROM x5 UNION ALL SELECT run_id, 'choice/strategy', strategy FROM x5)"


def _metrics(spark, sf_dir):
    return view(spark, sf_dir, "x4").select("run_id", "step", F.lit("acc").alias("key"), "value")


@query("SELECT CAST(event_id AS VARCHAR) AS key, user_id, event_type FROM events")
def a3_json_records(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    objects = e.groupBy("user_id").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("event_id").cast("string"), F.struct("user_id", "event_type"))))).alias("doc"))
    return store.json_records(objects, "doc", "struct<user_id: bigint, event_type: string>")


def a8_content_hash(spark, sf_dir):
    return store.content_hash(view(spark, sf_dir, "x8"), "item_id", "y")


query()(a8_content_hash)


@query(_STORE + " SELECT run_id, step, 'acc' AS key, value FROM x4 WHERE step % 512 = 0")
def a10_logged_metrics(spark, sf_dir):
    return store.logged_metrics(_metrics(spark, sf_dir), 512)


@query(_STORE + f", {_PARAMS} SELECT run_id, start_time, string_agg(key || '=' || value, ',' ORDER BY key) AS params FROM x5 JOIN pm USING (run_id) WHERE status = 'FINISHED' GROUP BY 1, 2")
def a11_finished_runs(spark, sf_dir):
    runs = store.finished_runs(view(spark, sf_dir, "x5"), _params(spark, sf_dir))
    return runs.select("run_id", "start_time", F.array_join(F.transform(F.array_sort(F.map_entries("params")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("params"))


@query(_STORE + ' SELECT run_id, max(dataset) AS "param/dataset", CAST(max(seed) AS VARCHAR) AS "param/seed", arg_max(value, step) AS "metric/acc" FROM x4 GROUP BY 1')
def a12_runs_wide(spark, sf_dir):
    x = view(spark, sf_dir, "x4")
    p = store.flat_params(x.select("run_id", F.struct("dataset", "seed").alias("c")).distinct(), "run_id", "c")
    return store.runs_wide(p, _metrics(spark, sf_dir), ["dataset", "seed"], ["acc"])


@query(_STORE + " SELECT run_id, step, value FROM x4 WHERE dataset = 'F'")
def a13_metric_history(spark, sf_dir):
    return store.metric_history(_metrics(spark, sf_dir), view(spark, sf_dir, "x4").filter("dataset = 'F'"), "acc")


@query(_STORE + " SELECT run_id, status, dataset, seed, strategy FROM x5 WHERE status = 'FINISHED' AND seed IN (0, 2) AND contains(lower(strategy), 's') AND contains(lower(strategy), '1')")
def b13_run_filter(spark, sf_dir):
    return study.run_filter(view(spark, sf_dir, "x5"), "FINISHED", ["S", "1"], seed=[0, 2]).select("run_id", "status", "dataset", "seed", "strategy")


@query(_STORE + " SELECT run_id, coalesce(end_time, start_time) AS at FROM x5")
def b14_first_present(spark, sf_dir):
    return view(spark, sf_dir, "x5").select("run_id", F.coalesce("end_time", "start_time").alias("at"))


#: null, NaN, an integer, a large integer, and the value itself, by step.
_ODD = "CASE step WHEN 512 THEN NULL WHEN 768 THEN CAST(step AS DOUBLE) WHEN 1024 THEN CAST('NaN' AS DOUBLE) WHEN 1280 THEN CAST(1e20 AS DOUBLE) WHEN 1536 THEN CAST(0.25 AS DOUBLE) ELSE value END"


@query(_STORE + f", v AS (SELECT run_id, step, {_ODD} AS v FROM x4) SELECT run_id, step, CASE WHEN v IS NULL OR isnan(v) THEN '?' WHEN v = floor(v) THEN CAST(CAST(v AS DECIMAL(38, 0)) AS VARCHAR) ELSE printf('%.3g', v) END AS text FROM v")
def b15_format_number(spark, sf_dir):
    return view(spark, sf_dir, "x4").select("run_id", "step", texts.format_number(F.expr(_ODD)).alias("text"))


@query(_STORE + """, s AS (SELECT run_id, CASE WHEN seed = 4 THEN NULL ELSE dataset END AS classifier, strategy AS scorer, CASE seed % 3 WHEN 0 THEN 'greedy_sample' ELSE 'epsilon_greedy_sample' END AS assigner, CASE WHEN seed % 2 = 0 THEN '0.250' ELSE '0.5' END AS lo, CASE strategy WHEN 's0' THEN NULL WHEN 's1' THEN 'step' ELSE 'linear' END AS schedule FROM x5)
SELECT run_id, coalesce(classifier, 'unknown') || ' | ' || scorer || ' + ' || CASE WHEN assigner = 'greedy_sample' THEN assigner WHEN lo = '0.250' THEN 'epsilon_greedy_sample[eps=0.25]' ELSE 'epsilon_greedy_sample[' || coalesce(schedule, 'cosine') || ':0.25->0.5,T=10]' END AS strategy FROM s""")
def b16_strategy_label(spark, sf_dir):
    s = view(spark, sf_dir, "x5").select(
        "run_id",
        F.when(F.col("seed") != 4, F.col("dataset")).alias("classifier"),
        F.col("strategy").alias("scorer"),
        F.when(F.col("seed") % 3 == 0, "greedy_sample").otherwise("epsilon_greedy_sample").alias("assigner"),
        F.when(F.col("seed") % 2 == 0, "0.250").otherwise("0.5").alias("lo"),
        F.when(F.col("strategy") == "s1", "step").when(F.col("strategy") == "s2", "linear").alias("schedule"),
    )
    label = study.strategy_label(F.col("classifier"), F.col("scorer"), F.col("assigner"), F.lit("0.25"), F.col("lo"), F.lit("10"), F.col("schedule"))
    return s.select("run_id", label.alias("strategy"))


@query(_STORE + f", {_PARAMS} SELECT * FROM pm")
def b17_flat_params(spark, sf_dir):
    return _params(spark, sf_dir)


#: Events with their properties inside a nested text, the same in both engines.
_NESTED = """concat('{"a":{"b":[', user_id, ',', event_id, ',null],"t":"', event_type, '","n":null},"p":', props, '}')"""
_PLAIN = """SELECT event_id, 'a/t' AS key, event_type AS value FROM events UNION ALL SELECT event_id, 'a/n', 'null' FROM events UNION ALL SELECT event_id, 'p/k', json_extract_string(props, '$.k') FROM events"""


def _flat_events(spark, sf_dir, lists):
    return store.flat_json_params(table(spark, sf_dir, "events").select("event_id", F.expr(_NESTED).alias("j")), "event_id", "j", lists=lists)


@query(_PLAIN + " UNION ALL SELECT event_id, 'a/b', concat('[', user_id, ',', event_id, ',null]') FROM events")
def b17_flat_json_params(spark, sf_dir):
    return _flat_events(spark, sf_dir, "json")


@query(_PLAIN + " UNION ALL SELECT event_id, 'a/b/0', CAST(user_id AS VARCHAR) FROM events UNION ALL SELECT event_id, 'a/b/1', CAST(event_id AS VARCHAR) FROM events UNION ALL SELECT event_id, 'a/b/2', 'null' FROM events")
def b17_flat_json_params_by_index(spark, sf_dir):
    return _flat_events(spark, sf_dir, "indices")


@query("SELECT p_partkey, regexp_replace(p_name || '#' || p_brand, '[^A-Za-z0-9_./: -]', '_', 'g') AS key, coalesce(NULL, 'null') AS value FROM part")
def b18_sanitised(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", texts.sanitised_key(F.concat_ws("#", "p_name", "p_brand")).alias("key"), texts.stringified(F.lit(None).cast("string")).alias("value"))


@query(_STORE + " SELECT run_id, step, 'acc' AS key, value FROM x4 WHERE strategy <> 'N'")
def b19_finite_metrics(spark, sf_dir):
    broken = view(spark, sf_dir, "x4").select("run_id", "step", F.lit("acc").alias("key"), F.when(F.col("strategy") != "N", F.col("value")).when(F.col("seed") == 0, float("inf")).when(F.col("seed") == 1, None).otherwise(float("nan")).alias("value"))
    return store.finite_metrics(broken)


@query(_STORE + f", {_PARAMS} SELECT * FROM pm WHERE key LIKE 'choice/%'")
def b20_config_roots(spark, sf_dir):
    return store.config_roots(_params(spark, sf_dir), include=["training"])


@query(_STORE + " SELECT DISTINCT seed, CAST(seed AS VARCHAR) AS a, CASE WHEN seed = 0 THEN '0' ELSE seed || '.5' END AS b, 'x1.50' AS c FROM x5")
def b21_normalised_numbers(spark, sf_dir):
    s = view(spark, sf_dir, "x5").select("seed").distinct()
    return s.select("seed", texts.normalised_number(F.concat("seed", F.lit(".00"))).alias("a"), texts.normalised_number(F.when(F.col("seed") == 0, "-0").otherwise(F.concat("seed", F.lit("5e-1")))).alias("b"), texts.normalised_number(F.lit("x1.50")).alias("c"))


@query(_STORE + " SELECT DISTINCT strategy, false AS negated, 'scorer@' || strategy || '.name' AS lhs, strategy AS rhs, 'choice/scorer_' || strategy || '.name|scorer@' || strategy || '/name|scorer@' || strategy || '.name' AS keys FROM x5")
def b22_override_parts(spark, sf_dir):
    s = view(spark, sf_dir, "x5").select("strategy").distinct()
    p = texts.override_parts(F.concat(F.lit("scorer@"), "strategy", F.lit(".name="), "strategy"))
    return s.select("strategy", p.alias("p")).select("strategy", "p.negated", "p.lhs", "p.rhs", F.array_join("p.keys", "|").alias("keys"))


@query(_STORE + " SELECT DISTINCT strategy, strategy IN ('s0', 's1') AS logged FROM x5")
def b23_logged_overrides(spark, sf_dir):
    s = view(spark, sf_dir, "x5").select("strategy").distinct()
    return s.select("strategy", texts.is_logged(F.concat(F.lit("group@"), "strategy", F.lit(".rate")), ["s0", "s1"]).alias("logged"))


@query("SELECT p_partkey, coalesce(nullif(trim(regexp_replace(lower(trim(p_name || ' / ' || p_brand)), '[^a-z0-9]+', '_', 'g'), '_'), ''), 'value') AS slug FROM part")
def b24_slug(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", texts.slug(F.concat_ws(" / ", "p_name", "p_brand")).alias("slug"))


def _grid(spark, sf_dir):
    """Planned runs: datasets, strategies and seeds of view x5; one seed is only for one strategy."""
    x = view(spark, sf_dir, "x5")
    seeds = x.select(F.col("seed").cast("string").alias("label")).distinct().withColumn("overrides", F.array(F.concat(F.lit("dataset.rng.seed="), "label")))
    seeds = seeds.withColumn("when", F.when(F.col("label") == "4", F.create_map(F.lit("strategy"), F.array(F.lit("s0")))).otherwise(F.create_map().cast("map<string,array<string>>")))
    methods = x.select(F.col("strategy").alias("name")).distinct().select("name", F.array(F.concat(F.lit("strategy="), "name")).alias("overrides"), F.create_map(F.lit("method"), F.col("name")).alias("tags"), F.create_map().cast("map<string,array<string>>").alias("when"))
    axes = {"dataset": study.template_axis(x.select(F.col("dataset").alias("value")).distinct(), ["dataset.name={value}"]), "strategy": study.registry_axis(methods.select(F.col("name").alias("value")), methods), "seed": study.choice_axis(seeds)}
    return study.expand_grid(axes, [{"dataset": ["1-URGENT"], "strategy": ["s1", "s2"]}])


_GRID = """g AS (SELECT 'dataset-' || trim(regexp_replace(lower(dataset), '[^a-z0-9]+', '_', 'g'), '_') || '__strategy-' || strategy || '__seed-' || seed AS run_id, dataset, strategy, seed
 FROM (SELECT DISTINCT dataset FROM x5), (SELECT DISTINCT strategy FROM x5), (SELECT DISTINCT seed FROM x5)
 WHERE NOT (seed = 4 AND strategy <> 's0') AND NOT (dataset = '1-URGENT' AND strategy IN ('s1', 's2')))"""


@query(_STORE + f", {_GRID} SELECT run_id, 'dataset.name=' || dataset || '|strategy=' || strategy || '|dataset.rng.seed=' || seed AS overrides, strategy AS method FROM g")
def c1_c2_expanded_grid(spark, sf_dir):
    return _grid(spark, sf_dir).select("run_id", F.array_join("overrides", "|").alias("overrides"), F.col("tags")["method"].alias("method"))


#: Runs that failed without an end.
_BROKEN_OFF = "status = 'FAILED' AND end_time IS NULL"


def _late_params(spark, sf_dir):
    runs = view(spark, sf_dir, "x5").filter(_BROKEN_OFF)
    return _params(spark, sf_dir).join(runs.select("run_id"), "run_id", "left_semi")


_LATE = f"late AS (SELECT * FROM x5 WHERE {_BROKEN_OFF})"


@query(_STORE + f", {_GRID}, {_LATE} SELECT DISTINCT g.run_id AS row_id, late.run_id FROM g JOIN late ON late.dataset = g.dataset AND late.strategy = g.strategy AND late.seed = g.seed")
def c3_matched_runs(spark, sf_dir):
    return study.matched_rows(_grid(spark, sf_dir).select(F.col("run_id").alias("row_id"), "overrides"), _late_params(spark, sf_dir))


@query(_STORE + f", {_GRID}, {_LATE} SELECT g.run_id AS row_id FROM g WHERE NOT EXISTS (SELECT 1 FROM late WHERE late.dataset = g.dataset AND late.strategy = g.strategy AND late.seed = g.seed)")
def c4_missing_rows(spark, sf_dir):
    return study.missing_rows(_grid(spark, sf_dir).select(F.col("run_id").alias("row_id"), "overrides"), _late_params(spark, sf_dir)).select("row_id")


@query(_STORE + f", {_GRID}, {_LATE} SELECT '' AS common, g.run_id AS choice, 'dataset.name=' || dataset || '|strategy=' || strategy || '|dataset.rng.seed=' || seed AS overrides FROM g WHERE NOT EXISTS (SELECT 1 FROM late WHERE late.dataset = g.dataset AND late.strategy = g.strategy AND late.seed = g.seed)")
def a15_missing_grid(spark, sf_dir):
    missing = study.missing_rows(_grid(spark, sf_dir).select(F.col("run_id").alias("row_id"), "overrides"), _late_params(spark, sf_dir))
    doc = study.missing_grid(missing, ["dataset.name=1-URGENT"])
    return doc.select(F.array_join("common", "|").alias("common"), F.explode("choices").alias("choice", "overrides")).withColumn("overrides", F.array_join("overrides", "|"))


@query(_STORE + f", {_GRID} SELECT CAST(row_number() OVER (ORDER BY run_id) - 1 AS INT) AS row_idx, run_id FROM g")
def a14_manifest_rows(spark, sf_dir):
    return store.numbered_rows(_grid(spark, sf_dir).select("run_id")).select("row_idx", "run_id")


_AULC = """, l AS (SELECT *, lag(step) OVER w ps, lag(value) OVER w pv FROM x4 WINDOW w AS (PARTITION BY run_id ORDER BY step)),
au AS (SELECT run_id, dataset, seed, strategy, CASE WHEN max(step) = min(step) THEN arg_max(value, step) ELSE sum((value + pv) / 2 * (step - ps)) / (max(step) - min(step)) END AS aulc FROM l GROUP BY 1, 2, 3, 4)"""
_SE = "CASE WHEN count({0}) > 1 THEN round(stddev_samp({0}) / sqrt(count({0})), 6) END"


@query(_STORE + _AULC + " SELECT run_id, dataset, seed, strategy, round(aulc, 6) AS aulc FROM au")
def e2_normalised_aulc(spark, sf_dir):
    return _r(study.normalised_aulc(view(spark, sf_dir, "x4")), "aulc")


@query(_STORE + _AULC + f" SELECT dataset, strategy, round(avg(aulc), 6) AS mean, {_SE.format('aulc')} AS se, count(*) AS runs, count(DISTINCT seed) AS seeds FROM au GROUP BY 1, 2")
def d24_aulc_summary(spark, sf_dir):
    return _r(study.aulc_summary(study.normalised_aulc(view(spark, sf_dir, "x4"))), "mean", "se")


@query(_STORE + f" SELECT dataset, strategy, step, round(avg(value), 6) AS mean, {_SE.format('value')} AS se, count(*) AS n FROM x4 GROUP BY 1, 2, 3")
def d23_d25_curve_summary(spark, sf_dir):
    return _r(study.curve_summary(view(spark, sf_dir, "x4")), "mean", "se")


_DELTA = _AULC + ", dl AS (SELECT a.*, b.aulc AS base, a.aulc - b.aulc AS delta FROM au a JOIN au b ON b.strategy = 'A' AND a.strategy <> 'A' AND b.dataset = a.dataset AND b.seed = a.seed)"


@query(_STORE + _DELTA + " SELECT dataset, seed, strategy, round(base, 6) AS base, round(delta, 6) AS delta FROM dl")
def c12_paired_deltas(spark, sf_dir):
    return _r(study.paired_deltas(study.normalised_aulc(view(spark, sf_dir, "x4")), "A").select("dataset", "seed", "strategy", "base", "delta"), "base", "delta")


@query(_STORE + _DELTA + f" SELECT dataset, strategy, round(avg(delta), 6) AS mean_delta, {_SE.format('delta')} AS se_delta, count(*) AS pairs, count(DISTINCT seed) AS seeds, round(avg(base), 6) AS base_mean, {_SE.format('base')} AS base_se FROM dl GROUP BY 1, 2")
def d26_delta_summary(spark, sf_dir):
    return _r(study.delta_summary(study.paired_deltas(study.normalised_aulc(view(spark, sf_dir, "x4")), "A")), "mean_delta", "se_delta", "base_mean", "base_se")


_PAIRS = ", pr AS (SELECT a.strategy AS a, b.strategy AS b, a.value - b.value AS d FROM x4 a JOIN x4 b ON a.dataset = b.dataset AND a.seed = b.seed AND a.step = b.step AND a.strategy <> b.strategy)"


@query(_STORE + _PAIRS + " SELECT a, b, round(avg(CAST(d > 0 AS INT)), 6) AS win, round(avg(CAST(d = 0 AS INT)), 6) AS tie, round(avg(CAST(d < 0 AS INT)), 6) AS loss, round(avg(d), 6) AS mean_delta, round(median(d), 6) AS median_delta, count(*) AS n FROM pr GROUP BY 1, 2")
def c13_d27_win_rates(spark, sf_dir):
    return _r(study.win_rates(view(spark, sf_dir, "x4")), "win", "tie", "loss", "mean_delta", "median_delta")


@query(_STORE + _PAIRS + ' SELECT a AS strategy, round(avg(CASE WHEN b = \'A\' THEN CAST(d > 0 AS INT) END), 6) AS "A", round(avg(CASE WHEN b = \'N\' THEN CAST(d > 0 AS INT) END), 6) AS "N", round(avg(CASE WHEN b = \'R\' THEN CAST(d > 0 AS INT) END), 6) AS "R" FROM pr GROUP BY 1')
def d28_f10_win_matrix(spark, sf_dir):
    return _r(study.win_matrix(study.win_rates(view(spark, sf_dir, "x4")), ["A", "N", "R"]), "A", "N", "R")


@query(_STORE + _AULC + ", s AS (SELECT dataset, strategy, round(avg(aulc), 6) AS mean, row_number() OVER (PARTITION BY dataset ORDER BY avg(aulc) DESC, strategy) AS r FROM au GROUP BY 1, 2) SELECT dataset, strategy, mean, CAST(r AS INT) AS rank FROM s WHERE r = 2")
def e3_second_best(spark, sf_dir):
    s = study.aulc_summary(study.normalised_aulc(view(spark, sf_dir, "x4")))
    return _r(study.main_strategies(s, 2).select("dataset", "strategy", "mean", "rank"), "mean")


@query(_STORE + " SELECT run_id, dataset, strategy, seed FROM (SELECT *, row_number() OVER (PARTITION BY dataset, strategy, seed ORDER BY end_time DESC NULLS LAST, start_time DESC NULLS LAST, run_id DESC) r FROM x5) WHERE r = 1")
def e1_latest_runs(spark, sf_dir):
    return study.latest_runs(view(spark, sf_dir, "x5")).select("run_id", "dataset", "strategy", "seed")


@query(_STORE + " SELECT dataset, strategy, count(*) AS runs, count(DISTINCT seed) AS seeds, string_agg(DISTINCT CAST(seed AS VARCHAR), ',' ORDER BY CAST(seed AS VARCHAR)) AS seed_set, count(*) - count(DISTINCT seed) AS duplicates FROM x5 GROUP BY 1, 2 ORDER BY 1, 2")
def d21_f4_run_coverage(spark, sf_dir):
    return study.run_coverage(view(spark, sf_dir, "x5")).orderBy("dataset", "strategy")


@query(_STORE + " SELECT dataset, status, count(*) AS n FROM x5 GROUP BY 1, 2")
def d22_status_overview(spark, sf_dir):
    return view(spark, sf_dir, "x5").groupBy("dataset", "status").agg(F.count(F.lit(1)).alias("n"))


@query(_STORE + f", {_GRID}, o AS (SELECT dataset, count(*) n FROM x5 WHERE status = 'FINISHED' GROUP BY 1) SELECT g.dataset, count(*) AS expected, max(o.n) AS observed FROM g JOIN o ON o.dataset = g.dataset GROUP BY 1")
def d33_observed_against_expected(spark, sf_dir):
    planned = _grid(spark, sf_dir).select(F.col("axis_values")["dataset"].alias("dataset"))
    return study.observed_against_expected(planned, view(spark, sf_dir, "x5").filter("status = 'FINISHED'"), ["dataset"])


@query(_STORE + """ SELECT run_id, step, printf('%.2f%%', 100.0 * value) AS pct, printf('%.3f', value) AS decimal, replace(format('{:,}', CAST(round_even(value * step * 1000, 0) AS BIGINT)), ',', '_') AS whole,
 repeat('█', CAST(round_even(least(value, 1) * 14, 0) AS INT)) || repeat('░', 14 - CAST(round_even(least(value, 1) * 14, 0) AS INT)) AS bar FROM x4""")
def g20_percent_and_bar(spark, sf_dir):
    v = F.col("value")
    return view(spark, sf_dir, "x4").select("run_id", "step", texts.percent(v).alias("pct"), texts.format_decimal(v).alias("decimal"), texts.format_integer(v * F.col("step") * 1000).alias("whole"), texts.bar(v).alias("bar"))


@query(_STORE + """, s AS (SELECT dataset, seed, list(run_id ORDER BY run_id) AS ids FROM x5 GROUP BY 1, 2)
SELECT dataset, seed, array_to_string(ids[1:12], ', ') || CASE WHEN len(ids) > 12 THEN ', … (+' || (len(ids) - 12) || ' more)' ELSE '' END AS runs FROM s""")
def g20_abbreviated_lists(spark, sf_dir):
    ids = view(spark, sf_dir, "x5").groupBy("dataset", "seed").agg(F.sort_array(F.collect_list("run_id")).alias("ids"))
    return ids.select("dataset", "seed", texts.listed(F.col("ids")).alias("runs"))
