"""Studies: grids of planned runs, which of them are missing, and how strategies compare over finished ones."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywise.functions.texts import close, format_number, is_logged, normalised_number, override_parts, slug
from tallywise.operators.order import positions

_STRINGS, _MAP, _WHEN = "array<string>", "map<string,string>", "map<string,array<string>>"


def _option(df: DataFrame, label: Column, overrides: Column, tags: Column | None = None, when: Column | None = None) -> DataFrame:
    return df.select(
        label.cast("string").alias("label"),
        overrides.cast(_STRINGS).alias("overrides"),
        (tags if tags is not None else F.create_map()).cast(_MAP).alias("tags"),
        (when if when is not None else F.create_map()).cast(_WHEN).alias("when"),
    )


def template_axis(values: DataFrame, templates: list[str]) -> DataFrame:
    """An option for each ``value``, with ``{value}`` filled into every template."""
    filled = F.transform(F.array(*[F.lit(t) for t in templates]), lambda t: F.replace(t, F.lit("{value}"), F.col("value").cast("string")))
    return _option(values, F.col("value"), filled)


def choice_axis(choices: DataFrame) -> DataFrame:
    """An option for each row of (label, overrides[, tags, when])."""
    has = set(choices.columns)
    return _option(choices, F.col("label"), F.col("overrides"), F.col("tags") if "tags" in has else None, F.col("when") if "when" in has else None)


def registry_axis(names: DataFrame, methods: DataFrame) -> DataFrame:
    """An option for each ``value`` that the table ``methods`` (name, overrides, tags, when) knows."""
    joined = names.join(methods, names["value"] == methods["name"])
    return _option(joined, F.col("name"), F.col("overrides"), F.col("tags"), F.col("when"))


def _holds(condition: Column, values: Column) -> Column:
    return F.forall(F.map_entries(condition), lambda e: F.coalesce(F.array_contains(e["value"], values[e["key"]]), F.lit(False)))


def expand_grid(axes: dict[str, DataFrame], exclude: list[dict[str, list[str]]] | None = None) -> DataFrame:
    """(run_id, axis_values, tags, overrides) of every combination that no ``when`` and no exclusion forbids.

    The product is the result wanted here; it is as large as the study, not as its data.
    """
    rows = None
    for name, axis in axes.items():
        part = axis.select(F.create_map(F.lit(name), "label").alias("v"), F.col("overrides").alias("o"), F.col("tags").alias("t"), F.array("when").alias("w"), F.concat(F.lit(f"{slug_text(name)}-"), slug(F.col("label"))).alias("i"))
        if rows is None:
            rows = part
        else:
            left = rows.select(*[F.col(c).alias(f"l_{c}") for c in "votwi"])
            rows = left.crossJoin(part).select(F.map_concat("l_v", "v").alias("v"), F.concat("l_o", "o").alias("o"), F.map_concat("l_t", "t").alias("t"), F.concat("l_w", "w").alias("w"), F.concat_ws("__", "l_i", "i").alias("i"))
    fits = F.forall("w", lambda w: _holds(w, F.col("v")))
    for condition in exclude or []:
        literal = F.create_map(*[x for k, v in condition.items() for x in (F.lit(k), F.array(*[F.lit(a) for a in v]))])
        fits = fits & ~_holds(literal, F.col("v"))
    return rows.filter(fits).select(F.col("i").alias("run_id"), F.col("v").alias("axis_values"), F.col("t").alias("tags"), F.col("o").alias("overrides"))


def slug_text(name: str) -> str:
    return "".join(c if c.isalnum() else "_" for c in name.lower()).strip("_") or "value"


def matched_rows(expected: DataFrame, params: DataFrame, roots: list[str] | None = None) -> DataFrame:
    """(row_id, run_id): runs that meet all predicates of an expected row (row_id, overrides).

    ``lhs=rhs`` asks for one of its keys with that value (as numbers where both are), ``~lhs`` for a run without any of its
    keys.  A division: the predicates of a row that a run meets are counted, over equi joins, and runs that have a forbidden
    key are taken off; only rows that ask for no value at all are paired with every run, which is their result.
    Overrides whose root is not in ``roots`` are no predicates.
    """
    p = expected.select("row_id", F.posexplode("overrides").alias("i", "o")).select("row_id", "i", override_parts(F.col("o")).alias("p")).select("row_id", "i", "p.*")
    if roots is not None:
        p = p.filter(is_logged(F.col("lhs"), roots))
    need = p.groupBy("row_id").agg(F.count_if(~F.col("negated")).alias("need"))
    known = params.select("run_id", "key", normalised_number(F.col("value")).alias("value"))
    keys = p.select("row_id", "i", "negated", normalised_number(F.col("rhs")).alias("rhs"), F.explode("keys").alias("key")).hint("merge")
    met = keys.filter("NOT negated").join(known, (keys["key"] == known["key"]) & (keys["rhs"] == known["value"])).select("row_id", "i", "run_id").distinct()
    broken = keys.filter("negated").join(known, "key").select("row_id", "run_id").distinct()
    count = met.groupBy("row_id", "run_id").agg(F.count(F.lit(1)).alias("met"))
    found = count.join(need.filter("need > 0").hint("merge"), "row_id").filter("met = need").select("row_id", "run_id")
    # rows that only forbid keys are met by every run that has none of these
    open_ = need.filter("need = 0").select("row_id")
    if not open_.isEmpty():
        found = found.unionByName(open_.crossJoin(params.select("run_id").distinct()))
    return found.join(broken.hint("merge"), ["row_id", "run_id"], "left_anti")


def missing_rows(expected: DataFrame, params: DataFrame, roots: list[str] | None = None) -> DataFrame:
    """Expected rows without a matching run; rows without predicates are missing."""
    return expected.join(matched_rows(expected, params, roots).select("row_id").distinct(), "row_id", "left_anti")


def missing_grid(missing: DataFrame, common: list[str]) -> DataFrame:
    """(common, choices): a grid document of the missing rows; the common overrides are cut off if every row begins with them."""
    n = len(common)
    lead = F.array(*[F.lit(c) for c in common]).cast(_STRINGS)
    every = missing.agg(F.coalesce(F.every(F.slice("overrides", 1, n) == lead), F.lit(False)).alias("all"))
    rows = missing.crossJoin(F.broadcast(every)).select("row_id", "all", F.when(F.col("all"), F.slice(F.col("overrides"), n + 1, F.greatest(F.size("overrides") - n, F.lit(0)))).otherwise(F.col("overrides")).alias("overrides"))
    return rows.agg(F.when(F.first("all"), lead).otherwise(F.array().cast(_STRINGS)).alias("common"), F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("row_id").cast("string"), "overrides")))).alias("choices"))


def run_filter(runs: DataFrame, status: str | None = None, tokens: list[str] | None = None, **columns: list) -> DataFrame:
    """Runs of a status whose columns are in the lists, and whose strategy contains every token; unknown columns are an error."""
    for c in columns:
        if c not in runs.columns:
            raise ValueError(f"no column {c}")
    if status is not None:
        runs = runs.filter(F.col("status") == status)
    for c, allowed in columns.items():
        runs = runs.filter(F.col(c).isin(allowed))
    return reduce(lambda r, t: r.filter(F.lower("strategy").contains(t.lower())), tokens or [], runs)


def latest_runs(runs: DataFrame, keys: tuple[str, ...] = ("dataset", "strategy", "seed")) -> DataFrame:
    """The last run of each cell, by end, start and id; a run without an end is older than any with one."""
    w = Window.partitionBy(*keys).orderBy(F.col("end_time").desc_nulls_last(), F.col("start_time").desc_nulls_last(), F.col("run_id").desc())
    return runs.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def run_coverage(runs: DataFrame) -> DataFrame:
    """(dataset, strategy, runs, seeds, seed_set, duplicates)."""
    return runs.groupBy("dataset", "strategy").agg(
        F.count(F.lit(1)).alias("runs"),
        F.countDistinct("seed").alias("seeds"),
        F.array_join(F.sort_array(F.collect_set("seed")), ",").alias("seed_set"),
        (F.count(F.lit(1)) - F.countDistinct("seed")).alias("duplicates"),
    )


def standard_error(column: str) -> Column:
    """Sample deviation over the square root of the count; null for fewer than two."""
    return F.when(F.count(column) > 1, F.stddev_samp(column) / F.sqrt(F.count(column)))


def normalised_aulc(history: DataFrame, keys: tuple[str, ...] = ("run_id", "dataset", "seed", "strategy")) -> DataFrame:
    """Area under each run's curve by the trapezoid rule, over the span of its steps.

    One point gives its value, a span of zero the last value.
    """
    w = Window.partitionBy(*keys).orderBy("step")
    rows = history.withColumn("ps", F.lag("step").over(w)).withColumn("pv", F.lag("value").over(w))
    span = F.max("step") - F.min("step")
    area = F.sum((F.col("value") + F.col("pv")) / 2 * (F.col("step") - F.col("ps")))
    return rows.groupBy(*keys).agg(F.when((F.count(F.lit(1)) == 1) | (span == 0), F.max_by("value", "step")).otherwise(area / span).alias("aulc"))


def aulc_summary(aulc: DataFrame) -> DataFrame:
    """(dataset, strategy, mean, se, runs, seeds)."""
    return aulc.groupBy("dataset", "strategy").agg(F.avg("aulc").alias("mean"), standard_error("aulc").alias("se"), F.count(F.lit(1)).alias("runs"), F.countDistinct("seed").alias("seeds"))


def curve_summary(history: DataFrame) -> DataFrame:
    return history.groupBy("dataset", "strategy", "step").agg(F.avg("value").alias("mean"), standard_error("value").alias("se"), F.count(F.lit(1)).alias("n"))


def paired_deltas(aulc: DataFrame, baseline: str) -> DataFrame:
    """Each strategy's area less the baseline's of the same dataset and seed; a baseline that has two is an error."""
    base = aulc.filter(F.col("strategy") == baseline).groupBy("dataset", "seed").agg(F.when(F.count(F.lit(1)) == 1, F.first("aulc")).otherwise(F.raise_error(F.lit("more than one baseline run")).cast("double")).alias("base"))
    return aulc.filter(F.col("strategy") != baseline).join(base, ["dataset", "seed"]).withColumn("delta", F.col("aulc") - F.col("base")).filter("delta IS NOT NULL")


def delta_summary(deltas: DataFrame) -> DataFrame:
    return deltas.groupBy("dataset", "strategy").agg(
        F.avg("delta").alias("mean_delta"), standard_error("delta").alias("se_delta"), F.count(F.lit(1)).alias("pairs"), F.countDistinct("seed").alias("seeds"), F.avg("base").alias("base_mean"), standard_error("base").alias("base_se")
    )


def win_rates(history: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """(a, b, win, tie, loss, mean_delta, median_delta, n) of ordered pairs of strategies at equal dataset, seed and step."""
    cells = history.groupBy("dataset", "seed", "step", "strategy").agg(F.avg("value").alias("value"))
    b = cells.select("dataset", "seed", "step", F.col("strategy").alias("b"), F.col("value").alias("vb"))
    pairs = cells.withColumnRenamed("strategy", "a").join(b, ["dataset", "seed", "step"]).filter("a <> b").withColumn("d", F.col("value") - F.col("vb"))
    # the middle one or two of each pair of strategies by rank, since a median as an aggregate holds all its values
    placed = positions(pairs.select("a", "b", "d", "dataset", "seed", "step"), ["d", "dataset", "seed", "step"], ["a", "b"])
    middle = (F.col("pos") == F.expr("(n - 1) div 2")) | (F.col("pos") == F.expr("n div 2"))
    return placed.groupBy("a", "b").agg(
        F.avg((F.col("d") > tolerance).cast("double")).alias("win"),
        F.avg((F.abs("d") <= tolerance).cast("double")).alias("tie"),
        F.avg((F.col("d") < -tolerance).cast("double")).alias("loss"),
        F.avg("d").alias("mean_delta"),
        F.avg(F.when(middle, F.col("d"))).alias("median_delta"),
        F.count(F.lit(1)).alias("n"),
    )


def win_matrix(rates: DataFrame, strategies: list[str]) -> DataFrame:
    """A row per strategy, a column per strategy that it is held against."""
    return rates.withColumnRenamed("a", "strategy").groupBy("strategy").pivot("b", strategies).agg(F.first("win"))


def main_strategies(summary: DataFrame, nth: Column | int = 1, order: Column | str = "strategy") -> DataFrame:
    """The nth best strategy of each dataset by mean area, ties by ``order``; none where there are fewer."""
    w = Window.partitionBy("dataset").orderBy(F.col("mean").desc(), order)
    return summary.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") == nth)


def observed_against_expected(expected: DataFrame, observed: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of planned rows and of runs, side by side."""
    e, o = (t.groupBy(*keys).agg(F.count(F.lit(1)).alias(n)) for t, n in ((expected, "expected"), (observed, "observed")))
    return e.join(o, keys, "full").select(*keys, F.coalesce("expected", F.lit(0)).alias("expected"), F.coalesce("observed", F.lit(0)).alias("observed"))


def assigner_variant(assigner: Column, epsilon_max: Column, epsilon_min: Column, period: Column, schedule: Column) -> Column:
    """The assigner; ``epsilon_greedy_sample`` with its schedule spelled out, so that settings stay apart."""
    low, high = epsilon_min.try_cast("double"), epsilon_max.try_cast("double")
    moving = F.concat(F.coalesce(schedule, F.lit("cosine")), F.lit(":"), format_number(epsilon_max), F.lit("->"), format_number(epsilon_min), F.lit(",T="), format_number(period))
    inside = F.when(F.coalesce(close(high, low), F.lit(False)), F.concat(F.lit("eps="), format_number(low))).otherwise(moving)
    spelled = F.concat(F.lit("epsilon_greedy_sample["), inside, F.lit("]"))
    return F.when(assigner == "epsilon_greedy_sample", spelled).otherwise(F.coalesce(assigner, F.lit("unknown")))


def strategy_label(classifier: Column, scorer: Column, assigner: Column, epsilon_max: Column, epsilon_min: Column, period: Column, schedule: Column) -> Column:
    """``classifier | scorer + assigner``; what a run didn't log is ``unknown``."""
    known = lambda c: F.coalesce(c.cast("string"), F.lit("unknown"))
    return F.concat(known(classifier), F.lit(" | "), known(scorer), F.lit(" + "), assigner_variant(assigner, epsilon_max, epsilon_min, period, schedule))
