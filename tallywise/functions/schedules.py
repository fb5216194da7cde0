"""Values by cycle, as column expressions."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Named step schedules of the ratio of pairs to items.
PRESETS = {"ratio_1": (1.0, []), "ratio_2": (2.0, []), "ratio_2_1": (1.0, [(0, 4, 2.0)]), "ratio_1_2": (1.0, [(20, 24, 2.0)])}


def step_value(cycle: Column, default: float = 1.0, segments: list[tuple[int, int, float]] | None = None) -> Column:
    """The value of the first segment (start, end, value; both ends belong to it) that has the cycle, else ``default``."""
    return F.coalesce(*[F.when(cycle.between(a, b), F.lit(float(v))) for a, b, v in segments or []], F.lit(float(default)))


def cosine_value(cycle: Column, start: float, end: float, n_cycles: int, t_start: int = 0, t_0: int | None = None, t_mult: float = 1.0, gamma: float = 1.0, t_end: int | None = None) -> Column:
    """From ``start`` to ``end`` along a cosine, between ``t_start`` and ``t_end`` (the last cycle if not given).

    With ``t_0`` it restarts after periods of t_0, t_0 * t_mult, ... cycles, whatever ``t_end`` is; the amplitude of restart k is multiplied
    by gamma ** k.  A cycle outside the ``n_cycles`` is an error.
    """
    last = (n_cycles - 1) if t_end is None else t_end
    inside = F.when((cycle >= 0) & (cycle < n_cycles), cycle).otherwise(F.raise_error(F.lit(f"cycle outside 0 to {n_cycles - 1}")).cast("long"))
    t = F.greatest((inside if t_0 is not None else F.least(inside, F.lit(last))) - t_start, F.lit(0)).cast("double")
    if t_0 is None:
        k, p = F.lit(0.0), t / max(last - t_start, 1)
    elif t_mult == 1.0:
        k = F.floor(t / t_0)
        p = (t - k * t_0) / t_0
    else:
        k = F.floor(F.ln(1 + t / t_0 * (t_mult - 1)) / F.ln(F.lit(t_mult)) + 1e-12)
        p = (t - t_0 * (F.pow(F.lit(t_mult), k) - 1) / (t_mult - 1)) / (t_0 * F.pow(F.lit(t_mult), k))
    return end + (start - end) * F.pow(F.lit(gamma), k) * (1 + F.cos(pi * p)) / 2


def budget_plan(cycles: DataFrame, pairs_per_cycle: int, ratio: Column) -> DataFrame:
    """(cycle, ratio, n_pairs, n_items, total_pairs): items are ceil(pairs / ratio), the total runs over the cycles."""
    rows = cycles.withColumn("ratio", ratio).withColumn("n_pairs", F.lit(pairs_per_cycle).cast("long"))
    running = F.sum("n_pairs").over(Window.orderBy("cycle").rowsBetween(Window.unboundedPreceding, 0))
    return rows.select("cycle", "ratio", "n_pairs", F.ceil(F.col("n_pairs") / F.col("ratio")).alias("n_items"), running.alias("total_pairs"))
