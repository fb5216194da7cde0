"""A labelling round, and rounds in a row: plan, availability, items, scores, assignment, acquisition, consensus, measures."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywise.operators import metrics, prep
from tallywise.operators.assign import assign
from tallywise.operators.dawid_skene import dawid_skene
from tallywise.sources.staging import release, staged
from tallywise.tables import uniform

#: (candidates, acquired, round state) -> utilities
Scorer = Callable[[DataFrame, DataFrame, dict], DataFrame]


def acquire(acquired: DataFrame, pool: DataFrame, chosen: DataFrame) -> DataFrame:
    """``acquired`` with the pool's labels of the chosen pairs; pairs that it has already are not added again."""
    new = pool.join(chosen.select("item_id", "annotator_id"), ["item_id", "annotator_id"], "left_semi")
    return acquired.unionByName(prep.available_pairs(new, acquired).select(*acquired.columns))


def random_scores(candidates: DataFrame, acquired: DataFrame, state: dict) -> DataFrame:
    return candidates.withColumn("u", uniform(state["seed"], F.lit(state["cycle"]), "item_id", "annotator_id"))


def performance_scores(candidates: DataFrame, acquired: DataFrame, state: dict) -> DataFrame:
    """P(correct) under the consensus so far; random before there is one."""
    if state["posteriors"] is None:
        return random_scores(candidates, acquired, state)
    right = state["confusions"].filter("truth = label").select("annotator_id", F.col("truth").alias("class"), F.col("p").alias("c"))
    p = candidates.join(state["posteriors"], "item_id", "left").join(right, ["annotator_id", "class"], "left")
    return p.groupBy("item_id", "annotator_id").agg(F.coalesce(F.sum(F.col("p") * F.col("c")), F.lit(0.5)).alias("u"))


def _finished(spark: SparkSession, path: str) -> bool:
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done)


def labelling_rounds(pool: DataFrame, items: DataFrame, n_classes: int, cycles: int, pairs_per_cycle: int, ratio: float | Callable[[int], float] = 1.0, scorer: Scorer = performance_scores, assigner: dict | None = None, em_steps: int = 2, seed: int = 0, capacity: int | None = None, root: str | None = None) -> DataFrame:
    """One row of measures per cycle, with the planned and the realised number of pairs.

    ``ratio`` of pairs to items may go by cycle.  ``capacity`` bounds the labels of an annotator over all rounds.  The state
    between cycles is the table of acquired labels.  With ``root`` each cycle writes it below that folder and then its measures, whose
    completion is the mark that the cycle is over; a run that finds finished cycles there goes on after them.
    """
    spark = pool.sparkSession
    annotators = staged(pool.select("annotator_id").distinct())
    acquired = staged(pool.limit(0))
    state: dict = {"seed": seed, "posteriors": None, "confusions": None}
    out: list[DataFrame] = []
    while root is not None and len(out) < cycles and _finished(spark, f"{root}/measures/{len(out)}"):
        acquired = spark.read.schema(pool.schema).parquet(f"{root}/acquired/{len(out)}")
        out.append(spark.read.parquet(f"{root}/measures/{len(out)}"))
    if out:
        post, state["confusions"], _, _ = dawid_skene(acquired, n_classes, max_iter=em_steps, items=items)
        state["posteriors"] = staged(post)
    planned = len(out) * pairs_per_cycle
    for cycle in range(len(out), cycles):
        state["cycle"], planned = cycle, planned + pairs_per_cycle
        per_item = ratio(cycle) if callable(ratio) else ratio
        caps = None if capacity is None else prep.remaining_counts(pool, acquired, capacity).select("annotator_id", F.col("remaining").alias("cap"))
        open_ = prep.available_pairs(pool, acquired)
        candidates = prep.candidate_items(open_, acquired)
        chosen = prep.subsample(candidates, -int(-pairs_per_cycle // per_item), drawn=uniform(seed, F.lit("items"), F.lit(cycle), "item_id"))
        utilities = staged(scorer(prep.candidate_pairs(chosen, open_), acquired, state))
        picked = assign(utilities, pairs_per_cycle, cycle=cycle, seed=seed, caps=caps, **(assigner or {"selection": "greedy", "coverage": "hard"}))
        now = staged(acquire(acquired, pool, picked))
        if root is not None:
            now.write.mode("overwrite").parquet(f"{root}/acquired/{cycle}")
        post, conf, _, _ = dawid_skene(now, n_classes, max_iter=em_steps, items=items)
        state["posteriors"], state["confusions"] = staged(post), conf
        dense = state["posteriors"].groupBy("item_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("class", "p"))), lambda e: e["p"]).alias("p"))
        row = metrics.round_metrics(now, items, annotators, acquired if cycle else None, dense, items, n_classes)
        row = row.withColumn("cycle", F.lit(cycle)).withColumn("planned_pairs", F.lit(planned))
        if root is None:
            out.append(staged(row))
        else:
            row.write.mode("overwrite").parquet(f"{root}/measures/{cycle}")
            out.append(spark.read.parquet(f"{root}/measures/{cycle}"))
        release(utilities)
        acquired = now
    return reduce(DataFrame.unionByName, out)
