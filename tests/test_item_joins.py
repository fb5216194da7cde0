"""Joins by item, whatever the size of the tables."""

from tallywise.operators import aggregate
from tallywise.sources.staging import staged


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_posteriors_are_not_broadcast(spark):
    labels = staged(spark.createDataFrame([(i, a, (i + a) % 2) for i in range(20) for a in range(3)], "item_id long, annotator_id long, label int"))
    post = staged(aggregate.dense(aggregate.soft_votes(labels), 2))
    assert "SortMergeJoin [item_id" in plan(aggregate.confusions(labels, post, 2))
    assert "SortMergeJoin [item_id" in plan(aggregate.dense(post, 2))
