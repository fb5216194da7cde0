from pyspark.sql import functions as F

from tallywise.operators import prep


def test_equal_draws_go_to_the_lowest_class(spark):
    rows = [(1, 1, c, v) for c, v in ((0, 0), (1, 1), (2, 1), (3, 1))] + [(1, 2, c, 1) for c in (3, 2, 1)]
    scores = spark.createDataFrame(rows, "item_id long, annotator_id long, class int, value int")
    for order in ("class", F.desc("class")):
        got = prep.argmax_label(scores.coalesce(1).sortWithinPartitions(order), drawn=F.lit(0.5)).orderBy("annotator_id").collect()
        assert [tuple(r) for r in got] == [(1, 1, 1), (1, 2, 1)]
