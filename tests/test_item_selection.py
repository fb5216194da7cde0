"""Which items are selected where leads are equal."""

from itertools import permutations

from tallywise.operators import select


def test_equal_leads_go_by_id_whatever_the_order_of_the_classes(spark):
    # the same distribution by other classes: sums of its entries differ in the last digits
    p = [[v / 7 for v in order] for order in permutations((0.1, 0.7, 1.3, 2.9))]
    posteriors = spark.createDataFrame(list(enumerate(p)) + [(99, [0.3, 0.3, 0.2, 0.2])], "item_id long, p array<double>")
    assert [r[0] for r in select.margin_items(posteriors, 20).collect()] == [99, *range(19)]
