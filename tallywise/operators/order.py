"""Global order without one task: ranks and running sums over rows that are dealt by range.

The rows are sorted by range partition and written.  The sizes and sums of the parts are few rows; their running totals are the
offsets that ranks and sums inside the parts lack.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallywise.sources.staging import staged
from tallywise.tables import small


def positions(rows: DataFrame, order: list[str], by: list[str] | None = None, sums: dict[str, str] | None = None, parts: int | None = None) -> DataFrame:
    """``rows`` with ``pos``, their rank from 0 in ascending ``order`` (nulls first) within the group ``by``, and ``n``, the group's size.

    ``sums`` adds under each name the sum of a column up to and with the row.  Rows that are equal in group and order take any
    order among themselves; give a unique last column where so many are equal that one part would hold them all.  The names
    ``pos``, ``n``, ``__at``, ``__part`` and ``__from`` must be free.
    """
    by, sums = by or [], sums or {}
    keys = [F.col(c) for c in [*by, *order]]
    dealt = rows.repartitionByRange(parts, *keys) if parts else rows.repartitionByRange(*keys)
    put = staged(dealt.sortWithinPartitions(*keys).withColumn("__at", F.monotonically_increasing_id()).withColumn("__part", F.shiftright("__at", 33)))
    # as many rows as parts and groups together, since the parts are ranges
    cells = put.groupBy(*by, "__part").agg(F.min("__at").alias("__from"), F.count(F.lit(1)).alias("__n"), *[F.sum(c).alias(f"__s_{k}") for k, c in sums.items()])
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    before = group.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.select(
        *[F.col(c).alias(f"__g_{c}") for c in by],
        F.col("__part").alias("__p"),
        (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__from")).alias("__shift"),
        F.sum("__n").over(group).alias("n"),
        *[F.coalesce(F.sum(f"__s_{k}").over(before), F.lit(0)).alias(f"__b_{k}") for k in sums],
    )
    side = small(staged(offsets))
    same = F.col("__part") == F.col("__p")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"__g_{c}"))
    inside = Window.partitionBy(*by, "__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)
    summed = put.withColumns({k: F.coalesce(F.sum(c).over(inside), F.lit(0)) for k, c in sums.items()}) if sums else put
    out = summed.join(side, same)
    return out.select(*rows.columns, (F.col("__at") + F.col("__shift")).alias("pos"), "n", *[(F.col(k) + F.col(f"__b_{k}")).alias(k) for k in sums])
