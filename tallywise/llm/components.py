"""Connected components of a link table by alternating large and small stars.

Every step is a grouped minimum and a join, so no component is ever gathered in one task; where a node has so
many neighbours that their join would be a large part of the work, these few nodes are broadcast.  The
links after each step are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywise.sources.staging import release, staged


#: A node with no more neighbours than this is joined like any other.
HEAVY = 20_000


def _told(rows: DataFrame, least: DataFrame, heavy: int | None) -> DataFrame:
    """``rows`` (u, v) with the minimum m of u, from ``least`` (u, m, n); nodes with more than ``heavy`` rows, if given, are broadcast."""
    if heavy is None:
        return rows.join(least.hint("merge"), "u")
    few = F.broadcast(least.filter(F.col("n") > heavy))
    return rows.join(few, "u").unionByName(rows.join(few.select("u"), "u", "left_anti").join(least.filter(F.col("n") <= heavy).hint("merge"), "u"))


def _large(links: DataFrame, heavy: int | None) -> DataFrame:
    """Points the larger neighbours of each node at the smallest of them and the node itself."""
    both = links.union(links.select("v", "u"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n"))
    return _told(both.filter("v > u"), least, heavy).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small(links: DataFrame, heavy: int | None) -> DataFrame:
    """Points each node and its smaller neighbours at the smallest of these."""
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    spread = _told(down, least, heavy)
    return spread.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", "m")).filter("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for each node of ``links`` (a, b); component is the smallest node that it reaches.

    Repeated links, links of a node with itself and the order of ends do not matter; no links give no rows.
    """
    now = staged(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    parts = max(1, int(links.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    mark = None
    while True:
        ends = now.select(F.explode(F.array("u", "v")).alias("x"), F.xxhash64("u", "v").cast("decimal(38,0)").alias("h"))
        row = ends.groupBy("x").agg(F.count(F.lit(1)).alias("n"), F.sum("h").alias("h")).agg(F.sum("n"), F.sum("h"), F.max("n")).first()
        if row[0] is None or row[:2] == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        mark = row[:2]
        # at most 8 a shuffle partition have more neighbours than this
        heavy = max(HEAVY, row[0] // (8 * parts))
        if row[0] // 2 <= heavy:
            # no node can have more neighbours than there are links
            before, now = now, staged(_small(_large(now, None), None))
            release(before)
            continue
        # the first step changes who has many smaller neighbours, so that is asked again for the second
        before, now = now, staged(_large(now, heavy if row[2] > heavy else None))
        release(before)
        most = now.groupBy("u").count().agg(F.max("count")).first()[0] or 0
        before, now = now, staged(_small(now, heavy if most > heavy else None))
        release(before)
