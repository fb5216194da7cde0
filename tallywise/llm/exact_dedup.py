"""Exact deduplication with a heavy-hitter split, in DataFrame functions only.

A Misra-Gries summary (``freqItems``) names every digest that may fill more than ``support`` of
the rows.  Their true counts and winners are then computed exactly; at most ``1 / support`` of
them exist, so they are broadcast and their rows are settled where they are read.  Only the
rows of the other digests are shuffled: winners and counts come from an aggregation that
combines before it shuffles, and go back to the rows by a join.

Null text counts as empty; texts are equal when identical after lower-casing A-Z only.  Of equal
texts the row with the largest doc_id stays (a null doc_id is the smallest); of rows that repeat
that doc_id too, one stays.  Empty tables give empty results.  Other columns are not touched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywise.llm.common import spare_name, split_join
from tallywise.sources.staging import staged


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Share of the rows from which a digest counts as heavy; its inverse bounds the broadcast winners.
SUPPORT = 0.001


def text_digest(text) -> F.Column:
    """SHA-256 in hex of the text with A-Z lower-cased, null as empty."""
    return F.sha2(F.encode(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), "UTF-8"), 256)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = staged(docs.select(F.col(id_col).alias("doc_id"), text_digest(F.col(text_col)).alias("text_sha256")).withColumn("row", F.monotonically_increasing_id()))
    frequent = rows.freqItems(["text_sha256"], support).select(F.explode("text_sha256_freqItems").alias("text_sha256"))
    total = rows.count()
    winners = staged(
        rows.join(F.broadcast(frequent), "text_sha256", "left_semi")
        .groupBy("text_sha256")
        .agg(F.max(F.struct("doc_id", "row")).alias("best"), F.count(F.lit(1)).alias("group_size"))
        .filter(F.col("group_size") >= total * support)
    )
    heavy = rows.join(F.broadcast(winners), "text_sha256")
    rest = rows.join(F.broadcast(winners.select("text_sha256")), "text_sha256", "left_anti")
    others = staged(rest.groupBy("text_sha256").agg(F.max(F.struct("doc_id", "row")).alias("best"), F.count(F.lit(1)).alias("group_size")))
    light = split_join(rest, others, ["text_sha256"], "group_size", total)
    return heavy.unionByName(light).select("doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"), "text_sha256")


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """``docs`` without the rows whose text another row with a larger id also has; of rows that repeat id and text one stays."""
    digest = spare_name(docs, "text_sha256")
    groups = staged(exact_groups(docs, id_col, text_col, support).filter("doc_id <=> keep_id").select("doc_id", "kept", F.col("text_sha256").alias(digest)))
    kept = groups.filter("kept").hint("merge")
    marked = docs.withColumn(digest, text_digest(F.col(text_col)))
    out = marked.join(kept, marked[id_col].eqNullSafe(kept["doc_id"]) & (marked[digest] == kept[digest]), "left_semi")
    if not groups.filter("NOT kept").isEmpty():
        out = out.dropDuplicates([id_col, digest])
    return out.drop(digest)


ORACLE = """
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY doc_id DESC NULLS LAST) AS keep_id,
       CAST(count(*) OVER (PARTITION BY text_sha256) AS BIGINT) AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       text_sha256
FROM (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
      FROM documents) t
"""
