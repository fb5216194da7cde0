"""Table contracts, input views over the star-schema tables, and the random numbers that operators draw.

Long tables everywhere: ``items(item_id, y)``, ``annotations(item_id, annotator_id, label)`` with a missing label as an absent
row, ``posteriors(item_id, class, p)``, ``confusions(annotator_id, truth, label, p)``, ``utilities(item_id, annotator_id, u)``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Views over the test tables, valid in Spark and in DuckDB; table names stand in braces.
VIEWS = {
    # a wide pool: 3 labels without signal
    "x1": """SELECT item_id, annotator_id, label FROM (
  SELECT l_partkey item_id, l_suppkey annotator_id,
         CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS label,
         row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_orderkey, l_linenumber, l_shipdate, l_extendedprice, l_returnflag) rn
  FROM {lineitem}) t WHERE rn = 1""",
    # 20 graded annotators on 4 classes, acquired over 30 cycles
    "x2": """WITH x AS (SELECT vec_id item_id, a annotator_id, label % 4 y, vec_id*20 + a AS k FROM {embeddings}, range(20) r(a)),
 q AS (SELECT *, ((k+1000000)*7919+13)%1000003 q1, ((k+2000000)*7919+13)%1000003 q2, ((k+3000000)*7919+13)%1000003 q3 FROM x),
 p AS (SELECT *, (q1*q1 + k*31)%1000003 p1, (q2*q2 + k*37)%1000003 p2, (q3*q3 + k*41)%1000003 p3 FROM q),
 h AS (SELECT *, (p1*p1 + 7*q1 + 11)%1000003 h1, (p2*p2 + 7*q2 + 11)%1000003 h2, (p3*p3 + 7*q3 + 11)%1000003 h3 FROM p)
SELECT item_id, annotator_id,
  CAST(CASE WHEN h2 % 1000 < (CASE WHEN annotator_id<3 THEN 900 WHEN annotator_id<8 THEN 700 WHEN annotator_id<12 THEN 500 ELSE 250 END)
       THEN y ELSE (y + 1 + h3 % 3) % 4 END AS INT) label,
  CAST(h1 % 30 AS INT) cycle
FROM h WHERE h1 % 1000 < 220""",
    # metric history
    "x4": """SELECT concat(l_linestatus,'-',l_returnflag,'-',CAST(l_suppkey % 5 AS VARCHAR(9))) run_id, l_linestatus dataset,
       l_suppkey % 5 seed, l_returnflag strategy, l_linenumber*256 step, round(avg(l_discount*10 + l_tax),6) AS value
FROM {lineitem} GROUP BY l_linestatus, l_returnflag, l_suppkey % 5, l_linenumber""",
    # runs, some without an end
    "x5": """SELECT o_orderkey run_id, CASE o_orderstatus WHEN 'F' THEN 'FINISHED' WHEN 'O' THEN 'RUNNING' ELSE 'FAILED' END status,
  o_orderpriority dataset, o_custkey % 5 seed, concat('s', CAST(o_custkey % 3 AS VARCHAR(9))) strategy,
  o_orderdate start_time, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderdate END end_time
FROM {orders}""",
    # class probabilities of 4 classes
    "x6": """WITH x AS (SELECT vec_id item_id, label % 4 y, c class, vec_id*4 + c AS k FROM {embeddings}, range(4) r(c)),
 q AS (SELECT *, (k*7919+13)%1000003 q1, CASE WHEN class = y THEN 1 ELSE 0 END c_eq FROM x),
 w AS (SELECT *, 1 + ((q1*q1 + k*31)%1000003) % 100 + CASE WHEN c_eq=1 THEN 150 ELSE 0 END AS wt FROM q)
SELECT item_id, class, round(wt / CAST(sum(wt) OVER (PARTITION BY item_id) AS DOUBLE), 9) p FROM w""",
    # true classes
    "x8": "SELECT vec_id item_id, CAST(label % 4 AS INT) y FROM {embeddings}",
    # feature vectors
    "x8v": "SELECT vec_id item_id, CAST(label % 4 AS INT) y, embedding x FROM {embeddings}",
    # labelled documents
    "x7": "SELECT d.doc_id item_id, l.quality y, l.toxic, d.lang, d.source FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id",
}
#: Where DuckDB needs other words.
_DUCK: dict[str, str] = {}
#: JSON accessors differ, so this view has one text for each.
_EVENTS = """SELECT item_id, annotator_id, label FROM (
  SELECT CAST({k} AS BIGINT) item_id, user_id annotator_id,
    CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS label,
    row_number() OVER (PARTITION BY {k}, user_id ORDER BY ts DESC, event_id) rn
  FROM {{events}}) t WHERE rn = 1"""
VIEWS["x3"] = _EVENTS.format(k="get_json_object(props,'$.k')")
_DUCK["x3"] = _EVENTS.format(k="json_extract_string(props,'$.k')")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of VIEWS as a DataFrame."""
    text = VIEWS[name]
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in set(re.findall(r"\{(\w+)\}", text))})


def with_views(*names: str) -> str:
    """The same views as the head of a DuckDB query."""
    texts = [f"{n} AS ({re.sub(r'\{(\w+)\}', r'\1', _DUCK.get(n, VIEWS[n]))})" for n in names]
    return "WITH " + ",\n".join(texts)


def small(df: DataFrame, most: int = 500_000) -> DataFrame:
    """``df`` as the side of a join: broadcast if it has at most ``most`` rows, else sorted and merged."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df.hint("merge")


def uniform(seed: int | str, *keys: Column | str) -> Column:
    """A number strictly between 0 and 1 that depends on the seed and the keys alone, not on partitions."""
    return (F.pmod(F.xxhash64(F.lit(seed), *[F.col(k) if isinstance(k, str) else k for k in keys]), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def scramble(key: str, stream: int) -> str:
    """SQL of an integer in [0, 1000003) from one integer key, the same in every engine."""
    q = f"((({key}) + {stream} * 1000000) * 7919 + 13) % 1000003"
    p = f"(({q}) * ({q}) + ({key}) * 31) % 1000003"
    return f"((({p}) * ({p}) + 7 * ({q}) + 11) % 1000003)"


def draw(key: str, stream: int) -> str:
    """SQL of ``scramble`` as a number strictly between 0 and 1."""
    return f"(({scramble(key, stream)} + 0.5e0) / 1000003e0)"
