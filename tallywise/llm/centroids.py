"""Centroid clustering of integer vectors with scalar lookup tables.

Vectors with exactly ``dims`` components, all of them finite, are kept; component x becomes floor(scale * x).  In a round every task
tabulates, for each dimension, the squared difference of each integer value that occurs in its slice to each centroid; the distances of the
slice's vectors are gathers from these tables and their sums.  Tasks return one row of sums per cluster; the driver sees k x dims sums
in all.  Integer sums and floors make the result independent of partitions.

A null vector, one of another length and one with a null or non-finite component are left out.  A null id is hashed as an empty
text; rows that repeat an id are vectors each; equal hashes go by the vector.  Fewer vectors than ``k`` give fewer centroids, none
an empty result.  Integers beyond +-2^27 count as that bound, since distances would not fit a long.  Other columns are not touched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywise.sources.staging import staged

#: Vectors in a slice; its tables have at most so many values in a dimension.
SLICE = 8192
MOST = 1 << 27


def integer_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = 64, scale: int = 64) -> DataFrame:
    """(vec_id, v): the kept vectors as integers."""
    x = F.col(vector_col).cast("array<double>")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    # a value beyond the bound is cut as a double, where it has no overflow
    cut = lambda c: F.floor(F.least(F.greatest(c * float(scale), F.lit(-float(MOST))), F.lit(float(MOST)))).cast("int")
    return rows.filter((F.size(vector_col) == dims) & finite).select(F.col(id_col).alias("vec_id"), F.transform(x, cut).alias("v"))


def occurring(column: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of a column in ascending order, and for each entry the place of its value."""
    low = int(column.min())
    span = int(column.max()) - low + 1
    if span > 4 * len(column):
        return np.unique(column, return_inverse=True)
    seen = np.zeros(span, bool)
    seen[column - low] = True
    return np.flatnonzero(seen) + low, (np.cumsum(seen) - 1)[column - low]


def distances(block: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of ``block`` to the centroids, from a table per dimension."""
    total = np.zeros((len(block), len(centroids)), np.int64)
    for d in range(block.shape[1]):
        values, place = occurring(block[:, d])
        table = np.square(values[:, None] - centroids[None, :, d])
        total += table[place]
    return total


def _slices(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE):
            part = batch.slice(start, SLICE)
            yield part, np.asarray(part.column("v").flatten(), np.int64).reshape(-1, dims)


def _moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after a round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, dims = centroids.shape
        sums, sizes = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for _, block in _slices(batches, dims):
            near = distances(block, centroids).argmin(1)
            sizes += np.bincount(near, minlength=k)
            order = np.argsort(near, kind="stable")
            found, first = np.unique(near[order], return_index=True)
            sums[found] += np.add.reduceat(block[order], first, axis=0)
        full = np.flatnonzero(sizes)
        yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(sizes[full]), pa.array(list(sums[full]), pa.list_(pa.int64()))], ["cluster", "size", "sums"])

    parts = vectors.mapInArrow(run, "cluster int, size long, sums array<long>")
    cells = parts.select("cluster", "size", F.posexplode("sums").alias("d", "s")).groupBy("cluster", "d")
    now = centroids.copy()
    for r in cells.agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum(F.col("size").cast("decimal(38,0)")).alias("n")).collect():
        now[r["cluster"], r["d"]] = int(r["s"]) // int(r["n"])
    return now


def cluster(rows: DataFrame, k: int = 16, rounds: int = 3, seed: int = 1, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = 64, scale: int = 64) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of every kept vector, and the centroids that were its choice.

    Centroids start as the k vectors with the smallest hashes of ``seed:id``; ties in distance go to the smaller number.
    """
    spark = rows.sparkSession
    vectors = staged(integer_vectors(rows, id_col, vector_col, dims, scale))
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    start = vectors.select(mark.alias("mark"), "v").orderBy("mark", "v").limit(k).collect()
    if not start:
        id_type = vectors.schema["vec_id"].dataType.simpleString()
        return spark.createDataFrame([], f"vec_id {id_type}, cluster int, distance long"), np.zeros((0, dims), np.int64)
    centroids = np.array([r["v"] for r in start], np.int64)
    for _ in range(rounds):
        centroids = _moved(vectors, centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, block in _slices(batches, centroids.shape[1]):
            d = distances(block, centroids)
            near = d.argmin(1)
            yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(d)), near])], ["vec_id", "cluster", "distance"])

    id_type = vectors.schema["vec_id"].dataType.simpleString()
    return staged(vectors.mapInArrow(run, f"vec_id {id_type}, cluster int, distance long")), centroids


def clusters(rows: DataFrame, k: int = 16, rounds: int = 3, seed: int = 1) -> DataFrame:
    """One row per kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    near, centroids = cluster(rows, k, rounds, seed)
    sums = {r["cluster"]: int(r["s"]) for r in near.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    table = [(c, s, sum(sums.values()), digests[c]) for c, s in sums.items()]
    # at most k rows
    side = rows.sparkSession.createDataFrame(table, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return near.join(F.broadcast(side), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle(rounds: int = 3) -> str:
    out = [
        "e AS MATERIALIZED (SELECT vec_id, unnest(range(64)) AS d, unnest(list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT))) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)",
        "s AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS c FROM (SELECT DISTINCT vec_id FROM e) t QUALIFY c < 16)",
        "c0 AS MATERIALIZED (SELECT c, d, v FROM s JOIN e ON e.vec_id = s.vec_id)",
    ]
    for t in range(rounds + 1):
        out += [
            f"d{t} AS (SELECT vec_id, c, sum((e.v - k.v) * (e.v - k.v)) AS dist FROM e JOIN c{t} k ON k.d = e.d GROUP BY vec_id, c)",
            f"a{t} AS MATERIALIZED (SELECT vec_id, c, dist FROM d{t} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY dist, c) = 1)",
        ]
        if t < rounds:
            out += [
                f"m{t} AS (SELECT c, d, sum(v) AS s, count(*) AS n FROM a{t} JOIN e ON e.vec_id = a{t}.vec_id GROUP BY c, d)",
                f"c{t + 1} AS MATERIALIZED (SELECT k.c, k.d, CAST(coalesce((s - ((s % n) + n) % n) // n, k.v) AS BIGINT) AS v FROM c{t} k LEFT JOIN m{t} m ON m.c = k.c AND m.d = k.d)",
            ]
    return (
        "WITH " + ",\n".join(out) + f""",
h AS (SELECT c, sha256(string_agg(v::VARCHAR, ',' ORDER BY d)) AS centroid_sha256 FROM c{rounds} GROUP BY c)
SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(dist AS BIGINT) AS distance, CAST(sum(dist) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(dist) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a{rounds} a JOIN h ON h.c = a.c"""
    )


ORACLE = _oracle()
