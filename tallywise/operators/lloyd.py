"""K-means with as many clusters as you like: points stay in their tasks, and blocks of centres pass.

The centres are a table; nothing but counts reaches the driver.  A round costs the product of the points and of the centres that have
moved, so the first rounds are all pairs and the last ones hardly any.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywise.operators.kernel import _in_grid, _runs, _vectors, _x_type
from tallywise.operators.order import positions
from tallywise.sources.staging import release, staged
from tallywise.tables import uniform

#: Rounds in which the first centres are drawn, and of moving them at most (that of Spark's own KMeans).
DRAWS, ROUNDS = 5, 20
#: Points in a block and in a task, points that meet a block of centres at once, and centres in a block.
BLOCK, POINTS, SLICE, CENTRES = 256, 1 << 15, 1024, 512
#: Changed clusters whose names are broadcast.
FEW = 500_000


def clusters(features: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """(item_id, cluster) by Lloyd's rounds until nothing changes, ROUNDS of them at most; ties go to the lower cluster.

    The first centres are points: a share at random, then in each round more with a chance by the squared distance to those drawn before.
    There are fewer than k clusters where there are fewer different points, or equal ones are drawn in one round.
    """
    x_type, id_type = _x_type(features), features.schema["item_id"].dataType.simpleString()
    rows = features.select("item_id", F.col("x").cast(x_type).alias("x"))
    n = rows.count()
    lots = max(1, -(-n // BLOCK))
    groups = min(lots, max(-(-n // POINTS), 2 * features.sparkSession.sparkContext.defaultParallelism))
    packed = rows.groupBy(F.pmod(F.xxhash64("item_id"), F.lit(lots)).alias("lot")).agg(F.sort_array(F.collect_list(F.struct("item_id", "x"))).alias("rows"))
    none = lambda value, kind: F.transform("rows", lambda _: F.lit(value).cast(kind))
    state = staged(packed.select("lot", F.col("rows.item_id").alias("ids"), F.col("rows.x").alias("xs"), none(-1, "int").alias("cs"), none(-1, "int").alias("was"), none(float("inf"), "double").alias("ds")))
    centres, per, have = None, -(-k // DRAWS), 0
    for t in range(DRAWS):
        each = state.select(F.explode(F.arrays_zip("ids", "ds")).alias("e")).select(F.col("e.ids").alias("item_id"), F.col("e.ds").alias("d2"))
        weight = F.when(F.col("d2") == float("inf"), 1.0).otherwise(F.col("d2"))
        keys = positions(each.filter("d2 > 0").select("item_id", (-F.ln(uniform(seed, F.lit(t), "item_id")) / weight).alias("key")), ["key", "item_id"])
        drawn = staged(keys.filter(F.col("pos") < min(per, k - have)).select("item_id", (F.col("pos") + have).cast("int").alias("cluster")))
        new = staged(drawn.join(rows.hint("merge"), "item_id").select("cluster", F.col("x").cast("array<double>").alias("x")))
        if not (many := new.count()):
            break
        have += many
        old, state = state, _assigned(state, new.withColumn("still", F.lit(False)), k, many, groups, id_type, x_type)
        release(old)
        centres = new if centres is None else centres.unionByName(new)
    if centres is None:
        return rows.select("item_id", F.lit(0).alias("cluster"))
    centres, changed, many = staged(centres), None, k
    for _ in range(ROUNDS):
        means = _means(state, changed, many, id_type, x_type)
        moved = staged(centres.join(means.hint("merge"), "cluster", "left").select("cluster", F.coalesce("m", "x").alias("x"), F.col("m").isNull().alias("still")))
        old, state = state, _assigned(state, moved, k, many, groups, id_type, x_type)
        release(old, centres)
        centres = moved
        pairs = state.select(F.explode(F.arrays_zip("cs", "was")).alias("e")).filter("e.cs <> e.was")
        changed = staged(pairs.select(F.explode(F.array("e.cs", "e.was")).alias("cluster")).distinct())
        if not (many := changed.count()):
            break
    return state.select(F.explode(F.arrays_zip("ids", "cs")).alias("e")).select(F.col("e.ids").alias("item_id"), F.col("e.cs").alias("cluster"))


def _means(state: DataFrame, changed: DataFrame | None, many: int, id_type: str, x_type: str) -> DataFrame:
    """(cluster, m): the means of the ``many`` clusters ``changed`` (of all without it), summed in the order of the ids."""
    rows = state.select(F.explode(F.arrays_zip("cs", "ids", "xs")).alias("e")).select(F.col("e.cs").alias("cluster"), F.col("e.ids").alias("item_id"), F.col("e.xs").alias("x"))
    if changed is not None:
        rows = rows.join(F.broadcast(changed) if many <= FEW else changed.hint("merge"), "cluster", "left_semi")
    parts = 4 * state.sparkSession.sparkContext.defaultParallelism
    dealt = rows.repartition(parts, "cluster").sortWithinPartitions("cluster", "item_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total, n = None, None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.asarray(batch.column("x").flatten()).reshape(batch.num_rows, -1).astype(np.float64)
            starts = _runs(batch, ["cluster"])
            names, sums, many = np.asarray(batch.column("cluster"))[starts], np.add.reduceat(x, starts), np.diff([*starts, batch.num_rows])
            if at == names[0]:
                sums[0], many[0] = sums[0] + total, many[0] + n
            elif at is not None:
                yield one([at], total[None], np.array([n]))
            if len(names) > 1:
                yield one(names[:-1], sums[:-1], many[:-1])
            at, total, n = names[-1], sums[-1], many[-1]
        if at is not None:
            yield one([at], total[None], np.array([n]))

    def one(names: np.ndarray, sums: np.ndarray, many: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), _lists(sums / many[:, None])], ["cluster", "m"])

    return dealt.mapInArrow(run, "cluster int, m array<double>")


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))


def _assigned(state: DataFrame, centres: DataFrame, k: int, many: int, groups: int, id_type: str, x_type: str) -> DataFrame:
    """The state with each point at its nearest centre of (cluster, x, still); ``was`` is the cluster before.  About ``many`` have moved.

    A point whose own centre is ``still`` meets those that have moved, and so does one that is as near to one of these as it was to its own:
    no other centre is nearer.  Only the other points meet all.
    """
    blocks = F.when(F.col("still"), -(-k // CENTRES)).otherwise(-(-many // CENTRES))
    # moved ones come first
    lot = F.when(F.col("still"), F.lit(1 << 31)).otherwise(F.lit(0)).cast("long") + F.pmod(F.xxhash64("cluster"), blocks)
    right = centres.groupBy("still", lot.alias("lot")).agg(F.sort_array(F.collect_list(F.struct("cluster", "x"))).alias("rows")).select("lot", "still", F.col("rows.cluster").alias("names"), F.col("rows.x").alias("at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        x, gone, open_ = None, np.zeros(k + 1, bool), None
        columns = ["lot", "ids", "xs", "cs", "was", "ds"]

        def settle() -> np.ndarray:
            """Points whose centre has not moved may stay; those that must see the others."""
            moved = gone[own]
            stay = ~moved & ((best < new) | ((best == new) & (own < who)))
            new[stay], who[stay] = best[stay], own[stay]
            return np.flatnonzero(moved & (new > best))

        for batch in batches:
            for i in range(batch.num_rows):
                if batch.column("side")[i].as_py() == 0:
                    held.append(batch.select(columns).slice(i, 1))
                    continue
                if not held:
                    return
                if x is None:
                    x = np.concatenate([_vectors(b.column("xs")[0]) for b in held]).astype(np.float64)
                    own = np.concatenate([np.asarray(b.column("cs")[0].values) for b in held])
                    best = np.concatenate([np.asarray(b.column("ds")[0].values) for b in held])
                    new, who, origin = np.full(len(x), np.inf), np.full(len(x), k, np.int32), x.mean(0)
                    every = np.arange(len(x))
                c, names = _vectors(batch.column("at")[i]), np.asarray(batch.column("names")[i].values)
                if batch.column("still")[i].as_py():
                    open_ = settle() if open_ is None else open_
                    some = open_
                else:
                    gone[names] = True
                    some = every
                for lot in range(0, len(some), SLICE):
                    _nearer(x, origin, some[lot : lot + SLICE], c, names, new, who)
        if x is not None and open_ is None:
            settle()
        start = 0
        for b in held:
            end = start + len(b.column("ids")[0].values)
            one = lambda v, t: pa.array([v], pa.list_(t))
            if x is not None:
                b = pa.RecordBatch.from_arrays([*(b.column(c) for c in columns[:3]), one(who[start:end], pa.int32()), b.column("cs"), one(new[start:end], pa.float64())], columns)
            yield b
            start = end

    schema = f"lot long, ids array<{id_type}>, xs array<{x_type}>, cs array<int>, was array<int>, ds array<double>"
    return staged(_in_grid(state, right, groups, 1).mapInArrow(run, schema))


def _nearer(x: np.ndarray, origin: np.ndarray, rows: np.ndarray, c: np.ndarray, names: np.ndarray, new: np.ndarray, who: np.ndarray) -> None:
    """Takes the centres ``c`` that are nearer to ``x[rows]`` than ``new``, or as near with a lower name, into ``new`` and ``who``.

    A product in single precision tells which pairs can be; these are compared by the differences in double precision.
    """
    a, b = x[rows] - origin, c - origin
    aa, bb = np.einsum("ij,ij->i", a, a), np.einsum("ij,ij->i", b, b)
    most = bb.max()
    kind = np.float32 if aa.max() + most < 1e30 else np.float64
    d2 = (-2 * a).astype(kind) @ b.astype(kind).T
    d2 += bb.astype(kind)
    # the bound of the rounding errors of such a product
    slack = (a.shape[1] + 16) * float(np.finfo(np.float32).eps) * (aa + most) + 1e-30
    least = d2.min(1)
    limit = np.minimum(new[rows] - aa, least + slack) + slack
    low = np.flatnonzero(least <= limit)
    if not len(low):
        return
    at, to = np.nonzero(d2[low] <= limit[low, None])
    for lot in range(0, len(at), 1 << 14):
        r, j = rows[low[at[lot : lot + (1 << 14)]]], to[lot : lot + (1 << 14)]
        exact = np.square(x[r] - c[j]).sum(1)
        order = np.lexsort((names[j], exact, r))
        r, j, exact = r[order], j[order], exact[order]
        first = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
        r, j, exact = r[first], names[j[first]], exact[first]
        take = (exact < new[r]) | ((exact == new[r]) & (j < who[r]))
        new[r[take]], who[r[take]] = exact[take], j[take]
