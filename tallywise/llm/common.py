"""What the operators share: tables written to the shared folder, and texts as byte arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Texts are handled in slices of about so many bytes, so that memory follows the slice, not the batch.
SLICE_BYTES = 1 << 20


def spare_name(df: DataFrame, name: str) -> str:
    """``name``, or a longer one where ``df`` has such a column already."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def split_join(rows: DataFrame, table: DataFrame, keys: list[str], times: str, total: int, left: bool = False) -> DataFrame:
    """``rows`` joined with ``table``, which has each key once and in ``times`` how many of the ``total`` rows have it.

    Keys with more rows than a fraction of a task's share are at most 4 a shuffle partition, so these few are broadcast and
    their rows stay where they are; the others meet by a shuffle.  ``table`` should be a written one.
    """
    from pyspark.sql import functions as F

    how = "left" if left else "inner"
    limit = total // (4 * max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))) + 1
    heavy, light = table.filter(F.col(times) > limit), table.filter(F.col(times) <= limit)
    if heavy.isEmpty():
        return rows.join(table.hint("merge"), keys, how)
    rest = rows.join(F.broadcast(heavy.select(*keys)), keys, "left_anti").join(light.hint("merge"), keys, how)
    return rows.join(F.broadcast(heavy), keys).unionByName(rest)


def sampled(rows: DataFrame, key: str, per: int, salt: str, id_col: str = "doc_id") -> DataFrame:
    """Of each value of ``key`` the rows whose hash of id and salt is under a threshold: all, or about ``per + 4 * sqrt(per)``.

    The threshold comes from the counts of the values, so no task ranks the rows of one value.
    """
    from pyspark.sql import functions as F

    from tallywise.sources.staging import staged

    size = spare_name(rows, "n_rows")
    counts = staged(rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias(size)))
    total = counts.agg(F.sum(size)).first()[0] or 0
    drawn = F.shiftrightunsigned(F.xxhash64(id_col, F.lit(salt)), 11) / float(1 << 53)
    return split_join(rows, counts, [key], size, total).filter(drawn * F.col(size) < per + 4 * per**0.5 + 4).drop(size)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def slices(batch: pa.RecordBatch, text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch between rows so that each part holds about ``most`` bytes of ``text`` (one row at least)."""
    column = batch.column(text)
    sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0), dtype=np.int64)
    ends, start, total = np.cumsum(sizes), 0, len(sizes)
    while start < total:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row, and where each text starts (one entry more than texts); null is empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z to lower case, other bytes unchanged."""
    return np.where((data >= 65) & (data <= 90), data | 0x20, data).astype(np.uint8)


def runs(inside: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true entries, cut at the bounds between texts."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(len(inside) + 1, bool)
    edge[bounds] = True
    before, after = np.empty_like(inside), np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    after[-1], after[:-1] = False, inside[1:]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends


def words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+``: start, end, and the index of the first word of each text (and the total)."""
    starts, ends = runs(~_SPACE[data], bounds)
    return starts, ends, np.searchsorted(starts, bounds)


_BASE = np.uint64(0x9E3779B97F4A7C15)
_UNBASE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads 64 bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n - 1, at least, of the base and of its inverse."""
    if len(_POWERS[0]) <= n:
        for i, base in enumerate((_BASE, _UNBASE)):
            p = np.full(n + 1, base, np.uint64)
            p[0] = 1
            _POWERS[i] = np.multiply.accumulate(p)
    return _POWERS[0], _POWERS[1]


def prefix_hashes(data: np.ndarray):
    """A function of (starts, length) that gives the hashes of ``span_hashes`` of spans of one length."""
    up, down = _powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return lambda starts, length: mix((sums[starts + length] - sums[starts]) * down[starts] + np.uint64(length))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans, from prefix sums of a polynomial modulo 2^64."""
    n = len(data)
    up, down = _powers(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


class SpanCache:
    """Values of spans by hash, kept over the slices of a task; emptied when it grows past ``most``."""

    def __init__(self, width: int, most: int = 300_000) -> None:
        self.keys, self.values, self.most = np.zeros(0, np.uint64), np.zeros((0, width), np.float32), most

    def get(self, hashes: np.ndarray, compute) -> tuple[np.ndarray, np.ndarray]:
        """Values of the distinct hashes, and for each hash the index of its value.

        ``compute`` gets the index (in ``hashes``) of one span of each kind that isn't known yet.
        """
        distinct, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, distinct)
        known = np.zeros(len(distinct), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == distinct[inside]
        if not known.all():
            fresh = compute(first[~known]).astype(np.float32)
            self.values = np.insert(self.values, at[~known], fresh, axis=0)
            self.keys = np.insert(self.keys, at[~known], distinct[~known])
            at = np.searchsorted(self.keys, distinct)
        out = self.values[at]
        if len(self.keys) > self.most:
            self.keys, self.values = self.keys[:0], self.values[:0]
        return out, back


def per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the rows of ``values`` that belong to each text; ``first`` as from ``words``."""
    sums = np.zeros((len(values) + 1, *values.shape[1:]))
    np.cumsum(values, axis=0, out=sums[1:])
    return sums[first[1:]] - sums[first[:-1]]


def held_out(doc_id):
    """The rows that no model may learn from: crc32 of doc_id as text leaves 0 when divided by 5."""
    from pyspark.sql import functions as F

    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0
