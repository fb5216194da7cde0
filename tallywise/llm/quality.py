"""Quality grades by ordinal cumulative-link regression on hashed text.

``P(grade >= j) = sigmoid(w . x - threshold_j)`` with one weight vector for all thresholds, which are
kept in order by positive steps.  x is the mean over a text's words of two hashed features,
the word and its shape (runs of upper case, lower case, digits; other signs as they are), the
share of words that repeat the one before, and two bins: share of distinct words, and word count.
A mean of per-word features needs only per-word weights, so a task weighs each distinct word once.

Fitted in numpy on the driver on about ``per_grade`` rated documents of each grade (all, or those whose
hash is under a threshold), none of them held out.  Null and empty texts have the bins alone.  Without ratings every
probability is 0.  Rows that repeat a doc_id are graded each; of repeated ratings the lowest counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywise.llm.common import SpanCache, held_out, lower_ascii, per_text, sampled, slices, span_hashes, utf8, words
from tallywise.sources.staging import staged

#: Buckets of hashed features; behind them the repeat share, 10 bins of distinct share, 16 of length.
BITS = 15
REPEAT = 1 << BITS
DISTINCT, LENGTH = REPEAT + 1, REPEAT + 12
SIZE = LENGTH + 16
#: The means are stretched so that gradient steps suit all features.
STRETCH = 8.0

_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[48:58], _SHAPE[65:91] = ord("9"), ord("X")
_SHAPE[97:123] = _SHAPE[128:] = ord("x")


@dataclass
class Grades:
    weights: np.ndarray
    thresholds: np.ndarray


def _features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Buckets (word, shape) of each span."""
    top = np.uint64(64 - BITS)
    shape = _SHAPE[data]
    keep = np.ones(len(data), bool)
    keep[1:] = shape[1:] != shape[:-1]
    keep[starts] = True
    at = np.concatenate([[0], np.cumsum(keep)])
    return np.stack([span_hashes(lower_ascii(data), starts, ends) >> top, (span_hashes(shape[keep], at[starts], at[ends]) * np.uint64(0xD6E8FEB86659FD93)) >> top], axis=1).astype(np.int64)


def _bins(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: share of words that repeat the one before, and the indexes of its two bins."""
    n = np.diff(first)
    again = np.concatenate([[False], hashes[1:] == hashes[:-1]])[: len(hashes)]
    again[first[:-1][first[:-1] < len(hashes)]] = False
    distinct = np.array([len(np.unique(hashes[a:b])) for a, b in zip(first[:-1], first[1:], strict=True)], float)
    share = per_text(again[:, None].astype(float), first)[:, 0] / np.maximum(n, 1)
    return share, DISTINCT + (10 * distinct / np.maximum(n, 1)).astype(int), LENGTH + np.minimum(np.log2(n + 1).astype(int), 15)


def _rows(docs: DataFrame) -> DataFrame:
    """(grade, columns, values) of each document: its sparse features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                data, bounds = utf8(part.column("text"))
                starts, ends, first = words(data, bounds)
                found, h = _features(data, starts, ends), span_hashes(lower_ascii(data), starts, ends)
                share, distinct, size = _bins(h, first)
                columns, values = [], []
                for i, (a, b) in enumerate(zip(first[:-1], first[1:], strict=True)):
                    c, n = np.unique(found[a:b], return_counts=True)
                    columns.append([*c.tolist(), REPEAT, int(distinct[i]), int(size[i])])
                    values.append([*(STRETCH * n / max(1, b - a)).tolist(), STRETCH * share[i], 1.0, 1.0])
                yield pa.RecordBatch.from_arrays([part.column("grade"), pa.array(columns, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32()))], ["grade", "columns", "values"])

    return docs.mapInArrow(run, "grade int, columns array<int>, values array<float>")


def fit(docs: DataFrame, ratings: DataFrame, per_grade: int = 2000, rounds: int = 250, rate: float = 0.05, ridge: float = 1e-4) -> Grades | None:
    """``docs`` (doc_id, text), ``ratings`` (doc_id, grade from 0)."""
    once = ratings.filter("grade IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("grade").cast("int").alias("grade"))
    few = staged(sampled(once.filter(~held_out(F.col("doc_id"))), "grade", per_grade, "quality").select("doc_id", "grade"))
    table = _rows(docs.join(F.broadcast(few), "doc_id").select("grade", "text")).toArrow()
    if not table.num_rows:
        return None
    y = table.column("grade").to_numpy()
    lists = table.column("columns").combine_chunks()
    owner = np.repeat(np.arange(len(y)), np.diff(lists.offsets.to_numpy()))
    cols, vals = lists.flatten().to_numpy(), table.column("values").combine_chunks().flatten().to_numpy().astype(float)
    kinds = int(y.max())
    if kinds < 1:
        return None
    weight = (len(y) / np.maximum(np.bincount(y, minlength=kinds + 1), 1))[y]
    weight /= weight.sum()
    w, first, steps = np.zeros(SIZE), np.zeros(1), np.zeros(kinds - 1)
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in (w, first, steps)]
    for t in range(1, rounds + 1):
        _, grads = loss_and_gradients(w, first, steps, owner, cols, vals, y, weight, ridge)
        for param, g, (m, v) in zip((w, first, steps), grads, state, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            param -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return Grades(w, np.concatenate([first, first + np.cumsum(np.exp(steps))]))


def loss_and_gradients(w: np.ndarray, first: np.ndarray, steps: np.ndarray, owner: np.ndarray, cols: np.ndarray, vals: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float) -> tuple[float, tuple[np.ndarray, ...]]:
    """Weighted negative log-likelihood of the grades, with a ridge, and its gradients by weights, first threshold and log-steps.

    Entry i of ``cols`` and ``vals`` is a feature of row ``owner[i]``.  The likelihood of grade k is s_k - s_{k+1} with
    s_j = sigmoid(f - cut_j).
    """
    f = np.bincount(owner, vals * w[cols], len(y))
    cuts = np.concatenate([first, first + np.cumsum(np.exp(steps))])
    kinds = len(cuts)
    s = 1 / (1 + np.exp(-np.clip(f[:, None] - cuts, -30, 30)))
    bound = np.concatenate([np.ones((len(y), 1)), s, np.zeros((len(y), 1))], axis=1)
    rows = np.arange(len(y))
    p = np.maximum(bound[rows, y] - bound[rows, y + 1], 1e-9)
    d = np.zeros_like(s)  # of the log-likelihood by each s
    low, high = y > 0, y < kinds
    d[rows[low], y[low] - 1] += 1 / p[low]
    d[rows[high], y[high]] -= 1 / p[high]
    by = -(weight[:, None] * d * s * (1 - s))
    cut_grad = -by.sum(0)
    loss = -(weight * np.log(p)).sum() + ridge / 2 * (w**2).sum()
    return loss, (np.bincount(cols, vals * by.sum(1)[owner], len(w)) + ridge * w, cut_grad.sum(keepdims=True), np.array([cut_grad[j + 1 :].sum() for j in range(kinds - 1)]) * np.exp(steps))


def grade(docs: DataFrame, model: Grades | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, expected_grade, and tails: the probabilities of each grade from 1 on or a higher one."""
    kept = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, cache = kept.value, SpanCache(1)
        for batch in batches:
            for part in slices(batch, "text"):
                if m is None:
                    tails = np.zeros((part.num_rows, 1))
                else:
                    data, bounds = utf8(part.column("text"))
                    starts, ends, first = words(data, bounds)
                    exact, h = span_hashes(data, starts, ends), span_hashes(lower_ascii(data), starts, ends)
                    share, distinct, size = _bins(h, first)
                    values, back = cache.get(exact, lambda i, d=data, s=starts, e=ends: m.weights[_subset(d, s[i], e[i])].sum(1)[:, None])
                    mean = per_text(values[back], first)[:, 0] / np.maximum(np.diff(first), 1)
                    f = STRETCH * mean + STRETCH * share * m.weights[REPEAT] + m.weights[distinct] + m.weights[size]
                    tails = 1 / (1 + np.exp(-np.clip(f[:, None] - m.thresholds, -30, 30)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(tails.sum(1)), pa.array(list(tails), pa.list_(pa.float64()))], ["doc_id", "expected_grade", "tails"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, expected_grade double, tails array<double>")


def _subset(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Features of some spans: their bytes are first put together, so that the work follows their length."""
    size = ends - starts
    to = np.cumsum(size)
    at = np.repeat(starts - (to - size), size) + np.arange(to[-1] if len(to) else 0)
    return _features(data[at], to - size, to)


def quality(docs: DataFrame, ratings: DataFrame, least: float = 0.5, **params) -> DataFrame:
    """doc_id, held_out, score, expected_grade, p_top and kept of every row.

    ``score`` is the probability of a grade over 0, ``p_top`` that of the highest; kept where the score reaches ``least``.
    """
    texts = docs.select("doc_id", "text")
    found = grade(texts, fit(texts, ratings, **params))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("tails")[0].alias("score"), "expected_grade", F.element_at("tails", -1).alias("p_top"), (F.col("tails")[0] >= least).alias("kept"))


def usefulness(labels: DataFrame) -> DataFrame:
    """Grades from the label table: 0 poor, 1 good but toxic, 2 good (null where quality is)."""
    return labels.select("doc_id", F.when(F.col("quality") <= 0, 0).when(F.col("toxic") > 0, 1).when(F.col("quality") > 0, 2).alias("grade"))
