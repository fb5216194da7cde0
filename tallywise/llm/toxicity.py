"""Toxic passages: maximum-scoring segments over token log-odds, with extreme-value calibration.

Tokens are runs of ASCII letters, digits, ``_`` and non-ASCII bytes, ASCII lower-cased.  The score of
a token is the log-odds ratio of toxic against clean documents that have it, under Dirichlet
priors in three levels: the class sizes are the prior of the token's first 4 bytes, these of its
first 5 bytes, these of the token, each worth ``prior`` documents; so an unseen token has
the evidence of its beginning, and nothing known scores 0; so does a token that only repeats the
one before it.  Less ``drift`` per token, a linear-time
scan finds all maximal segments of a document at once.

Segment scores of clean documents that were not learned from fit a Gumbel law whose location
grows with the logarithm of the length.  A passage is significant if fewer than ``expect`` such
segments are to be expected in a clean document of that length.  The passages of a document are
aggregated by the sum statistic of r segments; its log p-value goes through a logistic at the
threshold that parts the calibration documents best.

Learned from about ``per_label`` labelled documents of each label (all, or those whose hash is under a
threshold), whole texts, none of them held out; one fifth of all rows by the same remainder (4) calibrates.  Null or empty
texts score as clean.  Without labelled rows every score is 0.  Rows that repeat a doc_id are
scored each; repeated labels count as toxic if any is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from math import lgamma, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywise.llm.common import SpanCache, held_out, lower_ascii, runs, sampled, slices, span_hashes, utf8
from tallywise.sources.staging import staged

_TOKEN = np.zeros(256, bool)
_TOKEN[[*range(48, 58), *range(65, 91), *range(97, 123), 95, *range(128, 256)]] = True
TOKEN, HEAD5, HEAD4 = 0, 1, 2


@dataclass
class Model:
    drift: float
    prior: float
    odds: float = 0.0
    keys: dict[int, np.ndarray] = field(default_factory=dict)
    toxic: dict[int, np.ndarray] = field(default_factory=dict)
    seen: dict[int, np.ndarray] = field(default_factory=dict)
    scale: float = 1.0
    place: float = 0.0
    cut: float = -1e9

    def score(self, hashes: dict[int, np.ndarray]) -> np.ndarray:
        """Log-odds of tokens, given the hashes of the token and its heads."""
        share = np.full(len(hashes[TOKEN]), 1 / (1 + np.exp(-self.odds)))
        for level in (HEAD4, HEAD5, TOKEN):
            keys = self.keys.get(level, np.zeros(0, np.uint64))
            if not len(keys):
                continue
            at = np.minimum(np.searchsorted(keys, hashes[level]), len(keys) - 1)
            hit = keys[at] == hashes[level]
            t, n = np.where(hit, self.toxic[level][at], 0), np.where(hit, self.seen[level][at], 0)
            share = (t + self.prior * share) / (n + self.prior)
        return np.log(share) - np.log1p(-share) - self.odds

    def log_p(self, segments: list[float], tokens: int) -> float:
        """Log p-value of the document: the best over r of the sum statistic of its r best segments."""
        x = np.sort((np.array(segments) - self.place) / self.scale - log(max(tokens, 1)))[::-1]
        best, total = 0.0, 0.0
        for r, part in enumerate(x[x > 0], 1):
            total += part
            best = min(best, -total + (r - 1) * log(max(total, 1)) - lgamma(r + 1) - lgamma(r) + r * log(2))
        return best


def tokens_of(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    starts, ends = runs(_TOKEN[data], bounds)
    return starts, ends, np.searchsorted(starts, bounds)


def _levels(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> dict[int, np.ndarray]:
    return {TOKEN: span_hashes(data, starts, ends)} | {k: span_hashes(data, starts, np.minimum(starts + n, ends)) for k, n in ((HEAD5, 5), (HEAD4, 4))}


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of a sequence, in linear time.

    Only positive entries can begin or end one, so the scan visits these and reads the sums between them.
    """
    total = np.concatenate([[0.0], np.cumsum(scores)])
    # start, end, sums before and after, and the nearest kept one before with a lower sum before it
    kept: list[tuple[int, int, float, float, int]] = []
    for i in np.flatnonzero(scores > 0).tolist():
        start, low, high = i, total[i], total[i + 1]
        j = len(kept) - 1
        while True:
            while j >= 0 and kept[j][2] >= low:
                j = kept[j][4]
            if j < 0 or kept[j][3] >= high:
                break
            start, _, low, _, before = kept[j]
            del kept[j:]
            j = before
        kept.append((start, i + 1, low, high, j))
    return [(a, b, float(high - low)) for a, b, low, high, _ in kept]


def _counts(docs: DataFrame) -> DataFrame:
    """(level, hash, toxic, seen): documents of (text, toxic) that have the token or head."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                data, bounds = utf8(part.column("text"))
                data = lower_ascii(data)
                starts, ends, first = tokens_of(data, bounds)
                toxic = part.column("toxic").to_numpy()
                for level, h in _levels(data, starts, ends).items():
                    each = [np.unique(h[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
                    label = np.repeat(toxic, [len(x) for x in each])
                    keys, back = np.unique(np.concatenate(each) if each else h, return_inverse=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(keys), level, np.int32)), pa.array(keys.view(np.int64)), pa.array(np.bincount(back, label, len(keys)).astype(np.int64)), pa.array(np.bincount(back, minlength=len(keys)).astype(np.int64))],
                        ["level", "hash", "toxic", "seen"],
                    )

    return docs.mapInArrow(run, "level int, hash long, toxic long, seen long").groupBy("level", "hash").agg(F.sum("toxic").alias("toxic"), F.sum("seen").alias("seen"))


def _sample(docs: DataFrame, labels: DataFrame, per_label: int) -> DataFrame:
    """(text, toxic, fold) of the bounded sample of labelled rows that are not held out."""
    once = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    open_ = once.filter(~held_out(F.col("doc_id"))).select("doc_id", F.when(F.col("toxic") > 0, 1).otherwise(0).alias("toxic"))
    few = staged(sampled(open_, "toxic", per_label, "toxic"))
    few = few.select("doc_id", "toxic", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5).alias("fold"))
    return docs.join(F.broadcast(few), "doc_id").select("text", "toxic", "fold")


def fit(docs: DataFrame, labels: DataFrame, per_label: int = 4000, drift: float = 1.0, prior: float = 4.0, least_seen: int = 2) -> Model:
    """``docs`` (doc_id, text), ``labels`` (doc_id, toxic).  Tokens in fewer than ``least_seen`` documents go by their heads."""
    model = Model(drift, prior)
    sample = _sample(docs, labels, per_label)
    learn = sample.filter("fold <> 4")
    sizes = {r["toxic"]: r["count"] for r in learn.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return model
    model.odds = log(sizes[1] / sizes[0])
    table = _counts(learn).filter(F.col("seen") >= least_seen).toArrow()
    level, keys = table.column("level").to_numpy(), table.column("hash").to_numpy().view(np.uint64)
    for k in (TOKEN, HEAD5, HEAD4):
        rows = np.flatnonzero(level == k)
        rows = rows[np.argsort(keys[rows])]
        model.keys[k], model.toxic[k], model.seen[k] = keys[rows], table.column("toxic").to_numpy()[rows], table.column("seen").to_numpy()[rows]
    check = _segments(sample.filter("fold = 4").select(F.col("toxic").cast("long").alias("doc_id"), "text"), model).toArrow().to_pylist()
    clean = [(max((s["score"] for s in r["passages"]), default=0.0), max(r["n_tokens"], 1)) for r in check if r["doc_id"] == 0]
    if clean:
        best, size = np.array(clean).T
        for _ in range(30):
            rest = best - model.scale * np.log(size)
            model.scale = max(0.15, float(rest.std()) * 6**0.5 / np.pi)
        model.place = float((best - model.scale * np.log(size)).mean()) - 0.5772 * model.scale
    p = np.array([model.log_p([s["score"] for s in r["passages"]], r["n_tokens"]) for r in check])
    y = np.array([r["doc_id"] for r in check])
    order = np.argsort(p)
    gain = np.cumsum(np.where(y[order] == 1, 1 / max(1, (y == 1).sum()), -1 / max(1, (y == 0).sum())))
    last = np.append(p[order][1:] != p[order][:-1], True)
    i = int(np.argmax(np.where(last, gain, -9.0))) if len(p) else 0
    if len(p):
        after = p[order][i + 1] if i + 1 < len(p) else 0.0
        model.cut = float((p[order][i] + after) / 2)
    return model


def _segments(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens and the maximal segments with a positive score: begin, end (characters), score."""
    kept = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, m = SpanCache(1), kept.value
        for batch in batches:
            for part in slices(batch, "text"):
                data, bounds = utf8(part.column("text"))
                data = lower_ascii(data)
                starts, ends, first = tokens_of(data, bounds)
                values, back = cache.get(span_hashes(data, starts, ends), lambda w, d=data, s=starts, e=ends: m.score(_levels(d, s[w], e[w]))[:, None])
                again = np.concatenate([[False], back[1:] == back[:-1]])[: len(back)]
                again[first[:-1][first[:-1] < len(back)]] = False
                scores = np.where(again, 0.0, values[back, 0].astype(float)) - m.drift
                chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                busy = np.concatenate([[0], np.cumsum(scores > 0)])
                found = []
                for d, (a, b) in enumerate(zip(first[:-1], first[1:], strict=True)):
                    some = maximal_segments(scores[a:b]) if busy[b] > busy[a] else []
                    found.append([{"begin": int(chars[starts[a + i]] - chars[bounds[d]]), "end": int(chars[ends[a + j - 1]] - chars[bounds[d]]), "score": s} for i, j, s in some])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(first)), pa.array(found, kind)], ["doc_id", "n_tokens", "passages"])

    return docs.mapInArrow(run, "doc_id long, n_tokens long, passages array<struct<begin: int, end: int, score: double>>")


def toxic_passages(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", expect: float = 0.05) -> DataFrame:
    """doc_id, score, and the significant passages (begin and end in characters, score) of every row."""
    kept = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = kept.value
        for batch in batches:
            scores, passages = [], []
            for n, some in zip(batch.column("n_tokens").to_pylist(), batch.column("passages").to_pylist(), strict=True):
                least = m.place + m.scale * log(max(n, 1) / expect)
                passages.append([s for s in some if s["score"] >= least])
                p = m.log_p([s["score"] for s in some], n) if some else 0.0
                scores.append(0.0 if m.cut <= -1e9 else 1 / (1 + np.exp(np.clip(p - m.cut, -50, 50))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array(passages, kind)], ["doc_id", "score", "passages"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return _segments(rows, model).mapInArrow(run, "doc_id long, score double, passages array<struct<begin: int, end: int, score: double>>")


def toxicity(docs: DataFrame, labels: DataFrame, **params) -> DataFrame:
    """doc_id, held_out, score, predicted, n_passages of every row, by a model fitted on labelled rows that are not held out."""
    texts = docs.select("doc_id", "text")
    found = toxic_passages(texts, fit(texts, labels.select("doc_id", "toxic"), **params))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))
