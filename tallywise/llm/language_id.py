"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads the bytes of each run of letters (ASCII letters lower-cased; long runs in windows
of ``WINDOW`` bytes) in both directions and labels every position; the probabilities of a
document's positions are pooled.  It is trained in numpy by backpropagation through time, on the
driver, from a bounded sample of labelled documents: about ``per_language`` documents for each language (all,
or those whose hash is under a threshold), of longer ones ``PIECES`` even pieces of ``longest`` characters together.  Beyond
``most_languages`` languages each has fewer documents, so that all are learned from as many documents.
At most ``most_windows`` windows are read, as evenly over the languages as these have them.  State
starts anew at each run, so equal runs give equal labels: a task labels each distinct run once.

A null text, or one without a letter, is ``und`` with score 0, as is everything if nothing could be
learned.  Ties go to the first language in code-point order.  The score is the pooled probability.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywise.llm.common import SpanCache, held_out, lower_ascii, per_text, runs, sampled, slices, spare_name, span_hashes, utf8
from tallywise.sources.staging import staged

WINDOW, HIDDEN, PIECES = 24, 16, 8
_LETTER = np.zeros(256, bool)
_LETTER[ord("a") : ord("z") + 1] = _LETTER[ord("A") : ord("Z") + 1] = _LETTER[128:] = True


def letter_windows(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the windows that the network reads, and the first of each text."""
    starts, ends = runs(_LETTER[data], bounds)
    parts = -(-(ends - starts) // WINDOW)
    which = np.repeat(np.arange(len(starts)), parts)
    step = np.arange(len(which)) - np.repeat(np.cumsum(parts) - parts, parts)
    a = starts[which] + step * WINDOW
    b = np.minimum(a + WINDOW, ends[which])
    return a, b, np.searchsorted(a, bounds)


class ByteGru:
    """Parameters and the forward and backward passes; batches hold windows of one length."""

    def __init__(self, labels: int, seed: int = 7) -> None:
        r, h = np.random.default_rng(seed), HIDDEN
        self.p = {
            "embed": r.normal(0, 0.3, (2, 256, 3 * h)),
            "recur": r.normal(0, 1 / np.sqrt(h), (2, h, 3 * h)),
            "out": r.normal(0, 0.3, (2 * h, labels)),
            "bias": np.zeros(labels),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def _run(self, x: np.ndarray, d: int, keep: list | None = None) -> np.ndarray:
        """Hidden states (length, batch, HIDDEN) of direction ``d``."""
        h = np.zeros((len(x), HIDDEN), np.float32)
        states = np.empty((x.shape[1], len(x), HIDDEN), np.float32)
        embed, recur = self.p["embed"][d], self.p["recur"][d]
        for t in range(x.shape[1]) if d == 0 else reversed(range(x.shape[1])):
            e, u = embed[x[:, t]], h @ recur
            gates = 1 / (1 + np.exp(-np.clip(e[:, : 2 * HIDDEN] + u[:, : 2 * HIDDEN], -30, 30)))
            z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
            un = u[:, 2 * HIDDEN :]
            n = np.tanh(e[:, 2 * HIDDEN :] + r * un)
            if keep is not None:
                keep.append((t, h, z, r, n, un))
            h = (1 - z) * n + z * h
            states[t] = h
        return states

    def label(self, x: np.ndarray) -> np.ndarray:
        """Probabilities (length, batch, labels) of each position."""
        s = np.concatenate([self._run(x, 0), self._run(x, 1)], axis=2) @ self.p["out"] + self.p["bias"]
        s = np.exp(s - s.max(2, keepdims=True))
        return s / s.sum(2, keepdims=True)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy over all positions."""
        kept: tuple[list, list] = ([], [])
        both = np.concatenate([self._run(x, d, kept[d]) for d in (0, 1)], axis=2)
        s = both @ self.p["out"] + self.p["bias"]
        s = np.exp(s - s.max(2, keepdims=True))
        s /= s.sum(2, keepdims=True)
        s[:, np.arange(len(y)), y] -= 1
        s /= x.size
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        g["out"], g["bias"] = np.einsum("tbh,tbk->hk", both, s), s.sum((0, 1))
        ds = s @ self.p["out"].T
        for d in (0, 1):
            dh = np.zeros((len(x), HIDDEN), np.float32)
            for t, h, z, r, n, un in reversed(kept[d]):
                dh = dh + ds[t][:, d * HIDDEN : (d + 1) * HIDDEN]
                dn = dh * (1 - z) * (1 - n * n)
                dz = dh * (h - n) * z * (1 - z)
                dr = dn * un * r * (1 - r)
                de = np.concatenate([dz, dr, dn], axis=1)
                du = np.concatenate([dz, dr, dn * r], axis=1)
                np.add.at(g["embed"][d], x[:, t], de)
                g["recur"][d] += h.T @ du
                dh = dh * z + du @ self.p["recur"][d].T
        return g


def train(windows: list[np.ndarray], labels: np.ndarray, kinds: int, steps: int = 900, batch: int = 192, rate: float = 0.01, seed: int = 7) -> ByteGru:
    """Adam over batches of windows of one length; lengths are drawn by their bytes."""
    net, r = ByteGru(kinds, seed), np.random.default_rng(seed)
    sizes = np.array([len(w) for w in windows])
    by = {n: np.flatnonzero(sizes == n) for n in np.unique(sizes)}
    stacked = {n: np.stack([windows[i] for i in rows]) for n, rows in by.items()}
    lengths = np.array(sorted(by))
    chance = np.array([n * len(by[n]) for n in lengths], float)
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v = {k: np.zeros_like(x) for k, x in net.p.items()}
    for step in range(1, steps + 1):
        n = r.choice(lengths, p=chance / chance.sum())
        pick = r.integers(0, len(by[n]), batch)
        g = net.gradients(stacked[n][pick], labels[by[n][pick]])
        now = rate * min(1, 2 * (1 - step / (steps + 1)))
        for k, x in g.items():
            m[k] = 0.9 * m[k] + 0.1 * x
            v[k] = 0.99 * v[k] + 0.01 * x * x
            net.p[k] -= (now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def evenly(labels: np.ndarray, most: int, seed: int = 7) -> np.ndarray:
    """Positions of at most ``most`` entries, drawn at random and as evenly over the labels as these have entries."""
    drawn = np.random.default_rng(seed).permutation(len(labels))
    by = np.argsort(labels[drawn], kind="stable")
    sizes = np.bincount(labels)
    turn = np.empty(len(labels), np.int64)
    turn[by] = np.arange(len(labels)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return np.sort(drawn[np.argsort(turn, kind="stable")[:most]])


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 150, longest: int = 20_000, most_languages: int = 256, most_windows: int = 200_000, **params) -> tuple[ByteGru | None, list[str]]:
    """The network and its languages, from the rows that are not held out."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    known = rows.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & (F.length("text") >= 1))
    per = max(1, int(per_language * min(1.0, most_languages / max(1, known.select("lang").distinct().count()))))
    chosen = staged(sampled(known.select("doc_id", "lang"), "lang", per, "language").select("doc_id").distinct())
    if chosen.isEmpty():
        return None, []
    size, length = max(1, longest // PIECES), F.length("text")
    pieces = [F.col("text").substr(F.floor((length - size) * i / (PIECES - 1)).cast("int") + 1, F.lit(size)) for i in range(PIECES)]
    known = known.withColumn("text", F.when(length <= longest, F.col("text")).otherwise(F.concat_ws(" ", *pieces)))
    sample = known.join(F.broadcast(chosen), "doc_id", "left_semi").toArrow().sort_by([("lang", "ascending"), ("doc_id", "ascending"), ("text", "ascending")])
    langs = sorted(set(sample.column("lang").to_pylist()))
    where = {x: i for i, x in enumerate(langs)}
    y = np.array([where[x] for x in sample.column("lang").to_pylist()])
    data, bounds = utf8(sample.column("text").combine_chunks())
    data = lower_ascii(data)
    a, b, first = letter_windows(data, bounds)
    if not len(a):
        return None, []
    owner = np.repeat(np.arange(len(y)), np.diff(first))
    pick = evenly(y[owner], most_windows)
    windows = [data[a[i] : b[i]] for i in pick]
    return train(windows, y[owner[pick]], len(langs), **params), langs


def predict(docs: DataFrame, net: ByteGru | None, langs: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score of every row."""
    model = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = SpanCache(len(langs) + 1)
        for batch in batches:
            for part in slices(batch, "text"):
                data, bounds = utf8(part.column("text"))
                data = lower_ascii(data)
                a, b, first = letter_windows(data, bounds)
                pred, score = np.zeros(part.num_rows, int), np.zeros(part.num_rows)
                lettered = _has_letter(part.column("text"), data, a, first)
                if len(a) and langs:

                    def fresh(which: np.ndarray, a=a, b=b, data=data) -> np.ndarray:
                        out = np.empty((len(which), len(langs) + 1))
                        size = (b - a)[which]
                        for n in np.unique(size):
                            rows = np.flatnonzero(size == n)
                            for some in np.array_split(rows, -(-len(rows) // 4096)):
                                p = model.value.label(data[a[which[some]][:, None] + np.arange(n)])
                                out[some, :-1], out[some, -1] = p.sum(0), n
                        return out

                    values, back = cache.get(span_hashes(data, a, b), fresh)
                    sums = per_text(values[back], first)
                    share = sums[:, :-1] / np.maximum(sums[:, -1:], 1)
                    pred, score = share.argmax(1), np.clip(share.max(1), 0, 1)
                lettered &= bool(langs)
                names = np.array([*langs, "und"], object)[np.where(lettered, pred, len(langs))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(names, pa.string()), pa.array(np.where(lettered, score, 0.0))], ["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")


def _has_letter(text: pa.Array, data: np.ndarray, a: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether each text has a letter; only texts without an ASCII letter need a look at their characters."""
    ascii_letter = _LETTER & (np.arange(256) < 128)
    counts = np.concatenate([[0], np.cumsum(ascii_letter[data])])
    some = first[1:] > first[:-1]
    out = np.zeros(len(text), bool)
    for i in np.flatnonzero(some):
        lo, hi = a[first[i]], a[first[i + 1] - 1] + 1
        out[i] = counts[hi] > counts[lo] or any(c.isalpha() for c in text[i].as_py())
    return out


def languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **params) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row, by a network fitted on rows that are not held out."""
    net, langs = fit(docs, id_col, text_col, lang_col, **params)
    out = predict(docs, net, langs, id_col, text_col)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, least: float = 0.35, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **params) -> DataFrame:
    """``docs`` without the documents whose language is ``und`` or has a pooled probability under ``least``.

    A row is judged by its own text, also where rows repeat a doc_id.
    """
    net, langs = fit(docs, id_col, text_col, lang_col, **params)
    key = spare_name(docs, "row_hash")
    marked = docs.withColumn(key, F.xxhash64(id_col, text_col))
    found = predict(marked, net, langs, key, text_col)
    good = staged(found.filter((F.col("lang_pred") != "und") & (F.col("score") >= least)).select(F.col("doc_id").alias(key)).distinct())
    return marked.join(good.hint("merge"), key, "left_semi").select(*docs.columns)
