"""Learning from labels of many annotators: classifiers on aggregated or raw labels, mixing of pairs, clusters, inference hooks.

Full-batch gradients are sums over partitions.  The driver holds only the parameters that all annotators share; those of the
annotators are tables, which meet the labels by a join and move by grouped sums.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywise.operators.aggregate import confusions, dense, majority_vote, pair_accuracy_model, pair_label_model, soft_votes
from tallywise.operators.dawid_skene import class_model, dawid_skene
from tallywise.operators.scorers import beta_quantile
from tallywise.sources.staging import release, staged
from tallywise.tables import small, uniform

#: Named settings of the estimators.
PRESETS = {
    "majority_voting": {"aggregate": "majority"},
    "dawid_skene_voting": {"aggregate": "dawid_skene", "max_iter": 100, "tol": 1e-6, "smoothing": 0.01},
    "crowd_em": {"max_iter": 10, "tol": 1e-4},
    "trace_reg": {"regularization": "trace-reg", "lmbda": 0.01},
    "geo_reg_f": {"regularization": "geo-reg-f", "lmbda": 0.001},
    "geo_reg_w": {"regularization": "geo-reg-w", "lmbda": 0.001},
}


def aggregate_classifier(annotations: DataFrame, features: DataFrame, n_classes: int, aggregate: str = "majority", smoothing: float = 0.01, max_iter: int = 100, tol: float = 1e-6) -> dict[str, DataFrame]:
    """Targets by majority, soft votes or Dawid-Skene, a classifier on them, and the annotators' confusions against it.

    Gives ``posteriors`` (item_id, class, p), ``confusions``, ``performance`` and ``labels`` of every pair.
    """
    if aggregate == "majority":
        targets = majority_vote(annotations).select("item_id", F.col("label").alias("class"), F.lit(1.0).alias("p"))
    elif aggregate == "soft":
        targets = soft_votes(annotations)
    elif aggregate == "dawid_skene":
        targets = dawid_skene(annotations, n_classes, max_iter, tol, smoothing)[0]
    else:
        raise ValueError(f"aggregate: {aggregate}")
    post = staged(class_model(features, targets, n_classes))
    conf = staged(confusions(annotations, dense(targets, n_classes), n_classes, smoothing))
    return {"posteriors": post, "confusions": conf, "performance": pair_accuracy_model(post, conf), "labels": pair_label_model(post, conf)}


def _softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


#: Annotators whose gradients a task holds before it passes them on, and those whose parameters are also given as arrays.
HELD, LISTED = 4096, 10_000


class _Network:
    """The shared class model: linear, or with a hidden layer of rectified units; its parameters are one vector on the driver."""

    def __init__(self, d: int, k: int, hidden: int | None, rng: np.random.Generator) -> None:
        self.shapes = [(d + 1, k)] if not hidden else [(d + 1, hidden), (hidden + 1, k)]
        scales = [0.01] if not hidden else [np.sqrt(2 / (d + 1)), 0.01]
        self.start = np.concatenate([rng.normal(0, s, shape).ravel() for s, shape in zip(scales, self.shapes, strict=True)])

    def layers(self, theta: np.ndarray) -> list[np.ndarray]:
        ends = np.cumsum([a * b for a, b in self.shapes])
        return [theta[e - a * b : e].reshape(a, b) for e, (a, b) in zip(ends, self.shapes, strict=True)]

    def forward(self, x: np.ndarray, theta: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Class probabilities, and the inputs of the layers, each with a column of ones."""
        inputs, now = [], x
        for i, w in enumerate(self.layers(theta)):
            inputs.append(np.column_stack([now if not i else np.maximum(now, 0), np.ones(len(x))]))
            now = inputs[-1] @ w
        return _softmax(now), inputs

    def backward(self, inputs: list[np.ndarray], theta: np.ndarray, by_score: np.ndarray) -> np.ndarray:
        """The gradient of the parameters from that of the scores before the softmax."""
        layers, out = self.layers(theta), []
        for w, x in zip(reversed(layers), reversed(inputs), strict=True):
            out.append((x.T @ by_score).ravel())
            by_score = (by_score @ w.T)[:, :-1] * (x[:, :-1] > 0)
        return np.concatenate(out[::-1])


def _gradients(rows: DataFrame, params: DataFrame, grad: Callable[[pd.DataFrame, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], size: int) -> tuple[np.ndarray, DataFrame]:
    """Sum of the shared gradient, and (annotator_id, g) summed for each annotator.

    ``params`` (annotator_id, t) meet the labels by a join; ``grad`` gets a batch, the matrix of its annotators' parameters and their places in it.
    Tasks add up before they shuffle, and pass on the annotators they hold when these are many.
    """
    met = rows.join(small(params, 100_000), "annotator_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shared, own = None, {}
        give = lambda: pd.DataFrame({"annotator_id": list(own), "g": list(own.values())})
        for part in batches:
            if not len(part):
                continue
            names, first, at = np.unique(part["annotator_id"].to_numpy(), return_index=True, return_inverse=True)
            g, each = grad(part, np.stack(part["t"].to_numpy()[first]), at)
            shared = g if shared is None else shared + g
            for name, v in zip(names.tolist(), each, strict=True):
                own[name] = own[name] + v if name in own else v
            if len(own) > HELD:
                yield give()
                own.clear()
        if own:
            yield give()
        if shared is not None:
            yield pd.DataFrame({"annotator_id": pd.array([None], dtype="Int64"), "g": [shared]})

    cells = staged(met.mapInPandas(run, "annotator_id long, g array<double>").select("annotator_id", F.posexplode("g").alias("i", "g")).groupBy("annotator_id", "i").agg(F.sum("g").alias("g")))
    total = np.zeros(size)
    for r in cells.filter("annotator_id IS NULL").collect():  # as many as shared parameters
        total[r["i"]] = r["g"]
    own = cells.filter("annotator_id IS NOT NULL").groupBy("annotator_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "g"))), lambda e: e["g"]).alias("g"))
    return total, own


def _stepped(params: DataFrame, own: DataFrame, step: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """``params`` after ``step`` (matrix of parameters, matrix of gradients); annotators without a gradient have zeros."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            if len(part):
                t = np.stack(part["t"].to_numpy())
                g = np.stack([np.zeros(t.shape[1]) if v is None else np.asarray(v) for v in part["g"]])
                yield pd.DataFrame({"annotator_id": part["annotator_id"], "t": list(step(t, g))})

    return staged(params.join(own.hint("merge"), "annotator_id", "left").mapInPandas(run, "annotator_id long, t array<double>"))


def _matrix_sum(params: DataFrame, f: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """The sum of ``f`` (a vector for a matrix of parameters) over all annotators."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size)
        for part in batches:
            if len(part):
                total += f(np.stack(part["t"].to_numpy()))
        yield pd.DataFrame({"i": np.arange(size), "v": total})

    out = np.zeros(size)
    for r in params.mapInPandas(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
        out[r["i"]] = r["v"]
    return out


def _labelled(annotations: DataFrame, features: DataFrame) -> tuple[DataFrame, DataFrame, int, int]:
    """(annotator_id, label, x), the annotators (annotator_id), the length of x and the number of annotators."""
    d = features.agg(F.max(F.size("x"))).first()[0] or 0
    names = staged(annotations.select(F.col("annotator_id").cast("long").alias("annotator_id")).distinct())
    rows = annotations.join(features.hint("merge"), "item_id").select(F.col("annotator_id").cast("long").alias("annotator_id"), "label", F.col("x").cast("array<double>").alias("x"))
    return staged(rows), names, d, names.count()


def crowd_layer(annotations: DataFrame, features: DataFrame, n_classes: int, regularization: str = "trace-reg", lmbda: float = 0.01, steps: int = 20, rate: float = 0.5, seed: int = 0, hidden: int | None = None) -> dict:
    """A class model, linear or with ``hidden`` units, under a confusion layer per annotator, by the likelihood of the labels.

    The regulariser is the mean trace of the confusions (``trace-reg``), or -logdet of F'F (class probabilities) or W'W
    (confusions); a value that isn't finite or exceeds 100 is left out.  The annotators' parameters are a table.  Gives ``weights`` (one
    matrix a layer, or the matrix), ``confusion_table`` (annotator_id, truth, label, p), the ``loss`` of each step and, for at most
    LISTED annotators, ``confusions`` (array by annotator) and ``annotators``.
    """
    if regularization not in ("trace-reg", "geo-reg-f", "geo-reg-w"):
        raise ValueError(f"regularization: {regularization}")
    rows, names, d, a = _labelled(annotations, features)
    k, net = n_classes, _Network(d, n_classes, hidden, np.random.default_rng(seed))
    theta, cut = net.start, len(net.start)
    params = staged(names.withColumn("t", F.array(*[F.lit(float(v)) for v in (np.eye(k) * 3).ravel()])))

    def grad(theta: np.ndarray, toward: np.ndarray):
        def run(part: pd.DataFrame, t: np.ndarray, ai: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            c = _softmax(t.reshape(-1, k, k))
            f, inputs = net.forward(np.stack(part["x"].to_numpy()), theta)
            y = part["label"].to_numpy()
            picked = c[ai, :, y]
            p = np.maximum((f * picked).sum(1), 1e-12)
            r = f * picked / p[:, None]  # P(class | label)
            by_f = f @ toward  # of the regulariser
            gw = net.backward(inputs, theta, f - r + f * (by_f - (by_f * f).sum(1, keepdims=True)))
            gc = np.zeros_like(c)
            np.add.at(gc, ai, r[:, :, None] * c[ai])
            np.add.at(gc, (ai, slice(None), y), -r)
            return np.concatenate([gw, (f.T @ f).ravel(), [-np.log(p).sum(), len(part)]]), gc.reshape(len(c), -1)

        return run

    losses = []
    for _ in range(steps):
        g, own = _gradients(rows, params, grad(theta, np.zeros((k, k))), cut + k * k + 2)
        n = g[-1]
        if not n:
            break
        reg, by_c = 0.0, None
        if regularization == "trace-reg":
            reg = _matrix_sum(params, lambda t: np.array([np.trace(_softmax(t.reshape(-1, k, k)), axis1=1, axis2=2).sum()]), 1)[0] / a
            by_c = lambda c: np.eye(k)[None] / a * np.ones_like(c)
        elif regularization == "geo-reg-w":
            gram = _matrix_sum(params, lambda t: np.einsum("aij,akj->ik", *[_softmax(t.reshape(-1, k, k))] * 2).ravel(), k * k).reshape(k, k)
            reg, back = -np.linalg.slogdet(gram)[1], -2 * np.linalg.pinv(gram)
            by_c = lambda c, back=back: back[None] @ c
        else:
            gram = g[cut : cut + k * k].reshape(k, k) / n + 1e-9 * np.eye(k)
            reg = -np.linalg.slogdet(gram)[1]
        usable = np.isfinite(reg) and abs(reg) <= 100
        losses.append(g[-2] / n + (lmbda * reg if usable else 0.0))
        if regularization == "geo-reg-f" and usable:
            # a second pass, with the direction that the first one's sums give; a ridge keeps it bounded while all items look alike
            g, own = _gradients(rows, params, grad(theta, -2 * lmbda * np.linalg.inv(gram + 0.01 * np.eye(k))), cut + k * k + 2)

        def step(t: np.ndarray, own_g: np.ndarray, n=n, by_c=by_c if usable else None) -> np.ndarray:
            down = own_g / n
            if by_c is not None:
                c = _softmax(t.reshape(-1, k, k))
                rg = by_c(c)
                down = down + lmbda * (c * (rg - (rg * c).sum(2, keepdims=True))).reshape(len(t), -1)
            return t - rate * a * down

        before, params = params, _stepped(params, own, step)
        release(before)
        theta = theta - rate * g[:cut] / n
    table = params.select("annotator_id", F.posexplode("t").alias("i", "s"))
    table = table.select("annotator_id", F.expr(f"i div {k}").cast("int").alias("truth"), F.pmod("i", F.lit(k)).cast("int").alias("label"), F.exp("s").alias("e"))
    table = table.select("annotator_id", "truth", "label", (F.col("e") / F.sum("e").over(Window.partitionBy("annotator_id", "truth"))).alias("p"))
    layers = net.layers(theta)
    found = {"weights": layers if hidden else layers[0], "confusion_table": table, "loss": losses, "network": net, "theta": theta}
    if a <= LISTED:
        listed = params.orderBy("annotator_id").collect()
        found |= {"annotators": [r["annotator_id"] for r in listed], "confusions": _softmax(np.array([r["t"] for r in listed]).reshape(-1, k, k))}
    return found


def low_rank_expertise(annotations: DataFrame, features: DataFrame, n_classes: int, dim: int = 4, annotator_bias: bool = False, steps: int = 20, rate: float = 0.5, seed: int = 0, hidden: int | None = None) -> dict:
    """Item projection times annotator vector as P(correct), trained by summing out the true class.

    The class model is linear or has ``hidden`` units; the annotators' vectors are a table.  Gives ``class_weights``, ``projection``,
    ``annotator_vectors`` (annotator_id, v, bias) and the ``loss`` of each step.
    """
    rows, names, d, a = _labelled(annotations, features)
    rng = np.random.default_rng(seed)
    k, net = n_classes, _Network(d, n_classes, hidden, rng)
    cut = len(net.start)
    theta = np.concatenate([net.start, rng.normal(0, 1 / np.sqrt(max(d, 1)), d * dim)])
    # a vector's start depends on the annotator alone
    normal = [F.sqrt(-2 * F.ln(uniform(seed, F.lit(f"r{i}"), "annotator_id"))) * F.cos(2 * np.pi * uniform(seed, F.lit(f"a{i}"), "annotator_id")) * 0.1 for i in range(dim)]
    params = staged(names.withColumn("t", F.array(*normal, F.lit(1.0))))

    def grad(theta: np.ndarray):
        def run(part: pd.DataFrame, t: np.ndarray, ai: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            v, b, m = t[:, :dim], t[:, dim], theta[cut:].reshape(d, dim)
            x, y = np.stack(part["x"].to_numpy()), part["label"].to_numpy()
            f, inputs = net.forward(x, theta[:cut])
            proj = x @ m
            th = 1 / (1 + np.exp(-((proj * v[ai]).sum(1) + b[ai])))
            like = np.repeat(((1 - th) / max(k - 1, 1))[:, None], k, 1)
            like[np.arange(len(y)), y] = th
            p = np.maximum((f * like).sum(1), 1e-12)
            r = f * like / p[:, None]
            dz = th - r[np.arange(len(y)), y]  # of -log p by the logit
            own = np.zeros_like(t)
            np.add.at(own, ai, np.column_stack([dz[:, None] * proj, dz]))
            return np.concatenate([net.backward(inputs, theta[:cut], f - r), (x.T @ (dz[:, None] * v[ai])).ravel(), [-np.log(p).sum(), len(part)]]), own

        return run

    losses = []
    for _ in range(steps):
        g, own = _gradients(rows, params, grad(theta), len(theta) + 2)
        n = g[-1]
        if not n:
            break
        losses.append(g[-2] / n)
        scale = np.append(np.full(dim, float(a)), float(a) if annotator_bias else 0.0)
        before, params = params, _stepped(params, own, lambda t, own_g, n=n, scale=scale: t - rate * scale * own_g / n)
        release(before)
        theta = theta - rate * g[: len(theta)] / n
    layers = net.layers(theta[:cut])
    vectors = params.select("annotator_id", F.slice("t", 1, dim).alias("v"), F.col("t")[dim].alias("bias"))
    return {"class_weights": layers if hidden else layers[0], "projection": theta[cut:].reshape(d, dim), "annotator_vectors": vectors, "loss": losses}


def mixed_pairs(pairs: DataFrame, seed: int = 0, alpha: float = 1.0) -> DataFrame:
    """Each pair (item_id, annotator_id, x, a, y arrays) mixed with a random other: lam * own + (1 - lam) * other.

    The partner comes from a second order of the same rows, by rank within 64 hash buckets (more beyond 6.4 million rows), so that neither order is sorted in one
    task.  lam is Beta(alpha, alpha), which is uniform at alpha 1.
    """
    bucket = F.pmod(F.xxhash64("item_id", "annotator_id"), F.lit(max(64, pairs.count() // 100_000)))
    order = lambda s: Window.partitionBy("b").orderBy(uniform(seed, F.lit(s), "item_id", "annotator_id"), "item_id", "annotator_id")
    rows = pairs.withColumn("b", bucket)
    left = rows.withColumn("r", F.row_number().over(order("own")))
    right = rows.select("b", F.row_number().over(order("other")).alias("r"), F.col("x").alias("x2"), F.col("a").alias("a2"), F.col("y").alias("y2"))
    u = uniform(seed, F.lit("lam"), "item_id", "annotator_id")
    lam = u if alpha == 1.0 else beta_quantile(F.lit(float(alpha)), F.lit(float(alpha)), u)
    both = left.join(right, ["b", "r"]).withColumn("lam", lam)
    blend = lambda p, q: F.transform(F.arrays_zip(F.col(p).alias("v"), F.col(q).alias("w"), F.array_repeat("lam", F.size(p)).alias("l")), lambda e: e["l"] * e["v"] + (1 - e["l"]) * e["w"])
    return both.select("item_id", "annotator_id", "lam", blend("x", "x2").alias("x"), blend("a", "a2").alias("a"), blend("y", "y2").alias("y"))


#: Clusters up to which Spark's KMeans finds them; it chooses its first centres on the driver, where their number squared is too much beyond.
FEW_CLUSTERS = 2048


def clusters(features: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """(item_id, cluster) by k-means."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    from tallywise.operators import lloyd

    if k > FEW_CLUSTERS:
        return lloyd.clusters(features, k, seed)
    x = features.select("item_id", array_to_vector(F.col("x").cast("array<double>")).alias("features"))
    return KMeans(k=k, seed=seed, initMode="k-means||").fit(x).transform(x).select("item_id", F.col("prediction").alias("cluster"))


def batch_inference(rows: DataFrame, model: Callable[[pd.DataFrame], dict[str, list]], outputs: dict[str, str]) -> DataFrame:
    """Chosen outputs of a user's model for every row; ``outputs`` maps their names to types, and the model gets batches."""
    schema = ", ".join(["item_id long", *[f"{n} {t}" for n, t in outputs.items()]])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            found = model(part)
            yield pd.DataFrame({"item_id": part["item_id"], **{n: list(found[n]) for n in outputs}})

    return rows.mapInPandas(run, schema)


def text_features(rows: DataFrame, dim: int = 256, encoder: Callable[[list[str]], np.ndarray] | None = None, batch: int = 64) -> DataFrame:
    """(item_id, x) of (item_id, text): hashed term frequencies times inverse document frequency, or a user's encoder in batches.

    A null text has a zero vector (an empty text for the encoder); vectors of different lengths are an error.
    """
    if encoder is None:
        from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
        from pyspark.ml.functions import vector_to_array

        words = RegexTokenizer(inputCol="text", outputCol="w", pattern=r"\W+").transform(rows.withColumn("text", F.coalesce("text", F.lit(""))))
        tf = HashingTF(inputCol="w", outputCol="tf", numFeatures=dim).transform(words)
        return IDF(inputCol="tf", outputCol="v").fit(tf).transform(tf).select("item_id", vector_to_array("v").alias("x"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size = None
        for part in batches:
            for at in range(0, len(part), batch):
                some = part.iloc[at : at + batch]
                x = np.asarray(encoder(some["text"].fillna("").tolist()), float)
                size = size or x.shape[1]
                if x.shape[1] != size:
                    raise ValueError(f"vectors of {size} and {x.shape[1]} entries")
                yield pd.DataFrame({"item_id": some["item_id"], "x": list(x)})

    return rows.select("item_id", "text").mapInPandas(run, "item_id long, x array<double>")
