"""Utilities of candidate pairs (item_id, annotator_id): functions of tables that give (item_id, annotator_id, u).

Pairs that cannot be scored are absent.  Class probabilities come as posteriors (item_id, p array), confusions as (annotator_id, truth,
label, p).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywise.functions.arrays import TINY, as_doubles, channel_rows, dot, expected_gain, l2_normalised, normalised, total, uniform_channel
from tallywise.operators import kernel
from tallywise.sources.staging import staged
from tallywise.tables import small, uniform

#: Named settings.
PRESETS = {
    "random": {},
    "performance": {},
    "ig_gain": {"variant": "uniform", "class_prior": "uniform"},
    "beta": {"mean": 0.9, "strength": 10.0},
    "semantic_diversity": {},
    "representation_diversity": {},
    "kernel_evidence_ig": {"variant": "channel"},
    "ks_big_channel": {"variant": "channel"},
    "ks_big_full_confusion": {"variant": "full"},
    "ks_big_uniform": {"variant": "uniform"},
}
_PAIR = ("item_id", "annotator_id")


def random_scores(candidates: DataFrame, low: float = 0.0, high: float = 1.0, seed: int = 0, drawn: Column | None = None) -> DataFrame:
    u = uniform(seed, *_PAIR) if drawn is None else drawn
    return candidates.select(*_PAIR, (low + (high - low) * u).alias("u"))


def performance(candidates: DataFrame, correctness: DataFrame) -> DataFrame:
    """P(correct) of each candidate, from (item_id, annotator_id, p_correct)."""
    return candidates.join(correctness, list(_PAIR)).select(*_PAIR, F.col("p_correct").alias("u"))


def confusion_arrays(confusions: DataFrame) -> DataFrame:
    """(annotator_id, rows): K x K arrays."""
    rows = confusions.groupBy("annotator_id", "truth").agg(F.transform(F.array_sort(F.collect_list(F.struct("label", "p"))), lambda e: e["p"]).alias("row"))
    return rows.groupBy("annotator_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("truth", "row"))), lambda e: e["row"]).alias("rows"))


def information_gain(candidates: DataFrame, posteriors: DataFrame, channel: DataFrame, variant: str = "full", class_prior: str = "classifier", score: str = "entropy", log_base: float = 2.0) -> DataFrame:
    """Expected gain about the class from one label.

    ``channel`` has per annotator: ``rows`` (K x K) for ``full``; ``theta`` and ``g`` arrays for ``channel``; a number ``theta`` for ``uniform``.
    """
    rows = candidates.join(posteriors, "item_id").join(channel, "annotator_id")
    p = as_doubles(F.col("p")) if class_prior == "classifier" else F.transform("p", lambda v: 1.0 / F.size("p"))
    if variant == "full":
        c = F.col("rows")
    elif variant == "channel":
        c = channel_rows(F.col("theta"), F.col("g"))
    elif variant == "uniform":
        c = uniform_channel(F.array_repeat("theta", F.size("p")))
    else:
        raise ValueError(f"variant: {variant}")
    staged = rows.select(*_PAIR, p.alias("p"), c.alias("c"))
    return staged.select(*_PAIR, expected_gain(F.col("p"), F.col("c"), score, log_base).alias("u"))


def semantic_diversity(candidates: DataFrame, features: DataFrame, acquired: DataFrame, cold_start: float = 2.0) -> DataFrame:
    """Mean cosine distance of the item to the annotator's labelled items.

    The mean of 1 - x.h over unit vectors is 1 - x.mean(h), so the history of an annotator is one vector.
    """
    unit = kernel.unit_vectors(features)
    mean = _mean_vectors(acquired.join(unit, "item_id").select("annotator_id", "x"))
    rows = candidates.join(unit, "item_id").join(mean, "annotator_id", "left")
    return rows.select(*_PAIR, F.coalesce(1 - dot(F.col("x"), F.col("m")), F.lit(cold_start)).alias("u"))


def _mean_vectors(rows: DataFrame) -> DataFrame:
    """(annotator_id, m): the mean vector of each annotator."""
    dims = rows.select("annotator_id", F.posexplode("x").alias("d", "v")).groupBy("annotator_id", "d").agg(F.avg(F.col("v").cast("double")).alias("v"))
    return dims.groupBy("annotator_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "v"))), lambda e: e["v"]).alias("m"))


#: Pairs whose annotators' vectors a task sums by item.
PAIRS_AT_ONCE = 50_000


def representation_diversity(candidates: DataFrame, features: DataFrame, acquired: DataFrame, n_classes: int, label_weight: float = 1.0, cold_start: float = 2.0) -> DataFrame:
    """Mean cosine distance of an annotator to the others that are available for the item.

    An annotator's vector is the unit mean of unit vectors of features and weighted one-hot labels.  Without a vector the score is
    ``cold_start``, without a peer 0.  The peers' vectors of an item are summed once, so that each pair costs one product.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    from tallywise.functions.arrays import one_hot

    unit = kernel.unit_vectors(features)
    both = F.concat("x", F.transform(one_hot(F.col("label"), n_classes), lambda v: v * label_weight))
    joint = acquired.join(unit, "item_id").select("annotator_id", l2_normalised(both).alias("x"))
    vectors = staged(_mean_vectors(joint).select("annotator_id", l2_normalised(F.col("m")).alias("v")))
    # pairs are dealt by item before they get their vectors, so that a task has PAIRS_AT_ONCE of them or so
    pairs = candidates.select(*_PAIR)
    parts = max(pairs.sparkSession.sparkContext.defaultParallelism, -(-pairs.count() // PAIRS_AT_ONCE))
    rows = pairs.repartition(parts, "item_id").join(small(vectors), "annotator_id", "left")
    of_item = rows.filter("v IS NOT NULL").groupBy("item_id").agg(Summarizer.sum(array_to_vector("v")).alias("s"), F.count(F.lit(1)).alias("n"))
    full = rows.join(of_item.select("item_id", vector_to_array("s").alias("s"), "n").hint("merge"), "item_id", "left")
    others = F.col("n") - 1
    mean = (others - (dot(F.col("v"), F.col("s")) - dot(F.col("v"), F.col("v")))) / others
    return full.select(*_PAIR, F.when(F.col("v").isNull(), cold_start).when(others < 1, 0.0).otherwise(mean).alias("u"))


def beta_model(candidates: DataFrame, features: DataFrame, evidence: DataFrame, mean: float = 0.95, strength: float = 10.0, gamma: str | float = "median", use_ess: bool = True, tau: float = 1.0, similarity: DataFrame | None = None, draw: bool = False, seed: int = 0) -> DataFrame:
    """Posterior mean, or a Thompson draw, of P(correct) from kernel evidence (item_id, annotator_id, score) near the item.

    Each annotator has a bandwidth of its own.  Without evidence the prior decides.  ``similarity`` pools similar annotators.
    """
    points = evidence.select(*_PAIR).join(features.hint("merge"), "item_id")
    widths = kernel.bandwidth(points, gamma, by="annotator_id", lone=1e6)
    items = features.join(candidates.select("item_id").distinct().hint("merge"), "item_id", "left_semi")
    seen = features.join(evidence.select("item_id").distinct().hint("merge"), "item_id", "left_semi")
    sums = kernel.kernel_sums(items, seen, evidence, widths, similarity=similarity, pairs=candidates)
    post = kernel.beta_posterior(sums, mean * strength, (1 - mean) * strength, use_ess, tau)
    rows = candidates.select(*_PAIR).join(post.hint("merge"), list(_PAIR), "left").select(*_PAIR, F.coalesce("alpha", F.lit(mean * strength)).alias("alpha"), F.coalesce("beta", F.lit((1 - mean) * strength)).alias("beta"))
    u = beta_quantile(F.col("alpha"), F.col("beta"), uniform(seed, F.lit("theta"), *_PAIR)) if draw else F.col("alpha") / (F.col("alpha") + F.col("beta"))
    return rows.select(*_PAIR, u.alias("u"))


def kernel_evidence_gain(candidates: DataFrame, features: DataFrame, acquired: DataFrame, posteriors: DataFrame, channel: DataFrame, variant: str = "uniform", gamma: str | float = "median", accuracy_mean: float = 0.95, accuracy_strength: float = 10.0, class_strength: float = 1.0, label_strength: float = 1.0, use_ess: bool = False, tau: float = 1.0, score: str = "entropy", draws: int = 0, draw_classes: bool = False, draw_labels: bool = False, seed: int = 0) -> DataFrame:
    """Information gain with the model's means, and the kernel mass of nearby labels as confidence in them.

    ``channel`` has per annotator ``theta`` (P(correct)) for ``uniform`` and also ``g`` (label distribution) for ``channel``, or ``rows`` for ``full``.
    With ``draws`` the gain is the mean over so many draws of P(correct), or of the rows, from their posteriors; by choice also of
    the class probabilities and of the label distribution.
    """
    unit = kernel.unit_vectors(features)
    seen = unit.join(acquired.select("item_id").distinct().hint("merge"), "item_id", "left_semi")
    items = unit.join(candidates.select("item_id").distinct().hint("merge"), "item_id", "left_semi")
    width = kernel.bandwidth(seen, gamma)
    ones = seen.select("item_id", F.lit(0).alias("everybody"), F.lit(1.0).alias("mass"), F.lit(1.0).alias("m2"))
    of_all = items.select("item_id", F.lit(0).alias("everybody"))
    by_item = kernel.kernel_totals(items, seen, ones, width, ["everybody"], ["mass"], ["m2"] if use_ess else [], pairs=of_all).select("item_id", kernel.concentration(use_ess, tau).alias("item_conc"))
    sums = kernel.kernel_sums(items, seen, acquired.select(*_PAIR, F.lit(1.0).alias("score")), width, pairs=candidates).select(*_PAIR, kernel.concentration(use_ess, tau).alias("pair_conc"))
    rows = candidates.select(*_PAIR).join(posteriors.hint("merge"), "item_id").join(channel.hint("merge"), "annotator_id").join(by_item.hint("merge"), "item_id", "left").join(sums.hint("merge"), list(_PAIR), "left")
    rows = rows.withColumn("item_conc", F.coalesce("item_conc", F.lit(0.0))).withColumn("conc", F.coalesce("pair_conc", F.lit(0.0)))
    k = F.size("p")
    rows = _repeated(rows.withColumn("p", F.transform("p", lambda v: class_strength / k + F.col("item_conc") * v)), draws)
    rows = rows.withColumn("p", dirichlet_draw(F.col("p"), _uniforms(seed, "class", k - 1)) if draws and draw_classes else normalised(F.col("p")))
    if variant in ("uniform", "channel"):
        known = F.least(F.greatest("theta", F.lit(TINY)), F.lit(1 - TINY))
        alpha, beta = accuracy_mean * accuracy_strength + F.col("conc") * known, (1 - accuracy_mean) * accuracy_strength + F.col("conc") * (1 - known)
        rows = rows.withColumn("th", beta_quantile(alpha, beta, uniform(seed, F.lit("theta"), *_PAIR, F.col("t"))) if draws else alpha / (alpha + beta))
        theta = F.array_repeat("th", k)
        if variant == "uniform":
            c = uniform_channel(theta)
        else:
            g = F.transform("g", lambda v: label_strength / k + F.col("conc") * v)
            rows = rows.withColumn("label_p", dirichlet_draw(g, _uniforms(seed, "label", k - 1)) if draws and draw_labels else g)
            c = channel_rows(theta, F.col("label_p"))
    elif variant == "full":
        off = accuracy_strength * (1 - accuracy_mean)
        counts = F.transform("rows", lambda row, i: F.transform(row, lambda v, j: F.when(i == j, accuracy_strength * accuracy_mean).otherwise(off / F.greatest(k - 1, F.lit(1))) + F.col("conc") * v))
        rows = rows.withColumn("c", F.transform(counts, lambda row: normalised(row))) if not draws else _drawn_rows(rows, counts, seed, k * (k - 1), "c")
        c = F.col("c")
    else:
        raise ValueError(f"variant: {variant}")
    p = F.col("p")
    return _mean_gain(rows.select(*_PAIR, p.alias("p"), c.alias("c")), score, draws)


def _repeated(rows: DataFrame, draws: int) -> DataFrame:
    """Each row ``draws`` times, numbered by ``t``."""
    return rows.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(max(draws, 1) - 1))))


def _uniforms(seed: int, tag: str, n: Column) -> Column:
    """n uniform numbers that depend on the pair, its draw ``t`` and the tag alone."""
    return F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: uniform(seed, F.lit(tag), *_PAIR, F.col("t"), i))


def _drawn_rows(rows: DataFrame, counts: Column, seed: int, n: Column, name: str) -> DataFrame:
    """Pair, t, p, and under ``name`` rows drawn from the counts; these are written first, as Python cannot take their lambdas."""
    made = staged(rows.select(*_PAIR, "t", "p", counts.alias("counts"), _uniforms(seed, "rows", n).alias("us")))
    return made.select(*_PAIR, "t", "p", dirichlet_rows_draw(F.col("counts"), F.col("us")).alias(name))


def _mean_gain(rows: DataFrame, score: str, draws: int) -> DataFrame:
    if draws:
        # written, since Spark would move the Python draws into lambdas, where they cannot run
        rows = staged(rows)
    gains = rows.select(*_PAIR, expected_gain(F.col("p"), F.col("c"), score).alias("u"))
    return gains.groupBy(*_PAIR).agg(F.avg("u").alias("u")) if draws > 1 else gains


def kernel_smoothed_gain(candidates: DataFrame, features: DataFrame, acquired: DataFrame, posteriors: DataFrame, n_classes: int, variant: str = "channel", gamma: str | float = "median", gamma_scope: str = "global", accuracy_mean: str | float = "global_observed", accuracy_strength: float = 10.0, label_strength: float = 1.0, mix: float = 0.0, use_ess: bool = False, tau: float = 1.0, class_prior: str = "classifier", similarity: DataFrame | None = None, top_m: int | None = None, ucb: float | None = None, score: str = "entropy", draws: int = 0, draw_labels: bool = False, seed: int = 0) -> DataFrame:
    """Bayesian gain whose channel is smoothed from the observed labels themselves, by a kernel over items (and annotators).

    ``acquired`` (item_id, annotator_id, label) without rows gives no scores.  ``uniform`` and ``channel`` estimate P(correct) from the posteriors'
    agreement with the labels, ``diagonal`` per class, ``full`` whole confusion rows; ``ucb`` takes an upper quantile of P(correct) for its mean;
    ``top_m`` keeps the m likeliest classes and one for the rest.  The prior accuracy is a number, or the mean agreement over all labels
    (``global_observed``), or over the annotator's own (``per_annotator_observed``, all where there are none).  ``gamma_scope``
    ``per_annotator`` takes the bandwidth from the items that the annotator labelled.  With ``draws`` the gain is the mean over so many
    draws from the posteriors, by choice also of the label distribution.
    """
    if gamma_scope not in ("global", "per_annotator"):
        raise ValueError(f"gamma_scope: {gamma_scope}")
    if variant == "full" and (ucb is not None or top_m is not None):
        raise ValueError("full confusions take neither ucb nor top_m")
    unit = kernel.unit_vectors(features)
    items = unit.join(candidates.select("item_id").distinct().hint("merge"), "item_id", "left_semi")
    labels_of = acquired.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_labels"))
    counted = staged(unit.join(labels_of.hint("merge"), "item_id"))
    seen = counted.select("item_id", "x")
    own_kernel = gamma_scope == "per_annotator"
    if not own_kernel:
        width = everyone = kernel.bandwidth(counted, gamma, weight="n_labels")
    else:
        points = acquired.select(*_PAIR).distinct().join(unit.hint("merge"), "item_id")
        own = kernel.bandwidth(points, gamma, by="annotator_id").withColumnRenamed("gamma", "own")
        who = acquired.select("annotator_id").union(candidates.select("annotator_id")).distinct()
        width = staged(who.join(own.hint("merge"), "annotator_id", "left").select("annotator_id", F.col("own").alias("gamma")))
        if not width.filter("gamma IS NULL").isEmpty():
            # an annotator without labels takes the bandwidth of all, whose pairs are many more
            width = width.fillna(float(kernel.bandwidth(counted, gamma, weight="n_labels").first()[0]), "gamma")
    pool = {"mix": mix, "similarity": similarity, "of_candidate": own_kernel, "pairs": candidates}
    long = posteriors.select("item_id", F.posexplode("p").alias("class", "p"))
    evidence = kernel.model_correctness(acquired, long)
    clip = lambda c: F.least(F.greatest(c, F.lit(1e-6)), F.lit(1 - 1e-6))
    if accuracy_mean in ("global_observed", "per_annotator_observed"):
        prior = evidence.agg(F.avg("score").alias("acc")).filter("acc IS NOT NULL").select(clip(F.col("acc")).alias("acc"))
    elif isinstance(accuracy_mean, str):
        raise ValueError(f"accuracy_mean: {accuracy_mean}")
    else:
        prior = evidence.select(F.lit(float(accuracy_mean)).alias("acc")).limit(1)
    rows = candidates.select(*_PAIR).crossJoin(F.broadcast(prior)).join(posteriors.hint("merge"), "item_id")
    if accuracy_mean == "per_annotator_observed":
        own = evidence.groupBy("annotator_id").agg(clip(F.avg("score")).alias("own_acc"))
        rows = rows.join(own.hint("merge"), "annotator_id", "left").withColumn("acc", F.coalesce("own_acc", "acc")).drop("own_acc")
    if class_prior == "uniform":
        rows = rows.withColumn("p", F.transform("p", lambda v: F.lit(1.0 / n_classes)))
    elif class_prior == "kernel":
        flat = kernel.bandwidth(seen, gamma) if own_kernel else everyone
        shares = posteriors.select("item_id", F.lit(0).alias("everybody"), *[F.get("p", F.lit(c)).alias(f"p{c}") for c in range(n_classes)])
        near = kernel.kernel_totals(items, seen, shares, flat, ["everybody"], [f"p{c}" for c in range(n_classes)], mix=mix, pairs=items.select("item_id", F.lit(0).alias("everybody")))
        near = near.select("item_id", F.array(*[1.0 / n_classes + F.col(f"p{c}") for c in range(n_classes)]).alias("kp"))
        rows = rows.join(near.hint("merge"), "item_id", "left").withColumn("p", normalised(F.coalesce("kp", F.transform("p", lambda v: F.lit(1.0)))))
    sums = kernel.kernel_sums(items, seen, evidence, width, **pool)
    conc = kernel.concentration(use_ess, tau)
    mu = F.when(F.col("mass") > TINY, F.col("s") / F.greatest("mass", F.lit(TINY))).otherwise(0.5)
    rows = rows.join(sums.select(*_PAIR, conc.alias("conc"), mu.alias("mu")).hint("merge"), list(_PAIR), "left").withColumn("conc", F.coalesce("conc", F.lit(0.0))).withColumn("mu", F.coalesce("mu", F.lit(0.5)))
    alpha, beta = F.col("acc") * accuracy_strength + F.col("conc") * F.col("mu"), (1 - F.col("acc")) * accuracy_strength + F.col("conc") * (1 - F.col("mu"))
    rows = _repeated(rows.withColumn("alpha", alpha).withColumn("beta", beta), draws)
    alpha, beta = F.col("alpha"), F.col("beta")
    if ucb is not None:
        theta = beta_quantile(alpha, beta, F.lit(float(ucb)))
    else:
        theta = beta_quantile(alpha, beta, uniform(seed, F.lit("theta"), *_PAIR, F.col("t"))) if draws else alpha / (alpha + beta)
    rows = rows.withColumn("theta", theta)
    if variant == "uniform":
        c = uniform_channel(F.array_repeat("theta", F.size("p")))
    elif variant == "channel":
        labels = kernel.dirichlet_posterior(items, seen, acquired, width, n_classes, label_strength / n_classes, use_ess, tau, **pool)
        rows = rows.join(labels.hint("merge"), list(_PAIR), "left").withColumn("gamma", F.coalesce("gamma", F.array_repeat(F.lit(label_strength / n_classes), n_classes)))
        if top_m is not None and top_m < n_classes:
            order = F.transform(F.sort_array(F.arrays_zip("p", "gamma"), asc=False), lambda e: e["gamma"])
            top = F.slice(order, 1, top_m)
            rows = rows.withColumn("gamma", F.concat(top, F.array(total(F.col("gamma")) - total(top))))
            best = F.slice(F.sort_array(as_doubles(F.col("p")), asc=False), 1, top_m)
            rows = rows.withColumn("p", normalised(F.concat(best, F.array(F.greatest(1 - total(best), F.lit(0.0))))))
        if draws and draw_labels:
            rows = rows.withColumn("gamma", dirichlet_draw(F.col("gamma"), _uniforms(seed, "label", F.size("gamma") - 1)))
        c = channel_rows(F.array_repeat("theta", F.size("p")), F.col("gamma"))
    elif variant in ("diagonal", "full"):
        shares = [f"p{c}" for c in range(n_classes)]
        labels = acquired.select(*_PAIR, "label").join(posteriors.select("item_id", *[F.get("p", F.lit(c)).alias(f"p{c}") for c in range(n_classes)]).hint("merge"), "item_id")
        cells = kernel.pair_totals(items, seen, labels, width, ["annotator_id", "label"], shares, **pool)
        entry = F.array(*[F.struct((F.lit(c * n_classes) + F.col("label")).cast("long").alias("i"), F.col(f"p{c}").alias("n")) for c in range(n_classes)])
        arrays = cells.groupBy(*_PAIR).agg(F.map_from_entries(F.flatten(F.collect_list(entry))).alias("cells"))
        rows = rows.join(arrays.hint("merge"), list(_PAIR), "left")
        prior_rows = kernel.confusion_prior(n_classes, F.col("acc"), accuracy_strength)
        counts = F.transform(prior_rows, lambda row, i: F.transform(row, lambda v, j: v + F.coalesce(F.col("cells")[(i * n_classes + j).cast("long")], F.lit(0.0))))
        rows = rows.withColumn("counted", F.transform(counts, lambda row: normalised(row))) if not draws else _drawn_rows(rows, counts, seed, F.lit(n_classes * (n_classes - 1)), "counted")
        counted = F.col("counted")
        c = counted if variant == "full" else uniform_channel(F.transform(counted, lambda row, i: F.get(row, i)))
    else:
        raise ValueError(f"variant: {variant}")
    return _mean_gain(rows.select(*_PAIR, as_doubles(F.col("p")).alias("p"), c.alias("c")), score, draws)


#: Panels on either side of the density's peak and nodes of a panel; drop of its logarithm, and distance from the peak, to which they go;
#: steps to a quantile within its panel; numbers at once.
PANELS, NODES, DROP, REACH, STEPS, QUANTILES_AT_ONCE = 12, 8, 40.0, 45.0, 6, 2048


def _beta_quantiles(a: np.ndarray, b: np.ndarray, q: np.ndarray) -> np.ndarray:
    out = np.empty(len(a))
    for lot in range(0, len(a), QUANTILES_AT_ONCE):
        some = slice(lot, lot + QUANTILES_AT_ONCE)
        out[some] = _quantiles(a[some], b[some], q[some])
    return out


def _quantiles(a: np.ndarray, b: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The density on the logit scale is integrated once, panel by panel, with its tails as series; Newton steps end in the panel of the quantile."""
    nodes, weights = np.polynomial.legendre.leggauss(NODES)
    every = np.arange(len(a))

    def height(t: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.minimum(a * t, -b * t) - (a + b) * np.log1p(np.exp(-np.abs(t)))

    middle = np.log(a) - np.log(b)
    peak = height(middle, a, b)

    def end(sign: int) -> np.ndarray:
        near, far = np.zeros(len(a)), np.full(len(a), REACH)
        for _ in range(16):
            d = (near + far) / 2
            high = height(middle + sign * d, a, b) - peak > -DROP
            near, far = np.where(high, d, near), np.where(high, far, d)
        return middle + sign * far

    def tail(t: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Mass below t, from the series of the incomplete beta."""
        x, term = 1 / (1 + np.exp(-t)), 1 / a
        whole = term
        for n in range(4):
            term = term * (a + b + n) / (a + 1 + n) * x
            whole = whole + term
        return np.exp(height(t, a, b) - peak) * whole

    low, high = end(-1), end(1)
    shares = np.arange(PANELS) / PANELS
    edges = np.concatenate([low[:, None] + (middle - low)[:, None] * shares, middle[:, None] + (high - middle)[:, None] * shares, high[:, None]], 1)
    half = np.diff(edges, axis=1) / 2
    t = (edges[:, :-1] + half)[:, :, None] + half[:, :, None] * nodes
    inside = (np.exp(height(t, a[:, None, None], b[:, None, None]) - peak[:, None, None]) @ weights) * half
    under, over = tail(low, a, b), tail(-high, b, a)
    below = np.concatenate([np.zeros((len(a), 1)), np.cumsum(inside, 1)], 1) + under[:, None]
    whole = below[:, -1] + over
    wanted = q * whole
    panel = np.clip((below <= wanted[:, None]).sum(1) - 1, 0, inside.shape[1] - 1)
    left, right, rest = edges[every, panel], edges[every, panel + 1], wanted - below[every, panel]
    start, t = left, left + (right - left) * np.clip(rest / np.maximum(inside[every, panel], 1e-300), 0, 1)
    for _ in range(STEPS):
        part = (t - start) / 2
        points = (start + part)[:, None] + part[:, None] * nodes
        miss = (np.exp(height(points, a[:, None], b[:, None]) - peak[:, None]) @ weights) * part - rest
        left, right = np.where(miss < 0, t, left), np.where(miss < 0, right, t)
        step = t - miss / np.maximum(np.exp(height(t, a, b) - peak), 1e-300)
        t = np.where((step >= left) & (step <= right), step, (left + right) / 2)
    # beyond the panels the density is an exponential
    with np.errstate(divide="ignore"):
        t = np.where(wanted < under, low + np.log(wanted / under) / a, t)
        t = np.where(whole - wanted < over, high - np.log(np.maximum(whole - wanted, 0) / over) / b, t)
    return 1 / (1 + np.exp(-np.clip(t, -40, 40)))


def beta_quantile(alpha: Column, beta: Column, q: Column) -> Column:
    """Quantile of Beta(alpha, beta), from its density on the logit scale; of a uniform q, a draw."""

    @F.pandas_udf("double")
    def run(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series(_beta_quantiles(*(np.asarray(v, float) for v in part)))

    return run(alpha, beta, q)


def _dirichlet(conc: np.ndarray, u: np.ndarray) -> np.ndarray:
    """A draw for each row of concentrations from its uniform numbers (one fewer): the stick is broken at Beta quantiles."""
    n, k = conc.shape
    conc = np.maximum(conc, TINY)
    out, stick = np.zeros((n, k)), np.ones(n)
    behind = np.cumsum(conc[:, ::-1], axis=1)[:, ::-1]
    for j in range(k - 1):
        part = _beta_quantiles(conc[:, j], behind[:, j + 1], u[:, j])
        out[:, j], stick = stick * part, stick * (1 - part)
    out[:, k - 1] = stick
    return out


def dirichlet_draw(conc: Column, u: Column) -> Column:
    """A Dirichlet draw of each array of concentrations, from its uniform numbers (one fewer than entries)."""

    @F.pandas_udf("array<double>")
    def run(c: pd.Series, u: pd.Series) -> pd.Series:
        return pd.Series(list(_dirichlet(np.stack(c.to_list()).astype(float), np.stack(u.to_list())))) if len(c) else pd.Series([], dtype=object)

    return run(conc, u)


def dirichlet_rows_draw(conc: Column, u: Column) -> Column:
    """As ``dirichlet_draw``, of every row of square arrays, which share the uniform numbers of the array."""

    @F.pandas_udf("array<array<double>>")
    def run(c: pd.Series, u: pd.Series) -> pd.Series:
        if not len(c):
            return pd.Series([], dtype=object)
        flat = np.stack([np.stack(list(x)) for x in c]).astype(float)
        n, k, _ = flat.shape
        drawn = _dirichlet(flat.reshape(n * k, k), np.stack(u.to_list()).reshape(n * k, k - 1)).reshape(n, k, k)
        return pd.Series([list(x) for x in drawn])

    return run(conc, u)
