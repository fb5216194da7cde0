"""Column functions on vectors and distributions (arrays of doubles)."""

from __future__ import annotations

from math import log

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Floor of denominators and probabilities.
TINY = 1e-12


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def distance2(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def as_doubles(x: Column) -> Column:
    return F.transform(x, lambda v: v.cast("double"))


def l2_normalised(x: Column, floor: float = TINY) -> Column:
    """x over its Euclidean norm, which counts as ``floor`` at least."""
    norm = F.greatest(F.sqrt(dot(x, x)), F.lit(floor))
    return F.transform(F.arrays_zip(x.alias("v"), F.array_repeat(norm, F.size(x)).alias("n")), lambda e: e["v"].cast("double") / e["n"])


def rbf(a: Column, b: Column, gamma: Column | float) -> Column:
    """exp(-gamma * squared distance)."""
    return F.exp(-F.lit(gamma) * distance2(a, b)) if isinstance(gamma, float | int) else F.exp(-gamma * distance2(a, b))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine of two unit vectors, the cosine held within [-1, 1]."""
    return 1 - F.least(F.greatest(dot(a, b), F.lit(-1.0)), F.lit(1.0))


def stacked(*columns: str) -> Column:
    """Columns in order as one vector."""
    return F.array(*[F.col(c).cast("float") for c in columns])


def of_length(x: Column, n: int) -> Column:
    """x, or an error where it has not ``n`` entries."""
    return F.when(F.size(x) == n, x).otherwise(F.raise_error(F.concat(F.lit(f"expected {n} entries, found "), F.size(x).cast("string"))).cast("array<double>"))


def normalised(p: Column, on_empty: str = "zeros") -> Column:
    """p over its sum; a row without mass becomes ``zeros`` or ``uniform``."""
    if on_empty not in ("zeros", "uniform"):
        raise ValueError(f"on_empty: {on_empty}")
    empty = F.transform(p, lambda v: F.lit(0.0)) if on_empty == "zeros" else F.transform(p, lambda v: F.lit(1.0) / F.size(p))
    return F.when(total(as_doubles(p)) <= TINY, empty).otherwise(F.transform(p, lambda v: v.cast("double") / total(as_doubles(p))))


def one_hot(label: Column, n_classes: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n_classes - 1)), lambda k: (k == label).cast("double"))


def argmax(p: Column) -> Column:
    """Index of the largest entry, the first of equal ones."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def clipped(p: Column) -> Column:
    """A distribution with entries of TINY at least, normalised again."""
    return normalised(F.transform(p, lambda v: F.greatest(v.cast("double"), F.lit(TINY))))


def uncertainty(p: Column, score: str = "entropy", log_base: float = 2.0) -> Column:
    """Entropy, 1 - (top - second), or 1 - sum of squares."""
    p = clipped(p)
    if score == "entropy":
        return -total(F.transform(p, lambda v: v * F.ln(v))) / F.lit(log(log_base))
    if score == "margin":
        top = F.sort_array(p, asc=False)
        return 1 - (F.get(top, F.lit(0)) - F.coalesce(F.get(top, F.lit(1)), F.lit(0.0)))
    if score == "brier":
        return 1 - total(F.transform(p, lambda v: v * v))
    raise ValueError(f"score: {score}")


def channel_rows(theta: Column, g: Column) -> Column:
    """Confusion rows from P(correct) per class and a distribution of wrong labels.

    Row i has theta[i] on the diagonal; the rest of it is dealt over the other labels by g without g[i], evenly where g has no other mass.
    """
    k = F.size(theta)
    return F.transform(
        theta,
        lambda t, i: F.transform(
            g,
            lambda v, j: F.when(i == j, t).otherwise(
                F.when(total(g) - F.get(g, i) > TINY, (1 - t) * v / (total(g) - F.get(g, i))).otherwise((1 - t) / F.greatest(k - 1, F.lit(1)))
            ),
        ),
    )


def uniform_channel(theta: Column) -> Column:
    """Confusion rows with P(correct) per class, wrong labels all alike."""
    k = F.size(theta)
    return F.transform(theta, lambda t, i: F.transform(theta, lambda _, j: F.when(i == j, t).otherwise((1 - t) / F.greatest(k - 1, F.lit(1)))))


def wrong_label_channel(theta: Column, gamma: Column) -> Column:
    """Channel rows whose wrong labels have the mean of a Dirichlet with parameters gamma, without the true class."""
    return channel_rows(theta, gamma)


def label_marginal(p: Column, rows: Column) -> Column:
    """P(label) from class probabilities and confusion rows."""
    return F.transform(F.sequence(F.lit(0), F.size(p) - 1), lambda j: total(F.zip_with(p, rows, lambda pk, row: pk * F.get(row, j))))


def expected_gain(p: Column, rows: Column, score: str = "entropy", log_base: float = 2.0) -> Column:
    """u(P) - E over labels of u(P given the label); not below 0 except for the margin, which may lose."""
    joint = F.transform(F.sequence(F.lit(0), F.size(p) - 1), lambda j: F.zip_with(p, rows, lambda pk, row: pk * F.get(row, j)))
    after = total(F.transform(joint, lambda col: total(col) * F.when(total(col) > TINY, uncertainty(normalised(col), score, log_base)).otherwise(0.0)))
    gain = uncertainty(p, score, log_base) - after
    return gain if score == "margin" else F.greatest(gain, F.lit(0.0))


def top_classes(p: Column, m: int) -> Column:
    """The m largest probabilities, then the rest as one more, normalised."""
    top = F.slice(F.sort_array(as_doubles(p), asc=False), 1, m)
    return normalised(F.concat(top, F.array(F.greatest(1 - total(top), F.lit(0.0)))))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def expertise(projection: Column, annotator: Column, bias: Column | float = 0.0) -> Column:
    """P(correct) of the low-rank model: sigmoid of the dot product and a bias."""
    return sigmoid(dot(projection, annotator) + (F.lit(bias) if isinstance(bias, float | int) else bias))


def expertise_labels(p: Column, theta: Column) -> Column:
    """P(label) under P(correct) theta and even errors: p * theta + (1 - p) * (1 - theta) / (K - 1)."""
    return F.transform(p, lambda v: v * theta + (1 - v) * (1 - theta) / F.greatest(F.size(p) - 1, F.lit(1)))
