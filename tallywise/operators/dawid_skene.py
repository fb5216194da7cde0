"""Consensus by expectation maximisation: annotator confusions and class posteriors in turn.

Each step is a join of the labels with the confusions and two grouped sums; the tables of a step go to the shared folder, so the
plan does not grow with the iterations, and only the largest change of a posterior comes to the driver: tables by item are sorted and merged,
those by annotator alone may be broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallywise.operators.aggregate import class_prior, classes, confusions, confusions_with_prior, dense, majority_vote, soft_votes
from tallywise.sources.staging import release, staged

TINY = 1e-12


def _normalised(scores: DataFrame) -> DataFrame:
    """(item_id, class, p) from log scores."""
    w = Window.partitionBy("item_id")
    top = scores.withColumn("e", F.exp(F.col("s") - F.max("s").over(w)))
    return top.select("item_id", "class", (F.col("e") / F.sum("e").over(w)).alias("p"))


#: Machine precision, which keeps logarithms finite.
EPS = 2.0**-52


def expectation(annotations: DataFrame, confusion: DataFrame, prior: DataFrame, n_classes: int) -> DataFrame:
    """Posteriors from priors (class, p) or (item_id, class, p) and the confusion of every label given."""
    given = annotations.join(confusion, ["annotator_id", "label"]).groupBy("item_id", F.col("truth").alias("class")).agg(F.sum(F.ln(F.greatest("p", F.lit(TINY)))).alias("l"))
    if "item_id" in prior.columns:
        both = prior.join(given.hint("merge"), ["item_id", "class"], "left")
    else:
        both = given.join(F.broadcast(prior), "class")
    return _normalised(both.select("item_id", "class", (F.ln(F.greatest("p", F.lit(TINY))) + F.coalesce("l", F.lit(0.0))).alias("s")))


def dawid_skene(annotations: DataFrame, n_classes: int, max_iter: int = 100, tol: float = 1e-5, smoothing: float = 0.01, items: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame, dict]:
    """Posteriors (item_id, class, p), confusions, class prior, and {iterations, change, converged}.

    Items of ``items`` without labels get the prior.  If no item has two labels, the majority label is certain and nothing iterates;
    without labels everything is even.
    """
    labels = annotations.select("item_id", "annotator_id", "label")
    spark = annotations.sparkSession
    even = classes(n_classes, annotations).withColumn("p", F.lit(1.0 / n_classes))
    most = labels.groupBy("item_id").count().agg(F.max("count")).first()[0]
    info = {"iterations": 0, "change": 0.0, "converged": True}
    if most is None:
        post = (items.select("item_id") if items is not None else spark.createDataFrame([], "item_id long")).crossJoin(even)
        return post, confusions(labels, post, n_classes, smoothing), even, info
    if most < 2:
        post = staged(dense(majority_vote(labels).select("item_id", F.col("label").alias("class"), F.lit(1.0).alias("p")), n_classes))
        prior = staged(class_prior(post))
    else:
        post = staged(dense(soft_votes(labels), n_classes))
        while info["iterations"] < max_iter:
            prior = staged(class_prior(post))
            c = staged(confusions(labels, post, n_classes, smoothing))
            new = staged(expectation(labels, c, prior, n_classes))
            release(prior, c)
            old = post.select("item_id", "class", F.col("p").alias("o"))
            change = new.join(old.hint("merge"), ["item_id", "class"]).agg(F.max(F.abs(F.col("p") - F.col("o")))).first()[0]
            release(post)
            post, info = new, {"iterations": info["iterations"] + 1, "change": change, "converged": change <= tol}
            if change <= tol:
                break
        prior = staged(class_prior(post))
    c = staged(confusions(labels, post, n_classes, smoothing))
    if items is not None:
        rest = items.select("item_id").join(post.select("item_id").distinct().hint("merge"), "item_id", "left_anti").crossJoin(F.broadcast(prior))
        post = post.unionByName(rest.select("item_id", "class", "p"))
    return post, c, prior, info


def log_likelihood(annotations: DataFrame, confusion: DataFrame, prior: DataFrame) -> float:
    """Of all labels, with the true classes summed out."""
    s = annotations.join(confusion, ["annotator_id", "label"]).groupBy("item_id", F.col("truth").alias("class")).agg(F.sum(F.ln(F.greatest("p", F.lit(TINY)))).alias("l"))
    s = s.join(F.broadcast(prior), "class").withColumn("s", F.col("l") + F.ln(F.greatest("p", F.lit(TINY))))
    w = Window.partitionBy("item_id")
    one = s.withColumn("m", F.max("s").over(w)).groupBy("item_id").agg((F.max("m") + F.ln(F.sum(F.exp(F.col("s") - F.col("m"))))).alias("v"))
    return one.agg(F.sum("v")).first()[0] or 0.0


def crowd_em(annotations: DataFrame, n_classes: int, features: DataFrame | None = None, max_iter: int = 10, tol: float = 1e-3, prior_full: float = 1.0, prior_diag: float = 0.0, reg: float = 1e-3) -> tuple[DataFrame, DataFrame, dict]:
    """Posteriors, confusions, {iterations, objective, history}: EM with a classifier of the features (item_id, x) as class model.

    Each step takes the confusions from the posteriors, refits the classifier on these as weights (without features the class
    prior takes its place), and takes new posteriors.  The objective is their expected log-likelihood and the log-density
    of the confusions' Dirichlet prior; it stops when that changes by less than ``tol``.
    """
    labels = annotations.select("item_id", "annotator_id", "label")
    post, history = staged(dense(soft_votes(labels), n_classes)), []
    c = None
    while len(history) < max_iter:
        old = c
        c = staged(confusions_with_prior(labels, post, n_classes, prior_full, prior_diag))
        model = class_prior(post) if features is None else class_model(features, post, n_classes, reg)
        model = staged(model)
        new = staged(expectation(labels, c, model, n_classes))
        history.append(em_objective(labels, c, model, new, prior_full, prior_diag))
        release(post, model, *([old] if old is not None else []))
        post = new
        if len(history) > 1 and abs(history[-1] - history[-2]) < tol:
            break
    return post, c, {"iterations": len(history), "objective": history[-1] if history else None, "history": history}


def em_objective(annotations: DataFrame, confusion: DataFrame, model: DataFrame, post: DataFrame, prior_full: float = 1.0, prior_diag: float = 0.0) -> float:
    """Sum of posterior * log(class probability * product of label probabilities), and of (prior - 1) * log(confusion).

    ``model`` is (class, p) or (item_id, class, p); the prior of a cell is ``prior_full``, on the diagonal with ``prior_diag`` more.
    """
    given = annotations.join(confusion, ["annotator_id", "label"]).groupBy("item_id", F.col("truth").alias("class")).agg(F.product("p").alias("l"))
    by = ["item_id", "class"] if "item_id" in model.columns else ["class"]
    rows = post.select("item_id", "class", F.col("p").alias("q")).join(model.hint("merge"), by).join(given.hint("merge"), ["item_id", "class"], "left")
    likelihood = rows.agg(F.sum(F.col("q") * F.ln(F.col("p") * F.coalesce("l", F.lit(1.0)) + EPS))).first()[0] or 0.0
    excess = F.lit(prior_full - 1.0) + F.when(F.col("truth") == F.col("label"), prior_diag).otherwise(0.0)
    return likelihood + (confusion.agg(F.sum(excess * F.ln(F.col("p") + EPS))).first()[0] or 0.0)


def class_model(features: DataFrame, targets: DataFrame, n_classes: int, reg: float = 1e-3) -> DataFrame:
    """(item_id, class, p) of all featured items by logistic regression on weighted targets (item_id, class, p)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector, vector_to_array

    x = features.select("item_id", array_to_vector(F.col("x").cast("array<double>")).alias("features"))
    rows = targets.filter("p > 0").join(x, "item_id").select("features", F.col("class").cast("double").alias("label"), F.col("p").alias("weight"))
    model = LogisticRegression(weightCol="weight", regParam=reg, maxIter=50, family="multinomial").fit(rows)
    out = model.transform(x).select("item_id", F.posexplode(vector_to_array("probability")).alias("class", "p"))
    return classes(n_classes, features).join(out, "class").select("item_id", "class", "p")
