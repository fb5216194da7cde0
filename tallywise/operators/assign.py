"""Budgeted selection of pairs from utilities (item_id, annotator_id, u), as ranking windows.

Absent pairs are infeasible.  Ties go to the lower item, then the lower annotator.  Results have a ``slot`` from 0: the order in
which a sequential loop would have taken the pairs.  A budget beyond the feasible pairs takes them all; a budget of 0 none.

Where both sides have caps, or quotas meet coverage, the sequential loop is replaced by rounds over locally dominant pairs;
each round is a job whose result goes to the shared folder.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywise.sources.staging import staged
from tallywise.tables import uniform

#: Named settings: coverage none is ``global``, hard is ``sample``.
PRESETS = {
    "greedy_global": {"selection": "greedy", "coverage": "none"},
    "greedy_sample": {"selection": "greedy", "coverage": "hard"},
    "quota_global": {"selection": "quota", "coverage": "none"},
    "quota_sample": {"selection": "quota", "coverage": "hard"},
    "epsilon_greedy_global": {"selection": "epsilon", "coverage": "none", "epsilon_max": 0.2, "epsilon_min": 0.01, "period": 10},
    "epsilon_greedy_sample": {"selection": "epsilon", "coverage": "hard", "epsilon_max": 0.2, "epsilon_min": 0.01, "period": 10},
    "softmax_greedy_global": {"selection": "softmax", "coverage": "none", "temperature_max": 0.01, "temperature_min": 0.001, "period": 10},
    "softmax_greedy_sample": {"selection": "softmax", "coverage": "hard", "temperature_max": 0.1, "temperature_min": 0.01, "period": 10},
}

_KEY = ("item_id", "annotator_id")


def _best(*first: Column) -> list[Column]:
    return [*first, F.col("u").desc(), F.col("item_id"), F.col("annotator_id")]


def _slots(pairs: DataFrame, budget: int, *order: Column) -> DataFrame:
    """The first ``budget`` pairs in order, with their slots; the window is over the budget, not over the pairs."""
    order = list(order) or _best()
    kept = pairs.orderBy(*order).limit(max(budget, 0))
    return kept.select((F.row_number().over(Window.orderBy(*order)) - 1).alias("slot"), *_KEY)


def _rank(*by: str, order: list[Column] | None = None) -> Column:
    return F.row_number().over(Window.partitionBy(*by).orderBy(*(order or _best())))


def _capped(pairs: DataFrame, per_item: int | None, caps: DataFrame | None) -> DataFrame:
    """Pairs that the sequential loop can take before any budget.

    A pair that ranks within what is left to its item and to its annotator is taken whatever the others do; taking these and lowering
    the caps, round by round, gives the loop's choice.
    """
    if caps is None:
        return pairs if per_item is None else pairs.withColumn("r", _rank("item_id")).filter(F.col("r") <= per_item).drop("r")
    pairs = pairs.join(caps.select("annotator_id", F.col("cap").cast("long").alias("cap_a")), "annotator_id").filter("cap_a > 0")
    if per_item is None:
        return pairs.withColumn("r", _rank("annotator_id")).filter("r <= cap_a").drop("r", "cap_a")
    left, taken = staged(pairs.withColumn("cap_i", F.lit(per_item).cast("long"))), None
    while True:
        ranked = staged(left.withColumn("ri", _rank("item_id")).withColumn("ra", _rank("annotator_id")))
        won = ranked.filter("ri <= cap_i AND ra <= cap_a").select(*_KEY, "u")
        if won.isEmpty():
            return taken if taken is not None else pairs.select(*_KEY, "u").limit(0)
        taken = won if taken is None else taken.unionByName(won)
        used_i = won.groupBy("item_id").agg(F.count(F.lit(1)).alias("ni"))
        used_a = won.groupBy("annotator_id").agg(F.count(F.lit(1)).alias("na"))
        rest = ranked.filter("NOT (ri <= cap_i AND ra <= cap_a)").join(used_i, "item_id", "left").join(used_a, "annotator_id", "left")
        rest = rest.select(*_KEY, "u", (F.col("cap_a") - F.coalesce("na", F.lit(0))).alias("cap_a"), (F.col("cap_i") - F.coalesce("ni", F.lit(0))).alias("cap_i"))
        left = staged(rest.filter("cap_a > 0 AND cap_i > 0"))


def greedy(utilities: DataFrame, budget: int, coverage: str = "none", soft_lambda: float = 0.0, max_per_item: int | None = None, caps: DataFrame | None = None) -> DataFrame:
    """(slot, item_id, annotator_id) of the best pairs.

    Coverage ``hard`` gives every item its first label before any its second; ``soft`` takes ``soft_lambda`` off for each label
    that the item has in this batch.  ``caps`` (annotator_id, cap) and ``max_per_item`` bound the batch.
    """
    pairs = utilities.select(*_KEY, "u").filter("u IS NOT NULL AND NOT isnan(u)")
    if budget <= 0:
        return _slots(pairs, 0)
    if coverage == "none":
        return _slots(_capped(pairs, max_per_item, caps), budget)
    ranked = pairs.withColumn("r", _rank("item_id"))
    if max_per_item is not None:
        ranked = ranked.filter(F.col("r") <= max_per_item)
    if coverage == "soft":
        if caps is not None:
            return _soft_capped(pairs, budget, soft_lambda, max_per_item, caps)
        return _slots(ranked.withColumn("u", F.col("u") - soft_lambda * (F.col("r") - 1)), budget)
    if coverage != "hard":
        raise ValueError(f"coverage: {coverage}")
    if caps is None:
        return _slots(ranked, budget, *_best(F.col("r")))
    out, open_, left = None, staged(pairs), staged(caps.select("annotator_id", F.col("cap").cast("long").alias("cap")))
    level, count = 0, 0
    while count < budget and (max_per_item is None or level < max_per_item):
        won = staged(_capped(open_, 1, left).withColumn("r", F.lit(level)))
        n = won.count()
        if not n:
            break
        out, count, level = won if out is None else out.unionByName(won), count + n, level + 1
        used = won.groupBy("annotator_id").agg(F.count(F.lit(1)).alias("n"))
        left = staged(left.join(used, "annotator_id", "left").select("annotator_id", (F.col("cap") - F.coalesce("n", F.lit(0))).alias("cap")))
        # an item that got nothing at this level has no free annotator left and drops out
        open_ = staged(open_.join(won.select(*_KEY), list(_KEY), "left_anti").join(won.select("item_id"), "item_id", "left_semi"))
    return _slots(out if out is not None else pairs.withColumn("r", F.lit(0)).limit(0), budget, *_best(F.col("r")))


def _soft_capped(pairs: DataFrame, budget: int, soft_lambda: float, per_item: int | None, caps: DataFrame | None, temperature: float | None = None) -> DataFrame:
    """Soft coverage in rounds, under annotator caps if given.

    A score only falls as its item gets labels.  So an item's best pair is taken with its present score if, among the
    annotator's open pairs by their present scores, it ranks within what is left to the annotator.  Pairs below the scores
    that fill the budget are dropped.  With a ``temperature`` the score is not a utility but minus the logarithm of the time at
    which the pair would be drawn, and each label of the item delays what is left of it, see ``_delayed``.
    """
    if caps is None:
        open_ = pairs.withColumn("cap", F.lit(None).cast("long"))
    else:
        open_ = pairs.join(caps.select("annotator_id", F.col("cap").cast("long").alias("cap")).hint("merge"), "annotator_id").filter("cap > 0")
    open_ = staged(open_.select(*_KEY, "u", F.col("u").alias("score"), "cap", F.lit(0).cast("long").alias("n")))
    out, count = None, 0
    by_score = [F.col("score").desc(), F.col("item_id"), F.col("annotator_id")]
    while True:
        best = open_.withColumn("ri", _rank("item_id", order=by_score))
        best = best.filter("ri = 1") if caps is None else best.withColumn("ra", _rank("annotator_id", order=by_score)).filter("ri = 1 AND ra <= cap")
        won = staged(best.select(*_KEY, F.col("score").alias("u")))
        new = won.count()
        if not new:
            return _slots(out if out is not None else pairs.limit(0), budget)
        out, count = won if out is None else staged(out.unionByName(won).orderBy(*_best()).limit(budget)), min(count + new, budget)
        used_i = won.select("item_id", F.col("u").alias("won"))
        used_a = won.groupBy("annotator_id").agg(F.count(F.lit(1)).alias("ta"))
        rest = open_.join(won.select(*_KEY), list(_KEY), "left_anti").join(used_i.hint("merge"), "item_id", "left").join(used_a.hint("merge"), "annotator_id", "left")
        n, cap = F.col("n") + F.col("won").isNotNull().cast("long"), F.col("cap") - F.coalesce("ta", F.lit(0))
        later = F.col("u") - soft_lambda * n if temperature is None else F.when(F.col("won").isNull(), F.col("score")).otherwise(_delayed(F.col("score"), F.col("won"), soft_lambda / temperature))
        rest = rest.select(*_KEY, "u", later.alias("score"), cap.alias("cap"), n.alias("n")).filter("cap IS NULL OR cap > 0")
        if per_item is not None:
            rest = rest.filter(F.col("n") < per_item)
        if count == budget:
            rest = rest.filter(F.col("score") >= out.agg(F.min("u")).first()[0])
        open_ = staged(rest)


def _delayed(score: Column, won: Column, slower: float) -> Column:
    """The new score of a pair whose item was drawn at the score ``won``, from where its time runs exp(slower) times slower.

    Times t = exp(-score) become w + (t - w) * exp(slower), in logarithms.
    """
    apart = won - score
    y = apart + slower + F.ln(1 - F.exp(-apart))
    grown = F.greatest(y, F.lit(0.0)) + F.log1p(F.exp(-F.abs(y)))
    return F.when(apart <= 0, won).otherwise(won - grown)


def _by_levels(pairs: DataFrame, budget: int, per_item: int | None, caps: DataFrame | None, score: Callable[[int], Column]) -> DataFrame:
    """Hard coverage, level by level, with a score of its own for each level."""
    out, open_, left = None, staged(pairs), None if caps is None else staged(caps.select("annotator_id", F.col("cap").cast("long").alias("cap")))
    level, count = 0, 0
    while count < budget and (per_item is None or level < per_item):
        won = staged(_capped(open_.withColumn("u", score(level)).select(*_KEY, "u"), 1, left).select(*_KEY, "u").withColumn("r", F.lit(level)))
        n = won.count()
        if not n:
            break
        out, count, level = won if out is None else out.unionByName(won), count + n, level + 1
        if left is not None:
            used = won.groupBy("annotator_id").agg(F.count(F.lit(1)).alias("n"))
            left = staged(left.join(used.hint("merge"), "annotator_id", "left").select("annotator_id", (F.col("cap") - F.coalesce("n", F.lit(0))).alias("cap")))
        # an item that got nothing at this level has no free annotator left and drops out
        open_ = staged(open_.join(won.select(*_KEY).hint("merge"), list(_KEY), "left_anti").join(won.select("item_id").hint("merge"), "item_id", "left_semi"))
    return _slots(out if out is not None else pairs.withColumn("r", F.lit(0)).limit(0), budget, *_best(F.col("r")))


def cosine_value(high: float, low: float | None, cycle: int, period: int) -> float:
    """From ``high`` at cycle 0 to ``low`` from ``period`` on; constant without ``low``."""
    if low is None:
        return high
    return low + (high - low) * (1 + math.cos(math.pi * min(cycle, period) / max(period, 1))) / 2


def epsilon_greedy(utilities: DataFrame, budget: int, epsilon: float, cycle: int = 0, seed: int = 0, coverage: str = "none", top_m: int | None = None, soft_lambda: float = 0.0, max_per_item: int | None = None, caps: DataFrame | None = None) -> DataFrame:
    """Each slot takes the best pair left, or with chance ``epsilon`` a random one of those left (of the ``top_m`` best left, if given).

    Coverage and caps as in ``greedy``; random pairs count for them too.  With hard coverage a level is over when every item with
    an open pair has one more label, and every level has random numbers of its own.
    """
    if coverage not in ("none", "hard", "soft"):
        raise ValueError(f"coverage: {coverage}")
    pairs = utilities.select(*_KEY, "u").filter("u IS NOT NULL AND NOT isnan(u)")
    kinds = ", ".join(f"{k} {pairs.schema[k].dataType.simpleString()}" for k in _KEY)
    out, count, level = utilities.sparkSession.createDataFrame([], f"slot int, {kinds}"), 0, 0
    left = None if caps is None else staged(caps.select("annotator_id", F.col("cap").cast("long").alias("cap")))
    open_ = staged(pairs) if coverage == "hard" else pairs
    while count < budget and (coverage != "hard" or max_per_item is None or level < max_per_item):
        fresh = (F.lit(level),) if level else ()
        rows = open_.withColumn("x", uniform(seed, F.lit(cycle), *fresh, "item_id", "annotator_id"))
        won = _dealt(rows, _flips(rows, count, budget, epsilon, cycle, seed), budget - count, 1 if coverage == "hard" else max_per_item, left, soft_lambda if coverage == "soft" else 0.0, top_m)
        n = won.count()
        if not n:
            break
        out, count, level = out.unionByName(won.select((F.col("slot") + (count - 1)).cast("int").alias("slot"), *_KEY)), count + n, level + 1
        if coverage != "hard":
            break
        if left is not None:
            used = won.groupBy("annotator_id").agg(F.count(F.lit(1)).alias("n"))
            left = staged(left.join(used.hint("merge"), "annotator_id", "left").select("annotator_id", (F.col("cap") - F.coalesce("n", F.lit(0))).alias("cap")))
        # an item without a label of this level has no open pair left and drops out
        open_ = staged(open_.join(won.select(*_KEY).hint("merge"), list(_KEY), "left_anti").join(won.select("item_id").hint("merge"), "item_id", "left_semi"))
    return out


def _flips(rows: DataFrame, start: int, budget: int, epsilon: float, cycle: int, seed: int) -> DataFrame:
    """(stream, j, slot, pick) of the slots from 1: stream 1 explores; j numbers the slots of a stream."""
    draw = lambda name: uniform(seed, F.lit(cycle), F.lit(name), F.col("id"))
    draws = rows.sparkSession.range(start, budget).select((F.col("id") - (start - 1)).alias("slot"), draw("pick").alias("pick"), (draw("slot") < epsilon).cast("int").alias("stream"))
    return staged(draws.withColumn("j", F.row_number().over(Window.partitionBy("stream").orderBy("slot")).cast("long")))


def _dealt(open_: DataFrame, flips: DataFrame, budget: int, per_item: int | None, caps: DataFrame | None, soft_lambda: float, top_m: int | None) -> DataFrame:
    """(slot, item_id, annotator_id) of a sequence of slots that take from two orders of the open pairs (u, x).

    Slots of stream 0 take the best pair that is still feasible, those of stream 1 the one with the least x, or one of the ``top_m`` best.
    Only the heads of the orders are needed; they are lengthened if a stream gets to their end.
    """
    if caps is not None:
        open_ = open_.join(caps.hint("merge"), "annotator_id").filter("cap > 0")
    else:
        open_ = open_.withColumn("cap", F.lit(None).cast("long"))
    best = open_.select(*_KEY, "cap", "u", F.lit(0).alias("k"))
    if soft_lambda > 0:
        # a pair counts with each number of labels that its item can have by then
        most = F.least(F.count(F.lit(1)).over(Window.partitionBy("item_id")), F.lit(budget), F.lit(per_item or budget))
        best = open_.withColumn("most", most.cast("int")).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("most") - 1))).select(*_KEY, "cap", (F.col("u") - soft_lambda * F.col("k")).alias("u"), "k")
    # without caps a stream passes over no more entries than the other takes
    free = caps is None and per_item is None and soft_lambda == 0
    take, total = (1 if free else 16) * (budget + (top_m or 0)) + 1000, best.count()
    while True:
        heads = best.orderBy(*_best(), "k").limit(take).select(F.lit(0).alias("stream"), *_KEY, "cap", "k", (-F.col("u")).alias("o"))
        if top_m is None:
            heads = heads.unionByName(open_.orderBy("x", *_KEY).limit(take).select(F.lit(1).alias("stream"), *_KEY, "cap", F.lit(-1).alias("k"), F.col("x").alias("o")))
        order = Window.partitionBy("stream").orderBy("o", *_KEY, "k")
        entries = staged(heads.withColumn("b", F.row_number().over(order)).drop("o"))
        won, spare = _settled(entries, flips, budget, per_item, soft_lambda > 0, top_m)
        if take >= total or spare >= (top_m or 0) + 1:
            return won
        take *= 4


def _settled(entries: DataFrame, flips: DataFrame, budget: int, per_item: int | None, soft: bool, top_m: int | None) -> tuple[DataFrame, int]:
    """The pairs of all slots, and how many feasible entries the shorter of the orders has left.

    Every step places the entries at the slots in which their streams reach them if the entries marked as infeasible are passed
    over, and marks anew by the slots at which items, annotators and pairs are then used up.  If the marks are right up to a
    slot, the next step's are right up to the next slot at least, so the marks that stay as they are give the sequential result.
    """
    explores = flips.filter("stream = 1")
    state, drawn = entries.withColumn("skip", F.lit(False)), None
    # no table of picks or slots has more rows than the budget
    side = lambda df: F.broadcast(df) if budget <= 500_000 else df.hint("merge")
    turns = side(flips.select("stream", "j", "slot"))
    before = Window.partitionBy("stream").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    while True:
        placed = state.withColumn("j", F.coalesce(F.sum((~F.col("skip")).cast("long")).over(before), F.lit(0)) + 1).join(turns, ["stream", "j"], "left")
        picks = placed.filter("NOT skip AND slot IS NOT NULL").select("slot", *_KEY)
        own = staged((picks if drawn is None else picks.unionByName(drawn)).groupBy(*_KEY).agg(F.min("slot").alias("own")))
        of = lambda key, name: side(own.groupBy(key).agg(F.sort_array(F.collect_list("own")).alias(name)))  # noqa: B023, E731
        seen = placed.join(side(own), list(_KEY), "left").join(of("item_id", "of_item"), "item_id", "left").join(of("annotator_id", "of_annotator"), "annotator_id", "left")
        ends = [F.col("own"), F.get("of_annotator", (F.col("cap") - 1).cast("int"))]
        begin = F.lit(0).cast("long")
        if per_item is not None:
            ends.append(F.get("of_item", F.lit(per_item - 1)))
        if soft:
            # in the random order a pair counts with any number of labels of its item
            ends.append(F.when(F.col("k") >= 0, F.get("of_item", F.col("k"))))
            begin = F.when(F.col("k") <= 0, F.lit(0)).otherwise(F.coalesce(F.get("of_item", F.col("k") - 1), F.lit(budget + 2)))
        seen = seen.withColumn("until", F.coalesce(F.least(*ends), F.lit(budget + 2))).withColumn("begin", begin)
        at = F.coalesce("slot", F.lit(budget + 1))
        after = staged(seen.select(*entries.columns, (~((at <= F.col("until")) & (at > F.col("begin")))).alias("skip"), F.col("skip").alias("old"), "slot", "until", "begin"))
        same = after.filter("skip <> old").isEmpty()
        if top_m is not None:
            again = _explored(after, explores, budget, top_m)
            if same and drawn is not None:
                both = again.withColumn("one", F.lit(1)).unionByName(drawn.withColumn("one", F.lit(-1)))
                same = both.groupBy("slot", *_KEY).agg(F.sum("one").alias("one")).filter("one <> 0").isEmpty()
            else:
                same = False
            drawn = again
        state = after.select(*entries.columns, "skip")
        if same:
            spare = after.filter("NOT skip AND slot IS NULL").groupBy("stream").count().agg(F.min("count"), F.count(F.lit(1))).first()
            streams = 1 if top_m is not None else 2
            return own.select(F.col("own").alias("slot"), *_KEY), spare[0] if spare[1] == streams else 0


def _explored(after: DataFrame, explores: DataFrame, budget: int, top_m: int) -> DataFrame:
    """(slot, item_id, annotator_id): of the ``top_m`` best entries that are feasible at each exploring slot, the one drawn."""
    lively = after.select("b", *_KEY, "until", "begin")
    # no more entries than these are infeasible at any slot
    shut = lively.filter((F.col("until") <= budget) | (F.col("begin") > 0)).count()
    met = lively.filter(F.col("b") <= top_m + shut).join(F.broadcast(explores.select("slot", "pick")), (F.col("slot") <= F.col("until")) & (F.col("slot") > F.col("begin")))
    ranked = met.withColumn("rn", F.row_number().over(Window.partitionBy("slot").orderBy("b"))).filter(F.col("rn") <= top_m)
    chosen = ranked.withColumn("of", F.max("rn").over(Window.partitionBy("slot"))).filter(F.col("rn") == F.floor(F.col("pick") * F.col("of")) + 1)
    return staged(chosen.select("slot", *_KEY))


def softmax_sample(utilities: DataFrame, budget: int, temperature: float, cycle: int = 0, seed: int = 0, coverage: str = "none", soft_lambda: float = 0.0, max_per_item: int | None = None, caps: DataFrame | None = None) -> DataFrame:
    """Sampling without replacement with weights exp(u / temperature): the largest of u / T plus Gumbel noise.

    Coverage and caps as in ``greedy``.  With hard coverage every level has noise of its own; with soft coverage the noise is
    the time of an exponential race, in which a label of an item slows down its other pairs.
    """
    pairs = utilities.select(*_KEY, "u").filter("u IS NOT NULL AND NOT isnan(u)")

    def score(level: int) -> Column:
        fresh = (F.lit(level),) if level else ()
        return F.col("u") / temperature - F.ln(-F.ln(uniform(seed, F.lit(cycle), *fresh, "item_id", "annotator_id")))

    if budget <= 0 or coverage == "none":
        return greedy(pairs.withColumn("u", score(0)), budget, "none", max_per_item=max_per_item, caps=caps)
    if coverage == "hard":
        return _by_levels(pairs, budget, max_per_item, caps, score)
    if coverage == "soft":
        return _soft_capped(pairs.withColumn("u", score(0)), budget, soft_lambda, max_per_item, caps, temperature)
    raise ValueError(f"coverage: {coverage}")


def quota(utilities: DataFrame, budget: int, coverage: str = "none", history: DataFrame | None = None, caps: DataFrame | None = None) -> DataFrame:
    """The annotator with the fewest labels so far goes first, then the utility; with hard coverage the item with the fewest in
    this batch comes between.  ``history`` (annotator_id, n) are labels before the batch.
    """
    pairs = utilities.select(*_KEY, "u").filter("u IS NOT NULL AND NOT isnan(u)")
    if history is not None:
        pairs = pairs.join(history.select("annotator_id", F.col("n").cast("long").alias("hist")), "annotator_id", "left")
    pairs = pairs.withColumn("hist", F.coalesce("hist", F.lit(0)) if history is not None else F.lit(0).cast("long"))
    pairs = pairs.join(caps.select("annotator_id", F.col("cap").cast("long").alias("cap")), "annotator_id") if caps is not None else pairs.withColumn("cap", F.lit(None).cast("long"))
    if coverage == "none":
        ranked = pairs.withColumn("r", _rank("annotator_id")).filter("cap IS NULL OR r <= cap")
        return _slots(ranked.withColumn("level", F.col("hist") + F.col("r") - 1), budget, *_best(F.col("level")))
    if coverage != "hard":
        raise ValueError(f"coverage: {coverage}")
    # state: open pairs with the counts of both sides; ``level`` is the least count of an annotator that can still take a pair
    open_ = staged(pairs.filter("cap IS NULL OR cap > 0").withColumn("nb", F.lit(0).cast("long")).withColumn("ni", F.lit(0).cast("long")))
    out, count = None, 0
    while count < budget:
        level = open_.agg(F.min(F.col("hist") + F.col("nb"))).first()[0]
        if level is None:
            break
        while True:  # each annotator of the level takes one
            now = open_.filter(F.col("hist") + F.col("nb") == level)
            order = _best(F.col("ni"))
            won = now.withColumn("ra", _rank("annotator_id", order=order)).withColumn("ri", _rank("item_id", order=order)).filter("ra = 1 AND ri = 1")
            won = staged(won.select(*_KEY, "u", F.col("ni").alias("at"), F.lit(level).alias("level")))
            n = won.count()
            if not n:
                break
            out, count = won if out is None else out.unionByName(won), count + n
            taken_i = won.select("item_id", F.lit(1).alias("ti"))
            taken_a = won.select("annotator_id", F.lit(1).alias("ta"))
            rest = open_.join(won.select(*_KEY), list(_KEY), "left_anti").join(taken_i, "item_id", "left").join(taken_a, "annotator_id", "left")
            rest = rest.withColumn("ni", F.col("ni") + F.coalesce("ti", F.lit(0))).withColumn("nb", F.col("nb") + F.coalesce("ta", F.lit(0)))
            open_ = staged(rest.drop("ti", "ta").filter("cap IS NULL OR nb < cap"))
    empty = pairs.select(*_KEY, "u", F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("level")).limit(0)
    return _slots(out if out is not None else empty, budget, *_best(F.col("level"), F.col("at")))


def assign(utilities: DataFrame, budget: int, selection: str = "greedy", coverage: str = "none", cycle: int = 0, seed: int = 0, caps: DataFrame | None = None, history: DataFrame | None = None, **p) -> DataFrame:
    """Any of the above by name; annealed settings go by ``cycle``, which is all their state."""
    bounds = {k: p[k] for k in ("soft_lambda", "max_per_item") if k in p}
    if selection == "greedy":
        return greedy(utilities, budget, coverage, caps=caps, **bounds)
    if selection == "quota":
        if bounds:
            raise ValueError(f"quotas take no {', '.join(bounds)}")
        return quota(utilities, budget, coverage, history, caps)
    if selection == "epsilon":
        eps = _annealed(p, "epsilon", 0.2, cycle)
        return epsilon_greedy(utilities, budget, eps, cycle, seed, coverage, p.get("top_m"), caps=caps, **bounds)
    if selection == "softmax":
        t = _annealed(p, "temperature", 1.0, cycle)
        return softmax_sample(utilities, budget, t, cycle, seed, coverage, caps=caps, **bounds)
    raise ValueError(f"selection: {selection}")


def _annealed(p: dict, name: str, default: float, cycle: int) -> float:
    """The value of a setting at a cycle: constant, or from its largest to its smallest value by a cosine (by default)."""
    kind = p.get(f"{name}_schedule", "cosine")
    if kind not in ("constant", "cosine"):
        raise ValueError(f"{name}_schedule: {kind}")
    high = p.get(f"{name}_max", default)
    return high if kind == "constant" else cosine_value(high, p.get(f"{name}_min"), cycle, p.get("period", 100))
