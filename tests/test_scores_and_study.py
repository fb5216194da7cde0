"""Scores, kernels, schedules, studies and sources on hand-made tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallywise.functions import arrays, schedules, texts
from tallywise.operators import kernel, learn, loss, scorers, select
from tallywise.plans import study
from tallywise.sources import store


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_schedules(spark):
    c = spark.range(10).withColumnRenamed("id", "cycle")
    got = [r[0] for r in c.select(schedules.cosine_value(F.col("cycle"), 2.0, 1.0, 10)).collect()]
    assert [round(x, 3) for x in got[:3]] == [2.0, 1.97, 1.883] and got[-1] == pytest.approx(1.0)
    got = [r[0] for r in c.select(schedules.cosine_value(F.col("cycle"), 2.0, 1.0, 10, t_0=3)).collect()]
    assert got[0] == got[3] == got[6] == 2.0


def test_uncertainty_and_gain(spark):
    even = F.array(*[F.lit(0.25)] * 4)
    assert one(spark, arrays.uncertainty(even)) == pytest.approx(2.0)
    assert one(spark, arrays.uncertainty(even, "margin")) == pytest.approx(1.0)
    assert one(spark, arrays.uncertainty(even, "brier")) == pytest.approx(0.75)
    sure = arrays.uniform_channel(F.array(*[F.lit(1.0)] * 4))
    assert one(spark, arrays.expected_gain(even, sure)) == pytest.approx(2.0, abs=1e-6)
    blind = arrays.uniform_channel(F.array(*[F.lit(0.25)] * 4))
    assert one(spark, arrays.expected_gain(even, blind)) == pytest.approx(0.0, abs=1e-9)
    assert one(spark, arrays.normalised(F.array(F.lit(0.0), F.lit(0.0)))) == [0, 0]
    assert one(spark, arrays.normalised(F.array(F.lit(0.0), F.lit(0.0)), "uniform")) == [0.5, 0.5]


def test_texts(spark):
    n = lambda v: one(spark, texts.normalised_number(F.lit(v)))
    assert [n(v) for v in ("1.50", "15e-1", "-0", "007", "abc", "100")] == ["1.5", "1.5", "0", "7", "abc", "100"]
    assert one(spark, texts.slug(F.lit("  -- "))) == "value" and one(spark, texts.slug(F.lit("Ab c!"))) == "ab_c"
    p = one(spark, texts.override_parts(F.lit("~model@a.b")))
    assert p["negated"] and p["rhs"] is None and p["keys"] == ["choice/model_a.b", "model@a/b", "model@a.b"]
    assert one(spark, texts.format_number(F.lit(3.0))) == "3" and one(spark, texts.format_number(F.lit(0.123456))) == "0.123"


def test_bandwidth_of_few_points(spark):
    p = spark.createDataFrame([(1, [0.0, 0.0])], "item_id long, x array<double>")
    assert kernel.bandwidth(p).first()[0] == 1.0
    two = spark.createDataFrame([(1, [0.0, 0.0]), (2, [0.0, 2.0])], "item_id long, x array<double>")
    assert kernel.bandwidth(two).first()[0] == pytest.approx(0.25)
    assert kernel.bandwidth(two, 3.0).first()[0] == 3.0
    with pytest.raises(ValueError, match="ucb"):
        scorers.kernel_smoothed_gain(two, two, two, two, 2, "full", ucb=0.9)


def test_no_observed_label_no_scores(spark):
    f = spark.createDataFrame([(1, [0.0, 1.0]), (2, [1.0, 0.0])], "item_id long, x array<double>")
    post = spark.createDataFrame([(1, [0.5, 0.5]), (2, [0.9, 0.1])], "item_id long, p array<double>")
    cand = spark.createDataFrame([(1, 1), (2, 1)], "item_id long, annotator_id long")
    none = spark.createDataFrame([], "item_id long, annotator_id long, label int")
    assert scorers.kernel_smoothed_gain(cand, f, none, post, 2).count() == 0
    assert {r["u"] for r in scorers.semantic_diversity(cand, f, none).collect()} == {2.0}
    assert {r["u"] for r in scorers.representation_diversity(cand, f, none, 2).collect()} == {2.0}


def test_beta_quantile_and_draws(spark):
    rows = spark.createDataFrame([(2.0, 3.0), (9.5, 0.5), (50.0, 4.0)], "a double, b double")
    q = [r[0] for r in rows.select(scorers.beta_quantile(F.col("a"), F.col("b"), F.lit(0.9))).collect()]
    r = np.random.default_rng(0)
    assert np.allclose(q, [np.quantile(r.beta(a, b, 200_000), 0.9) for a, b in ((2, 3), (9.5, 0.5), (50, 4))], atol=0.01)
    u = (F.pmod(F.xxhash64("id"), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    d = spark.range(3000).select(scorers.beta_quantile(F.lit(2.0), F.lit(3.0), u).alias("d")).agg(F.avg("d")).first()[0]
    assert abs(d - 0.4) < 0.02


def test_mask_is_exact(spark):
    rows = spark.range(40).select((F.col("id") % 2).alias("head"), F.floor(F.col("id") / 2).alias("item_id"))
    assert {r["n"] for r in loss.bootstrap_mask(rows, 0.25).filter("masked").groupBy("head").agg(F.count(F.lit(1)).alias("n")).collect()} == {5}


def test_learners_lower_their_loss(spark):
    r = np.random.default_rng(0)
    y = r.integers(0, 2, 120)
    f = spark.createDataFrame([(i, [float(2 * y[i] - 1 + r.normal(0, 0.5)), 1.0]) for i in range(120)], "item_id long, x array<double>")
    a = spark.createDataFrame([(i, j, int(y[i] if r.random() < (0.9 if j else 0.6) else 1 - y[i])) for i in range(120) for j in range(3)], "item_id long, annotator_id long, label int")
    for reg in ("trace-reg", "geo-reg-f", "geo-reg-w"):
        found = learn.crowd_layer(a, f, 2, reg, steps=8)
        assert found["loss"][-1] < found["loss"][0] and np.allclose(found["confusions"].sum(2), 1)
    low = learn.low_rank_expertise(a, f, 2, steps=8)
    assert low["loss"][-1] < low["loss"][0] and low["annotator_vectors"].count() == 3


def test_item_selection(spark):
    f = spark.createDataFrame([(i, [float(i % 3) * 10 + i * 0.01, 0.0]) for i in range(30)], "item_id long, x array<double>")
    picked = [r[0] for r in select.typical_items(f, spark.createDataFrame([(0,)], "item_id long"), 2).collect()]
    assert len(set(picked)) == len(picked) <= 2
    spread = [r[0] for r in select.spread_items(f, 6).collect()]
    assert len(set(spread)) == 6


def test_aulc_of_odd_curves(spark):
    h = spark.createDataFrame([("a", 0, 0.5), ("b", 0, 0.0), ("b", 10, 1.0), ("b", 30, 1.0)], "run_id string, step int, value double")
    assert {r["run_id"]: r["aulc"] for r in study.normalised_aulc(h, ("run_id",)).collect()} == {"a": 0.5, "b": pytest.approx(25 / 30)}
    one_strategy = spark.createDataFrame([("d", "s", 0.5)], "dataset string, strategy string, mean double")
    assert study.main_strategies(one_strategy, 2).count() == 0


def test_division_with_absences(spark):
    expected = spark.createDataFrame([(1, ["a=1.0", "~b"]), (2, ["a=2"]), (3, [])], "row_id long, overrides array<string>")
    params = spark.createDataFrame([(10, "a", "1"), (11, "a", "1"), (11, "b", "x"), (12, "a", "3")], "run_id long, key string, value string")
    assert [tuple(r) for r in study.matched_rows(expected, params).collect()] == [(1, 10)]
    assert sorted(r[0] for r in study.missing_rows(expected, params).select("row_id").collect()) == [2, 3]
    with pytest.raises(ValueError, match="no column"):
        study.run_filter(params, nothing=[1])


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([(1, "train"), (2, "test")], "item_id long, split string")
    store.save_dataset(df, str(tmp_path / "d"), {"k": 2})
    with pytest.raises(Exception, match="(?i)exist"):
        store.save_dataset(df, str(tmp_path / "d"), {})
    store.save_dataset(df, str(tmp_path / "d"), {}, force=True)
    assert spark.read.parquet(str(tmp_path / "d/data")).count() == 2
    first = store.materialise(df, {"a": 1, "verbose": True}, str(tmp_path / "c"))
    assert store.materialise(df.limit(0), {"a": 1, "verbose": False}, str(tmp_path / "c")).count() == first.count() == 2
    (tmp_path / "j.json").write_text('{"x": {"n": 1}, "y": {"n": 2}}')
    assert {tuple(r) for r in store.read_json_records(spark, str(tmp_path / "j.json"), "struct<n: int>").collect()} == {("x", 1), ("y", 2)}
    assert store.source_signature(spark, str(tmp_path / "j.json")).first()["files"] == 1
    files = spark.createDataFrame([("/a/one.png",), ("/b/two.png",), ("/c/two.png",)], "path string")
    assert store.attach_paths(spark.createDataFrame([("one.png",)], "file string"), files).first()["path"] == "/a/one.png"
    with pytest.raises(Exception, match="no single file"):
        store.attach_paths(spark.createDataFrame([("two.png",)], "file string"), files).collect()
    rows = spark.createDataFrame([("r2",), ("r1",)], "run_id string")
    store.write_manifest(rows, str(tmp_path / "m"))
    assert store.manifest_row(spark, str(tmp_path / "m"), 1).first()["run_id"] == "r2"
    p = spark.createDataFrame([("r1", "k", "v")], "run_id string, key string, value string")
    m = spark.createDataFrame([("r1", s, "acc", float(s)) for s in range(6)], "run_id string, step int, key string, value double")
    store.log_run(p, m, str(tmp_path / "log"), log_every=2)
    assert spark.read.parquet(str(tmp_path / "log/metrics")).count() == 3
    base = store.content_hash(df, "item_id", "split").first()
    assert base == store.content_hash(df.repartition(3), "item_id", "split").first() and base["hash"] != store.content_hash(df.limit(1), "item_id", "split").first()["hash"]


def test_image_source(spark, tmp_path):
    import struct
    import zlib

    def png(path, w, h, grey):
        raw = b"".join(b"\x00" + bytes([min(255, 40 * (x + y)) for x in range(w) for _ in range(1 if grey else 3)]) for y in range(h))
        chunk = lambda t, d: struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d))
        path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">2I5B", w, h, 8, 0 if grey else 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))

    png(tmp_path / "a.png", 3, 2, False)
    png(tmp_path / "b.png", 3, 2, True)
    rows = store.images(spark, str(tmp_path)).collect()
    assert len(rows) == 2 and all(len(r["x"]) == 18 and 0 <= min(r["x"]) <= max(r["x"]) <= 1 for r in rows)
    png(tmp_path / "c.png", 4, 2, False)
    with pytest.raises(ValueError, match="shapes"):
        store.images(spark, str(tmp_path))


def test_numbers_as_the_reference_prints_them(spark):
    rows = [(0.25, "0.25"), (float("nan"), "?"), (None, "?"), (1e20, "100000000000000000000"), (0.5125, f"{0.5125:.3g}"), (2.5, "2.5"), (1234567.5, "1.23e+06"), (-3.0, "-3"), (float("inf"), "inf")]
    df = spark.createDataFrame(rows, "v double, want string").select("want", texts.format_number(F.col("v")).alias("got"))
    assert all(r["got"] == r["want"] for r in df.collect())
    assert one(spark, texts.format_number(F.lit("x"))) == "x" and one(spark, texts.format_number(F.lit("0.250"))) == "0.25"
    # halves that the binary value decides, not the shortest decimal
    halves = [i / 16 + 0.5 / 1000 for i in range(16)] + [0.5175, 0.54245]
    df = spark.createDataFrame([(v,) for v in halves], "v double").select("v", texts.percent(F.col("v"), 1).alias("p"), texts.format_decimal(F.col("v")).alias("d"))
    assert all(r["p"] == f"{100.0 * r['v']:.1f}%" and r["d"] == f"{r['v']:.3f}" for r in df.collect())
    assert [one(spark, texts.format_integer(F.lit(v))) for v in (150000.0, 2.5, 3.5, -1234.0)] == ["150_000", "2", "4", "-1_234"]
    assert one(spark, texts.percent(F.lit(None).cast("double"))) == "nan%"
    assert one(spark, texts.bar(F.lit(0.5))) == "█" * 7 + "░" * 7 and one(spark, texts.bar(F.lit(2.0))) == "█" * 14
    assert one(spark, texts.bar(F.lit(float("nan")))) == one(spark, texts.bar(F.lit(None).cast("double"))) == " " * 14
    assert one(spark, texts.listed(F.array(*[F.lit(i) for i in range(14)]))) == ", ".join(map(str, range(12))) + ", … (+2 more)"


def test_strategy_labels_keep_settings_apart(spark):
    label = lambda *a: one(spark, study.strategy_label(*[F.lit(x).cast("string") for x in a]))
    assert label("em", "kg", "greedy_sample", None, None, None, None) == "em | kg + greedy_sample"
    assert label(None, None, None, None, None, None, None) == "unknown | unknown + unknown"
    assert label("em", "kg", "epsilon_greedy_sample", "0.2", "0.20", "5", None) == "em | kg + epsilon_greedy_sample[eps=0.2]"
    assert label("em", "kg", "epsilon_greedy_sample", "0.2", "0.01", "5", "step") == "em | kg + epsilon_greedy_sample[step:0.2->0.01,T=5]"
    assert label("em", "kg", "epsilon_greedy_sample", "0.2", None, None, None) == "em | kg + epsilon_greedy_sample[cosine:0.2->?,T=?]"


def test_draws_have_the_moments_of_their_laws(spark):
    from tallywise.tables import uniform

    u = spark.range(4000).withColumn("u", uniform(1, F.lit("a"), "id"))
    b = np.array([r[0] for r in u.select(scorers.beta_quantile(F.lit(2.0), F.lit(5.0), F.col("u"))).collect()])
    assert abs(b.mean() - 2 / 7) < 0.01 and abs(b.var() - 10 / (49 * 8)) < 0.003
    us = F.transform(F.sequence(F.lit(0), F.lit(1)), lambda i: uniform(2, "id", i))
    d = np.array([r[0] for r in u.select(scorers.dirichlet_draw(F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0)), us)).collect()])
    assert np.allclose(d.sum(1), 1) and np.abs(d.mean(0) - [1 / 6, 1 / 3, 1 / 2]).max() < 0.015
    want = [a / 6 * (1 - a / 6) / 7 for a in (1, 2, 3)]
    assert np.abs(d.var(0) - want).max() < 0.003
    two = u.limit(3).select(scorers.dirichlet_rows_draw(F.array(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0), F.lit(1.0))), F.array(F.col("u"), F.col("u"))).alias("c")).collect()
    assert all(np.allclose(np.array(r["c"]).sum(1), 1) for r in two)


@pytest.mark.parametrize("variant", ["uniform", "channel", "full"])
def test_mean_of_draws_nears_the_gain_of_sure_posteriors(spark, variant):
    f = spark.createDataFrame([(1, [0.0, 1.0]), (2, [1.0, 0.0])], "item_id long, x array<double>")
    post = spark.createDataFrame([(1, [0.5, 0.3, 0.2]), (2, [0.9, 0.05, 0.05])], "item_id long, p array<double>")
    cand = spark.createDataFrame([(1, 1), (2, 1)], "item_id long, annotator_id long")
    seen = spark.createDataFrame([(1, 1, 0), (2, 1, 1)], "item_id long, annotator_id long, label int")
    args = (cand, f, seen, post, 3, variant)
    mean = {r["item_id"]: r["u"] for r in scorers.kernel_smoothed_gain(*args, gamma=0.5, accuracy_strength=1e6).collect()}
    drawn = {r["item_id"]: r["u"] for r in scorers.kernel_smoothed_gain(*args, gamma=0.5, accuracy_strength=1e6, draws=4, seed=7).collect()}
    assert drawn.keys() == mean.keys() and all(drawn[i] == pytest.approx(mean[i], abs=5e-3) for i in mean)
    again = {r["item_id"]: r["u"] for r in scorers.kernel_smoothed_gain(*[a.repartition(3) if hasattr(a, "repartition") else a for a in args], gamma=0.5, draws=4, seed=7).collect()}
    assert again == {r["item_id"]: r["u"] for r in scorers.kernel_smoothed_gain(*args, gamma=0.5, draws=4, seed=7).collect()}


@pytest.mark.parametrize("stat", ["median", "mean", "minimum"])
def test_bandwidth_counts_points_by_weight(spark, stat):
    r = np.random.default_rng(5)
    for n in (2, 7, 300):
        x, w = np.round(r.normal(0, 1, (n, 3)), 1), r.integers(1, 3, n)
        p = spark.createDataFrame([(i, x[i].tolist(), int(w[i])) for i in range(n)], "item_id long, x array<double>, n long")
        for weight in (None, "n"):
            many = np.repeat(x, w, axis=0) if weight else x
            i, j = np.triu_indices(len(many), 1)
            d = np.sqrt(np.square(many[i] - many[j]).sum(1))
            want = max({"median": np.median(d), "mean": d.mean(), "minimum": d.min()}[stat], 1e-3) ** -2
            assert kernel.bandwidth(p, stat, weight=weight).first()[0] == pytest.approx(want, rel=1e-9)


def test_crowd_em_objective(spark):
    from tallywise.operators import dawid_skene
    from tallywise.operators.aggregate import class_prior, confusions_with_prior, dense, soft_votes

    rows = [(i, a, (i + (a == 2) * (i % 2)) % 3) for i in range(12) for a in range(3) if (i + a) % 4]
    labels = spark.createDataFrame(rows, "item_id long, annotator_id long, label int")
    post = dense(soft_votes(labels), 3)
    c = confusions_with_prior(labels, post, 3, 1.5, 0.5)
    prior = class_prior(post)
    q = {(r["item_id"], r["class"]): r["p"] for r in post.collect()}
    cc = {(r["annotator_id"], r["truth"], r["label"]): r["p"] for r in c.collect()}
    pr = {r["class"]: r["p"] for r in prior.collect()}
    want = sum(v * np.log(pr[k] * np.prod([cc[a, k, y] for j, a, y in rows if j == i]) + 2.0**-52) for (i, k), v in q.items())
    want += sum((0.5 + 0.5 * (t == y)) * np.log(p + 2.0**-52) for (_, t, y), p in cc.items())
    assert dawid_skene.em_objective(labels, c, prior, post, 1.5, 0.5) == pytest.approx(want)
    info = dawid_skene.crowd_em(labels, 3, max_iter=50, tol=1e-2)[2]
    h = info["history"]
    assert abs(h[-1] - h[-2]) < 1e-2 and all(abs(a - b) >= 1e-2 for a, b in zip(h[:-2], h[1:-1], strict=True)) and info["iterations"] == len(h)


def test_nearest_and_least_distances_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(kernel, "BLOCK", 7)
    r = np.random.default_rng(9)
    x, g = np.round(r.normal(0, 1, (60, 3)), 1), r.integers(0, 3, 60)
    p = spark.createDataFrame([(i, x[i].tolist(), int(g[i])) for i in range(60)], "item_id long, x array<double>, g int")
    d2 = np.square(x[:, None] - x[None]).sum(2)
    for by in (None, "g"):
        got = {(a["item_id"], a["rank"]): a["other_id"] for a in kernel.nearest(p if by else p.drop("g"), 4, by).collect()}
        want = {}
        for i in range(60):
            others = sorted((j for j in range(60) if j != i and (by is None or g[j] == g[i])), key=lambda j: (d2[i, j], j))
            want |= {(i, k + 1): j for k, j in enumerate(others[:4])}
        assert got == want
    few = p.filter("item_id % 9 = 0")
    got = {a["item_id"]: a["d2"] for a in kernel.least_distance2(p.drop("g"), few.drop("g")).collect()}
    assert all(got[i] == pytest.approx(d2[i, ::9].min()) for i in range(60))
