import numpy as np
from pyspark.sql import functions as F

from tallywise.llm import language_id, quality, toxicity
from tallywise.llm.common import documents, held_out


def labels(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def test_gru_gradients():
    net, r = language_id.ByteGru(3), np.random.default_rng(0)
    net.p = {k: v.astype(float) for k, v in net.p.items()}
    x, y = r.integers(97, 110, (5, 4)), r.integers(0, 3, 5)

    def loss():
        p = net.label(x)
        return -np.log(p[:, np.arange(5), y]).mean()

    g = net.gradients(x, y)
    for name, at in (("embed", (0, x[0, 1], 3)), ("embed", (1, x[2, 3], 40)), ("recur", (0, 2, 7)), ("recur", (1, 5, 37)), ("out", (3, 1)), ("bias", (2,))):
        keep = net.p[name][at]
        net.p[name][at] = keep + 1e-3
        up = loss()
        net.p[name][at] = keep - 1e-3
        down = loss()
        net.p[name][at] = keep
        assert abs((up - down) / 2e-3 - g[name][at]) < 1e-3


def test_language_accuracy_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    d = documents(spark, sf)
    got = language_id.languages(d).join(d.select("doc_id", "lang"), "doc_id").filter("held_out AND lang IS NOT NULL").collect()
    assert len(got) > 100 and np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.95


def test_languages_of_odd_documents(odd_docs, docs):
    got = {r["doc_id"]: r for r in language_id.languages(odd_docs, steps=20).collect()}
    assert len(got) == 11
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (3, 4, 5, 6, 8))
    assert got[1]["lang_pred"] in ("en", "es") and 0 <= got[1]["score"] <= 1
    assert language_id.languages(docs([])).count() == 0
    untaught = language_id.languages(docs([(1, "some text")])).collect()[0]
    assert untaught["lang_pred"] == "und" and untaught["score"] == 0
    kept = language_id.keep_identified(odd_docs, steps=20)
    assert kept.columns == odd_docs.columns and not {3, 4, 5, 6, 8} & {r["doc_id"] for r in kept.collect()}


def test_no_language_is_left_out_of_the_sample(docs):
    words = {"aa": "kato mika tako", "bb": "dwerg strupf klonz", "cc": "ñeó éüá öåß"}
    rows = [(i, f"{words[x]} " * (2000 if x == "cc" else 20), x) for i in range(60) for x in [("aa", "bb", "cc")[i % 3]]]
    net, langs = language_id.fit(docs(rows))
    assert langs == ["aa", "bb", "cc"]
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.predict(docs(rows), net, langs).collect()}
    assert got == {i: x for i, _, x in rows}
    assert language_id.fit(docs(rows), per_language=3, most_languages=1, steps=5)[1] == langs


def test_windows_are_drawn_evenly():
    labels = np.repeat([0, 1, 2], [1000, 10, 300])
    pick = language_id.evenly(labels, 210)
    assert len(set(pick)) == 210 and np.bincount(labels[pick]).tolist() == [100, 10, 100]
    assert (language_id.evenly(labels, 5000) == np.arange(1310)).all()


def best_segments(scores):
    """The best subsequence, then the same to its left and right."""
    if not len(scores):
        return []
    best = max(((sum(scores[a:b]), -(b - a), a, b) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)), default=None)
    if best[0] <= 1e-12:
        return []
    s, _, a, b = best
    return best_segments(scores[:a]) + [(a, b, s)] + [(x + b, y + b, v) for x, y, v in best_segments(scores[b:])]


def test_segments_against_brute_force():
    r = np.random.default_rng(4)
    for _ in range(200):
        scores = np.round(r.normal(-0.3, 1, r.integers(0, 14)), 3)
        got = [(a, b, round(s, 6)) for a, b, s in toxicity.maximal_segments(scores)]
        assert got == [(a, b, round(s, 6)) for a, b, s in best_segments(list(scores))]


def test_segments_of_falling_sums_take_linear_time():
    import time

    scores = np.tile([1.0, -1.5], 100_000)
    began = time.time()
    assert len(toxicity.maximal_segments(scores)) == 100_000 and time.time() - began < 3
    began = time.time()
    assert len(toxicity.maximal_segments(np.tile([1.0, -0.5], 100_000))) == 1 and time.time() - began < 3


def test_scores_against_brute_force(spark, docs):
    import math
    import re

    rows = [(i, "the day was fine and we went " * (i % 5) + ("Vile vile scum! " if i % 2 else "") + f"home by train{i % 7}") for i in range(300)] + [(900, None), (901, ""), (902, "vile " * 3000), (903, "vile")]
    lab = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, toxic int")
    texts = docs(rows).select("doc_id", "text")
    model = toxicity.fit(texts, lab)
    learned = [(t.lower(), i % 2) for i, t in rows[:300] if binascii_crc(i) % 5 not in (0, 4)]
    token = re.compile(r"[a-z0-9_\x80-\U0010ffff]+")
    seen = {n: {} for n in (4, 5, 99)}
    for t, y in learned:
        for n, table in seen.items():
            for w in {x[:n] for x in token.findall(t)}:
                c = table.setdefault(w, [0, 0])
                c[0] += y
                c[1] += 1
    base = math.log(sum(y for _, y in learned) / sum(1 - y for _, y in learned))

    def odds(w):
        share = 1 / (1 + math.exp(-base))
        for n in (4, 5, 99):
            t, k = seen[n].get(w[:n], (0, 0)) if seen[n].get(w[:n], (0, 0))[1] >= 2 else (0, 0)
            share = (t + 4 * share) / (k + 4)
        return math.log(share / (1 - share)) - base

    got = {r["doc_id"]: r["score"] for r in toxicity.toxic_passages(texts, model).collect()}
    for i, t in rows:
        ws = token.findall((t or "").lower())
        scores = [(0.0 if k and w == ws[k - 1] else odds(w)) - 1.0 for k, w in enumerate(ws)]
        parts = [s for *_, s in toxicity.maximal_segments(np.array(scores))] if scores else []
        x = sorted(((s - model.place) / model.scale - math.log(max(len(ws), 1)) for s in parts), reverse=True)
        best, total = 0.0, 0.0
        for r, v in enumerate([v for v in x if v > 0], 1):
            total += v
            best = min(best, -total + (r - 1) * math.log(max(total, 1)) - math.lgamma(r + 1) - math.lgamma(r) + r * math.log(2))
        assert abs(got[i] - 1 / (1 + math.exp(best - model.cut))) < 1e-5, i


def binascii_crc(i):
    import binascii

    return binascii.crc32(str(i).encode())


def test_language_pooling_against_brute_force(docs):
    net = language_id.ByteGru(3, seed=5)
    text = "Hello wörld, this isaverylongrunofletterswithoutanyspaceinit ok x\nñandú 12 z"
    got = language_id.predict(docs([(1, text)]), net, ["a", "b", "c"]).first()
    data = text.encode()
    data = bytes(c + 32 if 65 <= c <= 90 else c for c in data)
    letter = [97 <= c <= 122 or c >= 128 for c in data]
    runs, at = [], 0
    while at < len(data):
        if letter[at]:
            end = at
            while end < len(data) and letter[end] and end - at < language_id.WINDOW:
                end += 1
            runs.append(data[at:end])
            at = end
        else:
            at += 1
    p = np.concatenate([net.label(np.frombuffer(w, np.uint8)[None])[:, 0] for w in runs]).mean(0)
    assert got["lang_pred"] == "abc"[p.argmax()] and abs(got["score"] - p.max()) < 1e-5


def test_rows_of_one_id_are_kept_by_their_own_text(docs):
    rows = [(i, f"{'kato mika tako ' if i % 2 else 'dwerg strupf klonz '}" * 20, "ab"[i % 2]) for i in range(60)] + [(1, "1234"), (1, None), (2, "!!")]
    kept = language_id.keep_identified(docs(rows), steps=60).collect()
    assert len(kept) == 60 and all(r["text"] and r["text"][0] in "kd" for r in kept)


def test_samples_follow_a_threshold(spark):
    from tallywise.llm.common import sampled

    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 1000 == 0, 1).otherwise(0).alias("grade"))
    got = {r["grade"]: r["count"] for r in sampled(rows, "grade", 400, "x").groupBy("grade").count().collect()}
    assert got[1] == 20 and 400 <= got[0] <= 400 + 160
    assert sorted(map(tuple, sampled(rows, "grade", 50, "x").collect())) == sorted(map(tuple, sampled(rows.repartition(9), "grade", 50, "x").collect()))


def test_quality_gradients():
    r = np.random.default_rng(3)
    owner = np.repeat(np.arange(12), 4)
    cols, vals, y = r.integers(0, 9, 48), r.normal(0, 1, 48), r.integers(0, 4, 12)
    weight = r.random(12)
    params = [r.normal(0, 1, 9), r.normal(0, 1, 1), r.normal(0, 0.3, 2)]
    loss = lambda: quality.loss_and_gradients(*params, owner, cols, vals, y, weight, 0.1)
    # the likelihood itself, by the definition of cumulative links
    cuts = np.concatenate([params[1], params[1] + np.cumsum(np.exp(params[2]))])
    f = np.array([(vals * params[0][cols])[owner == i].sum() for i in range(12)])
    above = lambda i, k: 1.0 if k == 0 else 0.0 if k == 4 else 1 / (1 + np.exp(cuts[k - 1] - f[i]))
    want = -sum(weight[i] * np.log(above(i, y[i]) - above(i, y[i] + 1)) for i in range(12)) + 0.05 * (params[0] ** 2).sum()
    assert abs(loss()[0] - want) < 1e-9
    for p, g in zip(params, loss()[1], strict=True):
        for k in range(len(p)):
            keep = p[k]
            p[k] = keep + 1e-5
            up = loss()[0]
            p[k] = keep - 1e-5
            down = loss()[0]
            p[k] = keep
            assert abs((up - down) / 2e-5 - g[k]) < 1e-5


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    d, lab = documents(spark, sf).filter("doc_id IS NOT NULL"), labels(spark, sf)
    got = toxicity.toxicity(d, lab).join(lab, "doc_id").filter("held_out").collect()
    y, p = np.array([r["toxic"] for r in got]), np.array([r["predicted"] for r in got])
    assert (p[y == 1] == 1).mean() > 0.85 and (p[y == 0] == 0).mean() > 0.98


def test_toxicity_of_odd_documents(spark, odd_docs, docs):
    lab = spark.createDataFrame([(i, i % 2) for i in range(12)] + [(None, 1), (3, None), (5, 0)], "doc_id long, toxic int")
    got = toxicity.toxicity(odd_docs, lab, per_label=5).collect()
    assert len(got) == odd_docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert toxicity.toxicity(docs([]), lab).count() == 0
    assert [r["score"] for r in toxicity.toxicity(docs([(1, "x")]), lab.limit(0)).collect()] == [0.0]


def test_passages_are_where_the_words_are(docs, spark):
    rows = [(i, "the day was fine and we went " + ("vile vile scum " if i % 2 else "") + "home by train") for i in range(200)]
    lab = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    texts = docs(rows).select("doc_id", "text")
    found = toxicity.toxic_passages(texts, toxicity.fit(texts, lab))
    for r in found.collect():
        text = dict(rows)[r["doc_id"]]
        assert all(set(text[p["begin"] : p["end"]].split()) <= {"vile", "scum"} for p in r["passages"])
        assert bool(r["passages"]) == bool(r["doc_id"] % 2) == (r["score"] >= 0.5)


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    d, lab = documents(spark, sf), labels(spark, sf)
    got = quality.quality(d, quality.usefulness(lab)).join(lab, "doc_id").filter("held_out").collect()
    y, k = np.array([r["quality"] for r in got]), np.array([r["kept"] for r in got])
    assert (k[y == 1]).mean() > 0.97 and (~k[y == 0]).mean() > 0.97
    assert all(r["p_top"] <= r["score"] and abs(r["expected_grade"] - r["score"] - r["p_top"]) < 1e-9 for r in got)


def test_quality_of_odd_documents(spark, odd_docs, docs):
    ratings = spark.createDataFrame([(i, i % 3) for i in range(12)] + [(None, 1), (4, None)], "doc_id long, grade int")
    got = quality.quality(odd_docs, ratings, rounds=20).collect()
    assert len(got) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert quality.quality(docs([]), ratings).count() == 0
    assert [r["score"] for r in quality.quality(docs([(1, "x")]), ratings.limit(0)).collect()] == [0.0]


def test_held_out_rows_are_a_fifth(spark):
    share = spark.range(5000).agg(F.avg(held_out(F.col("id")).cast("double"))).first()[0]
    assert 0.17 < share < 0.23
