"""Ranks and sums over parts, exact masks, and runs that are cut off and started again."""

import random

import pytest
from pyspark.sql import functions as F

from tallywise.functions import schedules
from tallywise.operators import loss, metrics
from tallywise.operators.order import positions
from tallywise.plans import round as rounds
from tallywise.sources import store


def test_positions_and_running_sums(spark):
    r = random.Random(1)
    rows = [(r.choice(["a", "b", None]), r.choice([None, 1, 2, 2, 2, 7]), i, i % 5) for i in range(300)] + [("c", 2, 1000 + i, 1) for i in range(2000)]
    df = spark.createDataFrame(rows, "g string, v long, id long, w long").repartition(5)
    got = {v["id"]: (v["pos"], v["n"], v["s"]) for v in positions(df, ["v", "id"], ["g"], {"s": "w"}, parts=7).collect()}
    for g in ("a", "b", None, "c"):
        own = sorted((v for v in rows if v[0] == g), key=lambda v: (v[1] is not None, v[1] or 0, v[2]))
        total = 0
        for i, v in enumerate(own):
            total += v[3]
            assert got[v[2]] == (i, len(own), total)
    assert positions(df.limit(0), ["v"]).count() == 0
    alone = positions(df.select("id"), ["id"]).collect()
    assert sorted(v["pos"] for v in alone) == list(range(2300)) and {v["n"] for v in alone} == {2300}


def test_masks_have_the_exact_share(spark, monkeypatch):
    monkeypatch.setattr(loss, "BINS", 8)
    heads = spark.range(200).select((F.col("id") % 3).alias("head"), (F.col("id") / 3).cast("long").alias("item_id"))
    for share in (0.0, 0.25, 0.5, 1.0):
        per = {v["head"]: (v["n"], v["m"]) for v in loss.bootstrap_mask(heads, share, seed=2).groupBy("head").agg(F.count("*").alias("n"), F.sum(F.col("masked").cast("int")).alias("m")).collect()}
        assert {h: n for h, (n, _) in per.items()} == {0: 67, 1: 67, 2: 66}
        assert all(abs(m - n * share) <= 0.5 for n, m in per.values())


def test_gini_and_entropy_of_tied_annotators(spark):
    counts = [0, 0, 3, 3, 3, 1, 7]
    rows = [(i * 100 + j, a, 0) for a, c in enumerate(counts) for i, j in ((a, k) for k in range(c))]
    got = metrics.allocation_metrics(spark.createDataFrame(rows, "item_id long, annotator_id long, label int"), spark.range(len(counts)).withColumnRenamed("id", "annotator_id")).first()
    n, t = len(counts), sum(counts)
    cum = [sum(sorted(counts)[: i + 1]) for i in range(n)]
    assert got["alloc_gini"] == pytest.approx((n + 1 - 2 * sum(cum) / t) / n)
    import math

    assert got["alloc_entropy"] == pytest.approx(-sum(c / t * math.log(c / t) for c in counts if c))


def test_restarts_ignore_the_end_and_cycles_have_bounds(spark):
    c = spark.range(8).withColumnRenamed("id", "cycle")
    got = [round(v[0], 3) for v in c.select(schedules.cosine_value(F.col("cycle"), 2.0, 1.0, 8, t_0=4, t_end=5)).collect()]
    assert got == [2.0, 1.854, 1.5, 1.146] * 2
    with pytest.raises(Exception, match="cycle outside 0 to 6"):
        c.select(schedules.cosine_value(F.col("cycle"), 2.0, 1.0, 7)).collect()


def test_rounds_go_on_where_they_were_cut_off(spark, tmp_path):
    pool = spark.range(120).select((F.col("id") % 20).alias("item_id"), (F.col("id") / 20).cast("long").alias("annotator_id"), (F.col("id") % 20 % 3).cast("int").alias("label"))
    items = spark.range(20).select(F.col("id").alias("item_id"), (F.col("id") % 3).cast("int").alias("y"))
    args = {"pool": pool, "items": items, "n_classes": 3, "cycles": 3, "pairs_per_cycle": 12, "capacity": 5, "ratio": lambda cycle: 1.0 + cycle}
    whole = [tuple(v) for v in rounds.labelling_rounds(**args).orderBy("cycle").collect()]

    def breaks(candidates, acquired, state):
        if state["cycle"] == 2:
            raise RuntimeError("lost")
        return rounds.performance_scores(candidates, acquired, state)

    root = str(tmp_path / "run")
    with pytest.raises(RuntimeError, match="lost"):
        rounds.labelling_rounds(**args, scorer=breaks, root=root)
    for _ in range(2):
        again = rounds.labelling_rounds(**args, root=root)
        assert [tuple(v) for v in again.select(*rounds.labelling_rounds(**args).columns).orderBy("cycle").collect()] == whole
    last = spark.read.parquet(f"{root}/acquired/2").groupBy("annotator_id").count().agg(F.max("count")).first()[0]
    assert last <= 5


def test_logging_again_adds_nothing(spark, tmp_path):
    root = str(tmp_path / "log")
    runs = [("r1", 1.0), ("r2", 2.0)]
    for name, v in (runs[0], runs[0], runs[1]):
        store.log_run(spark.createDataFrame([(name, "k", "v")], "run_id string, key string, value string"), spark.createDataFrame([(name, 1, "acc", v), (name, 2, "acc", float("nan"))], "run_id string, step int, key string, value double"), root)
    got = spark.read.parquet(f"{root}/metrics").select("run_id", "step", "value").collect()
    assert sorted(map(tuple, got)) == [("r1", 1, 1.0), ("r2", 1, 2.0)] and spark.read.parquet(f"{root}/params").count() == 2


def test_files_that_are_no_images_are_errors(spark, tmp_path):
    import struct
    import zlib

    def png(w, h):
        part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
        return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + part(b"IDAT", zlib.compress((b"\0" + bytes(range(w))) * h)) + part(b"IEND", b"")

    (tmp_path / "a.png").write_bytes(png(3, 2))
    assert len(store.images(spark, str(tmp_path)).first()["x"]) == 18
    (tmp_path / "b.png").write_bytes(b"broken")
    with pytest.raises(ValueError, match=r"not an image: .*b\.png"):
        store.images(spark, str(tmp_path))


def test_signature_does_not_depend_on_order_and_sees_changes(spark, tmp_path):
    for i in range(5):
        (tmp_path / f"f{i}").write_text("x" * (i + 1))
    a = store.source_signature(spark, str(tmp_path)).first()
    assert a["files"] == 5 and a["bytes"] == 15 and a == store.source_signature(spark, str(tmp_path)).first()
    (tmp_path / "f3").write_text("other")
    assert store.source_signature(spark, str(tmp_path)).first()["signature"] != a["signature"]


@pytest.mark.parametrize("lists", ["json", "indices"])
def test_nested_json_is_flattened(spark, lists):
    rows = [(1, '{"a": {"b": {"c": 1.5, "d é": "x"}}, "l": [1, [2, 3], {"k": "v"}], "e": {}, "n": null}'), (2, "not json"), (3, None), (4, "7"), (5, '{"x":' * 4 + "1" + "}" * 4)]
    df = spark.createDataFrame(rows, "id long, j string")
    got = sorted(map(tuple, store.flat_json_params(df, "id", "j", depth=2, most=2, lists=lists).collect()))
    lists_ = [(1, "l", "[1,[2,3]]")] if lists == "json" else [(1, "l/0", "1"), (1, "l/1/0", "2"), (1, "l/1/1", "3")]
    assert got == sorted([(1, "a/b/c", "1.5"), (1, "a/b/d _", "x"), *lists_, (1, "n", "null"), (4, "", "7"), (5, "x/x/x", '{"x":1}')])
    m = df.filter("id = 1").select("id", F.create_map(F.lit("k"), F.create_map(F.lit("z"), F.lit(3))).alias("j"))
    assert [tuple(v) for v in store.flat_json_params(m, "id", "j").collect()] == [(1, "k/z", "3")]
