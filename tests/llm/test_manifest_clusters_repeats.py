"""Merkle manifest, centroid clustering and removal of repeated passages against brute force."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tallywise.llm import centroids, merkle, repeated_phrases

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row["doc_id"], row["source"], row["lang"], row["n_chars"], row["text"])))


def tree(leaves, fanout=8):
    """Root, and for each leaf its siblings as (left, right) up to the root."""
    paths, at, now = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(now) > 1:
        for path, i in zip(paths, at, strict=True):
            run = now[i // fanout * fanout : i // fanout * fanout + fanout]
            path.append(("".join(run[: i % fanout]), "".join(run[i % fanout + 1 :])))
        now = [sha("".join(now[i : i + fanout])) for i in range(0, len(now), fanout)]
        at = [i // fanout for i in at]
    return now[0], paths


def brute_manifest(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    subs, out = [], []
    for g in order:
        own = sorted(groups[g], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r)))
        subs.append((own, *tree([leaf_of(r) for r in own])))
    root, above = tree([s[1] for s in subs])
    for (own, sub, paths), top in zip(subs, above, strict=True):
        for r, path in zip(own, paths, strict=True):
            changed = dict(r)
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0 and r["text"] is not None:
                changed["text"] = re.sub("[A-Z]", lambda m: m[0].lower(), r["text"])
            now = leaf_of(changed)
            for left, right in path + top:
                now = sha(left + now + right)
            out.append((r["doc_id"], leaf_of(r), sub, root, sha("".join(x + y for x, y in path + top)), now, now == root))
    return sorted(out, key=str)


def found_manifest(df):
    return sorted(map(tuple, merkle.tampered_manifest(df).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=str)


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 9, None: 1}, {"a": 70, "b": 8, "é": 65, None: 3, "c": 513}, {f"g{i}": 1 + i % 3 for i in range(20)}])
def test_manifest_against_brute_force(docs, sizes):
    r = random.Random(3)
    rows = [(lang, None if r.random() < 0.1 else "".join(r.choice("AbCdé ") for _ in range(r.randint(0, 30)))) for lang, n in sizes.items() for _ in range(n)]
    df = docs([(i * 7 % 1009, text, lang, r.choice(["s", None, "tü"])) for i, (lang, text) in enumerate(rows)])
    assert found_manifest(df) == brute_manifest([x.asDict() for x in df.collect()])


def test_manifest_of_odd_documents(odd_docs, docs, monkeypatch):
    want = brute_manifest([x.asDict() for x in odd_docs.collect()])
    assert found_manifest(odd_docs) == want
    monkeypatch.setattr(merkle, "BROADCAST", 0)
    assert found_manifest(odd_docs) == want
    assert found_manifest(docs([])) == []
    same = docs([(1, "One text", "en")] * 100)
    assert found_manifest(same) == brute_manifest([x.asDict() for x in same.collect()])


def test_proofs_and_other_fanouts(docs):
    df = docs([(i, f"Text {i}", "ab"[i % 2]) for i in range(60)])
    got = merkle.manifest(df, ["doc_id", "text"], fanout=3).withColumn("back", merkle.folded(F.col("leaf"), F.col("proof"))).collect()
    assert len(got) == 60 and all(r["back"] == r["root"] for r in got) and {len(r["proof"]) for r in got} == {5}


def brute_clusters(rows, k=16, rounds=3):
    kept = [(i, [int(np.floor(64 * float(c))) for c in v]) for i, v in rows if v is not None and len(v) == 64 and all(c is not None and np.isfinite(c) for c in v)]
    start = sorted(kept, key=lambda r: (sha(f"1:{'' if r[0] is None else r[0]}"), r[1]))[:k]
    now = [list(v) for _, v in start]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(now))

    for _ in range(rounds):
        at = [nearest(v)[1] for _, v in kept]
        for j in range(len(now)):
            own = [v for (_, v), a in zip(kept, at, strict=True) if a == j]
            if own:
                now[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    last = [nearest(v) for _, v in kept]
    total = sum(d for d, _ in last)
    return sorted(((i, j, d, sum(x for x, y in last if y == j), total, sha(",".join(map(str, now[j])))) for (i, _), (d, j) in zip(kept, last, strict=True)), key=str)


def found_clusters(df):
    return sorted(map(tuple, centroids.clusters(df).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=str)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit(3) for c in ("v", "mark", "cluster", "distance", "size", "d", "s")}).repartition(3)


@pytest.mark.parametrize("n", [0, 1, 5, 300])
def test_clusters_against_brute_force(spark, n):
    r = np.random.default_rng(n)
    rows = [(i, [float(x) for x in r.normal(size=64).astype(np.float32)]) for i in range(n)]
    assert found_clusters(vectors(spark, rows)) == brute_clusters(rows)


def test_odd_vectors(spark):
    r = np.random.default_rng(8)
    ok = [[float(x) for x in r.integers(-3, 3, 64) / 64] for _ in range(40)]
    rows = [(i, v) for i, v in enumerate(ok)] + [(3, ok[3]), (3, ok[4]), (None, ok[5]), (None, ok[5])]
    rows += [(50, None), (51, []), (52, ok[0][:63]), (53, [*ok[0], 1.0]), (54, [float("nan"), *ok[0][1:]]), (55, [float("inf"), *ok[0][1:]]), (56, [None, *ok[0][1:]])]
    assert found_clusters(vectors(spark, rows)) == brute_clusters(rows)
    wide = [(i, [1e30 if i == 7 else float(i * 1000), *ok[i][1:]]) for i in range(20)]
    assert len(found_clusters(vectors(spark, wide))) == 20


def test_table_sums_are_squared_distances():
    r = np.random.default_rng(1)
    for spread in (3, 10**6):
        block, to = r.integers(-spread, spread, (50, 7)), r.integers(-spread, spread, (4, 7))
        assert (centroids.distances(block, to) == np.square(block[:, None] - to[None]).sum(2)).all()


def brute_repeats(rows, width=35):
    texts = [(i, WORD.findall(t or "")) for i, t in rows]
    count = {}
    for _, w in texts:
        for a in range(len(w) - width + 1):
            count[tuple(w[a : a + width])] = count.get(tuple(w[a : a + width]), 0) + 1
    out = []
    for i, w in texts:
        gone = set()
        for a in range(len(w) - width + 1):
            if count[tuple(w[a : a + width])] > 1:
                gone.update(range(a, a + width))
        out.append((i, len(w), len(gone), sha(" ".join(x for j, x in enumerate(w) if j not in gone))))
    return sorted(out, key=str)


def found_repeats(df):
    return sorted(map(tuple, repeated_phrases.repeat_report(df).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=str)


def texts_with_repeats(n=60):
    r = random.Random(9)
    words = [f"w{i}" for i in range(400)] + ["é", "Ü", "a b"]
    make = lambda k: [r.choice(words) for _ in range(k)]
    shared = [make(k) for k in (34, 35, 36, 50, 90, 400)]
    rows = []
    for i in range(n):
        w = make(r.randint(0, 60))
        for _ in range(r.randint(0, 3)):
            s = r.choice(shared)
            a = r.randint(0, len(s) - 34)
            w += s[a : a + r.randint(30, len(s))] + make(r.randint(0, 20))
        rows.append((i, r.choice([" ", "\n", " \t "]).join(w)))
    return rows


def test_repeats_against_brute_force(docs):
    rows = texts_with_repeats()
    rows += [(100, rows[7][1]), (101, " ".join(["the cat sat"] * 40)), (102, "x " * 500), (103, "x " * 35), (104, "x " * 36), (105, "ab " * 34)]
    assert found_repeats(docs(rows)) == brute_repeats(rows)


def test_frequent_anchors_are_split(docs, monkeypatch):
    monkeypatch.setattr(repeated_phrases, "SHARD", 7)
    monkeypatch.setattr(repeated_phrases, "OFTEN", 3)
    rows = texts_with_repeats(40) + [(200 + i, f"a{i % 9} " + " ".join(f"line{j}" for j in range(20)) + f" b{i % 9} " + " ".join(f"c{i % 9}_{j}" for j in range(20))) for i in range(40)]
    assert found_repeats(docs(rows)) == brute_repeats(rows)


def test_repeats_of_odd_documents(odd_docs, docs):
    assert found_repeats(odd_docs) == brute_repeats([(r["doc_id"], r["text"]) for r in odd_docs.collect()])
    assert found_repeats(docs([])) == []
    assert found_repeats(docs([(1, "short text"), (None, None)])) == brute_repeats([(1, "short text"), (None, None)])
    twice = [(1, " ".join(f"v{i}" for i in range(40)))] * 2
    assert found_repeats(docs(twice)) == brute_repeats(twice)
    kept = repeated_phrases.remove_repeats(docs([(1, "A  b\nc")])).collect()
    assert kept[0]["kept"] == "A b c"


@pytest.mark.parametrize("name", ["op11_merkle_manifest", "op12_centroids", "op13_repeated_phrases"])
def test_new_queries_against_sql(spark, sf_dir, name):
    from tallywise.llm.queries import ORACLES, QUERIES

    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    df = QUERIES[name](spark, sf_dir)
    order = sorted(df.columns)
    rel = c.sql(ORACLES[name])
    assert sorted(rel.columns) == order
    at = [rel.columns.index(x) for x in order]
    assert sorted((tuple(r[x] for x in order) for r in df.collect()), key=str) == sorted((tuple(r[i] for i in at) for r in rel.fetchall()), key=str)
