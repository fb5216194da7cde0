import hashlib
from collections import Counter

import corpus_pipeline
from tallywise.llm import language_id, mixing, sentencepiece
from tallywise.llm.common import documents

from test_exact_and_mix import fold
from test_joins import brute


def test_run_against_brute_force(spark, sf_dir):
    docs = documents(spark, sf_dir).collect()
    pred = {r["doc_id"]: r for r in language_id.languages(documents(spark, sf_dir)).collect()}
    kept = [d for d in docs if pred[d["doc_id"]]["lang_pred"] != "und" and pred[d["doc_id"]]["score"] >= 0.35]
    best = {}
    for d in kept:
        key = hashlib.sha256(fold(d["text"]).encode()).hexdigest()
        best[key] = max(best.get(key, -1), d["doc_id"])
    kept = [d for d in kept if d["doc_id"] in set(best.values())]
    groups = brute([(d["doc_id"], d["text"]) for d in kept], 5, 80)
    kept = [d for d in kept if groups[d["doc_id"]][1] == d["doc_id"]]
    mixed = mixing.mix_sources(spark.createDataFrame(kept, documents(spark, sf_dir).schema)).collect()
    want = Counter({r["doc_id"]: r["copies"] for r in mixed if r["copies"]})
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert Counter(r["doc_id"] for r in got) == want
    from sentencepiece import SentencePieceProcessor

    lib, text = SentencePieceProcessor(model_file=sentencepiece.MODEL), {d["doc_id"]: d["text"] for d in kept}
    assert all(list(r["tokens"]) == lib.encode(text[r["doc_id"]]) for r in got[:50])


def test_odd_and_repeated_rows_through_all_stages(spark, docs, monkeypatch):
    """Nulls, repeated rows and ids, blank and long texts; every stage by its rule on what the one before kept."""
    base = " ".join(f"palabra{i % 211} del" for i in range(3000))
    rows = [(i, f"una frase corta numero {'x' * (i % 9)} de prueba con letras {i % 7}", "es", "ab"[i % 2]) for i in range(40)]
    rows += [(50, base, "es", "a"), (51, base + " fin", "es", "b"), (52, base.upper(), "es", None), (7, "otro texto bajo el mismo numero", "es", "a"), (None, "sin numero", None, None)]
    rows += [(60, None, "es", "a"), (61, "", None, "b"), (62, " \n\t", "es", "a"), (63, "123 !!", "es", "a"), (50, base, "es", "a"), (64, "漢字" * 400, "zh", "b"), (65, "漢字" * 400, "zh", "b")]
    at = docs(rows)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, at, None)
        before, after = [tuple(r) for r in at.collect()], out.collect()
        if name == "language ID":
            assert all(any(c.isalpha() for c in r["text"]) for r in after)
        elif name == "exact dedup":
            best = {}
            for r in at.collect():
                best[fold(r["text"])] = max(best.get(fold(r["text"]), -1), -1 if r["doc_id"] is None else r["doc_id"])
            assert sorted((fold(r["text"]), -1 if r["doc_id"] is None else r["doc_id"]) for r in after) == sorted(best.items())
        elif name == "n-gram Jaccard join":
            texts = [(i, r["text"]) for i, r in enumerate(at.collect())]
            assert len(after) == len({g for _, g in brute(texts, 5, 80).values()})
        elif name == "mixing":
            assert {tuple(r) for r in after} <= set(before) and Counter(tuple(r) for r in after).most_common(1)[0][1] <= 3
        else:
            assert len(after) == len(before) and all(r["n_tokens"] == len(r["tokens"]) for r in after)
        if name != "SentencePiece":
            assert out.columns == at.columns
            at = spark.createDataFrame(after, at.schema)


def test_stages_keep_the_columns(spark, sf_dir):
    docs = documents(spark, sf_dir)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns
    assert len(corpus_pipeline.STAGES) == 5


def test_stages_take_an_empty_table(spark, sf_dir):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, documents(spark, sf_dir).limit(0), sf_dir).count() == 0
