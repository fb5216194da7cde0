import hashlib
from collections import defaultdict

from tallywise.llm import exact_dedup, mixing
from tallywise.llm.common import documents


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def test_groups_against_brute_force(odd_docs):
    got = exact_dedup.exact_groups(odd_docs, support=0.2).collect()
    groups = defaultdict(list)
    for r in odd_docs.collect():
        groups[fold(r["text"])].append(r["doc_id"])
    assert len(got) == odd_docs.count()
    for text, ids in groups.items():
        rows = [r for r in got if r["text_sha256"] == hashlib.sha256(text.encode()).hexdigest()]
        assert sorted(map(str, (r["doc_id"] for r in rows))) == sorted(map(str, ids))
        top = max((i for i in ids if i is not None), default=None)
        assert {r["keep_id"] for r in rows} == {top} and {r["group_size"] for r in rows} == {len(ids)}
        assert [r["doc_id"] for r in rows if r["kept"]] == [top]


def test_heavy_and_ordinary_paths_agree(docs):
    rows = [(i, "same" if i % 3 else f"text {i % 40}") for i in range(400)]
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(exact_dedup.exact_groups(docs(rows), support=0.01)) == key(exact_dedup.exact_groups(docs(rows, 7), support=0.9))


def test_drop_keeps_one_of_each(odd_docs):
    kept = exact_dedup.drop_exact_copies(odd_docs)
    assert kept.columns == odd_docs.columns
    texts = [fold(r["text"]) for r in kept.collect()]
    assert len(texts) == len(set(texts)) == len({fold(r["text"]) for r in odd_docs.collect()})


def test_empty_table(docs):
    assert exact_dedup.exact_groups(docs([])).count() == 0
    assert mixing.mix_sources(docs([])).count() == 0
    assert mixing.mixed_documents(docs([])).count() == 0


def fill(sizes, max_epochs=3):
    """Water-filling round by round: sources in code-point order, the null one last."""
    names = sorted(k for k in sizes if k is not None) + [k for k in sizes if k is None]
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    left, free, out = float(sum(sizes.values())), set(names), {}
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > max_epochs * sizes[s]]
        if not over:
            return out | {s: left * weight[s] / total for s in free}
        for s in over:
            out[s] = float(max_epochs * sizes[s])
        left -= sum(out[s] for s in over)
        free -= set(over)
    return out


def test_targets_and_taken_words(spark, sf_dir, docs):
    rows = [(i, " ".join(["w"] * (1 + i * 7 % 50)), None, [None, "a", "b", "B", "é"][min(4, i * i % 11 // 2)]) for i in range(600)]
    df = docs(rows)
    got = mixing.mix_sources(df).collect()
    source = {i: s for i, _, _, s in rows}
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in got:
        sizes[source[r["doc_id"]]] += r["size"]
        taken[source[r["doc_id"]]] += r["taken"]
        assert 0 <= r["taken"] <= 3 * r["size"]
    want = fill(sizes)
    for r in got:
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[s] and abs(r["target"] - want[s]) < 1e-6
    assert all(abs(taken[s] - want[s]) <= 51 for s in sizes)
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix_sources(df.repartition(5)).collect()))
    copies = {r["doc_id"]: r["copies"] for r in got}
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    assert {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()} == {k: v for k, v in copies.items() if v}


def test_odd_documents_mix(odd_docs):
    got = mixing.mix_sources(odd_docs).collect()
    assert len(got) == odd_docs.count()
    assert all(r["size"] == 0 and r["taken"] == 0 for r in got if r["doc_id"] in (3, 4, 5))


def test_documents_without_words_have_no_more_copies_than_epochs(docs):
    rows = [(i, None if i % 2 else "", None, "a") for i in range(8)] + [(10 + i, "w " * 9, None, "a") for i in range(2)] + [(20 + i, "w " * 900, None, "b") for i in range(40)]
    assert max(r["copies"] for r in mixing.mix_sources(docs(rows)).collect()) <= 3


def test_repeated_ids_are_mixed_each(docs):
    rows = [(i % 5 if i % 7 else None, " ".join(["w"] * (1 + i * 7 % 50)) if i % 4 else "same text", None, "ab"[i % 3 > 0]) for i in range(300)]
    df = docs(rows)
    got = mixing.mix_sources(df).collect()
    assert len(got) == len(rows)
    copies = sum(r["copies"] for r in got)
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns and out.count() == copies
    words = sum(len(r["text"].split()) for r in out.collect())
    assert words == sum(r["taken"] for r in got) and abs(words - sum(len(t.split()) for _, t, *_ in rows)) <= 4


def test_sources_come_near_their_targets(spark):
    d = documents(spark, "/root/testdata/sf0.01")
    rows = mixing.mix_sources(d).join(d.select("doc_id", "source"), "doc_id").groupBy("source").agg({"taken": "sum", "target": "max", "size": "min"}).collect()
    assert all(abs(r["sum(taken)"] - r["max(target)"]) <= max(20, 0.01 * r["max(target)"]) for r in rows)


def test_nothing_to_take(docs):
    assert [r["taken"] for r in mixing.mix_sources(docs([(1, None), (2, "")])).collect()] == [0, 0]


def test_on_the_test_tables(spark, sf_dir):
    d = documents(spark, sf_dir)
    assert exact_dedup.exact_groups(d).count() == d.count() == mixing.mix_sources(d).count()
