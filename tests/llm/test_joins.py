import re
import struct
from itertools import combinations

import pytest
import xxhash

from tallywise.llm import ngram_join, order_minhash
from tallywise.llm.common import documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sets_of(rows, n):
    out = {}
    for i, text in rows:
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        out[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    return out


def brute(rows, n, percent):
    sets = sets_of(rows, n)
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def found(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


def corpus(n_groups=12, copies=9):
    import random

    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)]
    shared = [r.choice(vocabulary) for _ in range(60)]
    rows, i = [], 0
    for g in range(n_groups):
        base = [r.choice(vocabulary) for _ in range(r.randint(3, 120))] + (shared if g % 2 else [])
        for c in range(copies):
            w = list(base)
            for _ in range(c // 2):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            rows.append((i, " ".join(w)))
            i += 1
    return rows


@pytest.mark.parametrize(("n", "percent", "costly", "warm", "dear"), [(3, 90, 50, 17, 200), (3, 90, 2, 2, 3), (5, 80, 50, 17, 200), (5, 80, 3, 2, 5)])
def test_components_against_brute_force(docs, monkeypatch, n, percent, costly, warm, dear):
    monkeypatch.setattr(ngram_join, "WARM", warm)
    monkeypatch.setattr(ngram_join, "DEAR", dear)
    rows = corpus()
    assert found(ngram_join.jaccard_groups(docs(rows), n, percent, costly=costly)) == brute(rows, n, percent)


def test_repeated_ids_with_other_texts(docs):
    a, b = [f"a{i}" for i in range(60)], [f"b{i}" for i in range(60)]
    rows = [(5, " ".join(a)), (5, " ".join(b)), (7, " ".join([*b, "x"])), (8, " ".join([*a, "x"])), (9, " ".join(b)), (None, " ".join([*a, "y"])), (3, "alone"), (3, " ".join([*b, "x"])), (None, "nobody else")]
    got = sorted(map(tuple, ngram_join.jaccard_groups(docs(rows), 3, 90).collect()), key=str)
    want = [(5, 58, 5), (5, 58, 3), (7, 59, 3), (8, 59, 5), (9, 58, 3), (None, 59, 5), (3, 1, 3), (3, 59, 3), (None, 1, None)]
    assert got == sorted(want, key=str)
    kept = sorted((r["doc_id"] or -1, r["text"]) for r in ngram_join.drop_near_copies(docs([*rows, rows[6], (4, None), (4, None)]), 3, 90).collect())
    assert kept == sorted([(5, rows[0][1]), (3, rows[7][1]), (3, "alone"), (-1, "nobody else"), (4, None), (4, None)], key=lambda r: (r[0], r[1] or ""))


def test_random_repeated_ids_against_brute_force(docs):
    import random

    r = random.Random(11)
    rows = [(r.randrange(40), t) for _, t in corpus(8, 9)]
    texts = sorted({t for _, t in rows})
    group = brute(list(enumerate(texts)), 3, 90)
    least = {}
    for i, t in rows:
        g = group[texts.index(t)][1]
        least[g] = min(least.get(g, 99), i)
    want = sorted((i, group[texts.index(t)][0], least[group[texts.index(t)][1]]) for i, t in rows)
    assert sorted(map(tuple, ngram_join.jaccard_groups(docs(rows), 3, 90).collect())) == want


@pytest.mark.parametrize("most", [1 << 20, 0])
def test_large_groups_of_near_copies(docs, monkeypatch, most):
    import random

    monkeypatch.setattr(ngram_join, "COSTLY_MOST", most)
    r = random.Random(2)
    rows = []
    for g in range(3):
        base, other = ([f"{x}{g}_{i}" for i in range(80)] for x in "no")
        for c in range(40):
            w = list(base)
            w[r.randrange(80)] = f"c{g}_{c % 25}"
            if c % 3 == 0:
                w[r.randrange(80)] = f"d{g}_{c % 11}"
            rows.append((len(rows), " ".join(w)))
        rows.append((len(rows), " ".join(base[:40] + other[:40])))
    assert found(ngram_join.jaccard_groups(docs(rows), 3, 90, costly=4)) == brute(rows, 3, 90)


def test_joined_ids_beyond_the_bound(docs, monkeypatch):
    monkeypatch.setattr(ngram_join, "IDS_MOST", 3)
    rows = corpus(4, 5)
    assert found(ngram_join.jaccard_groups(docs(rows), 3, 90)) == brute(rows, 3, 90)


def test_odd_documents(odd_docs):
    got = ngram_join.jaccard_groups(odd_docs, 3, 90).collect()
    assert len(got) == odd_docs.count()
    by = {r["doc_id"]: r for r in got}
    assert by[1]["component_id"] == by[2]["component_id"] == 1
    assert all(by[i]["n_shingles"] == 0 and by[i]["component_id"] == i for i in (3, 4, 5, 6))


def test_empty_and_drop(docs):
    assert ngram_join.jaccard_groups(docs([]), 3, 90).count() == 0
    rows = corpus(5, 4)
    kept = ngram_join.drop_near_copies(docs(rows), 3, 90)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, (_, c) in brute(rows, 3, 90).items() if i == c)


def xx(data, seed):
    h = xxhash.xxh64_intdigest(data, seed)
    return h - (1 << 64) if h >> 63 else h


def chain(values, form="<q"):
    seed = 42
    for v in values:
        seed = xx(struct.pack(form, v) if isinstance(v, int) else v, seed & (2**64 - 1))
    return seed


def points(text, k=3):
    """(hash, position) of every numbered k-mer; the upper 38 bits of the hash count."""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    h = [chain([w.encode()]) for w in words]
    kmers = [chain(h[i : i + k]) for i in range(max(len(h) - k + 1, min(len(h), 1)))]
    seen, found = {}, []
    for i, x in enumerate(kmers):
        key = x >> 26
        o = seen[key] = seen.get(key, -1) + 1
        v = xx(struct.pack("<i", o), chain([key]) & (2**64 - 1)) if o else x
        found.append(((v >> 26) << 26, i))
    return sorted(found)


def signature(text, k=3, length=2, bits=5):
    found, out = points(text, k), []
    for b in range(1 << bits) if found else ():
        start = (b << (64 - bits)) - (1 << 63)
        circle = sorted(found, key=lambda e: ((e[0] - start) % (1 << 64), e[1]))
        some = sorted(circle[:length], key=lambda e: e[1])
        out.append((b << 32) | (chain([((v & (2**64 - 1)) >> 27) & (2**37 - 1) for v, _ in some]) & 0xFFFFFFFF))
    return out


def test_fingerprints_against_brute_force(spark, sf_dir, docs):
    from pyspark.sql import functions as F

    rows = [(i, t) for i, t in enumerate(["", "a", "a b", "a b c", "b a c", "a b c d", "x " * 50, "x y " * 40, None, "the cat sat on the mat " * 9])]
    rows += [(100 + r["doc_id"], r["text"]) for r in documents(spark, sf_dir).limit(60).collect()]
    got = {r["doc_id"]: list(r["fp"]) for r in order_minhash.with_fingerprint(docs(rows), F.col("text"), "fp").collect()}
    assert got == {i: signature(t) for i, t in rows}
    other = {r["doc_id"]: list(r["fp"]) for r in order_minhash.with_fingerprint(docs(rows), F.col("text"), "fp", k=2, length=3, bin_bits=3).collect()}
    assert other == {i: signature(t, 2, 3, 3) for i, t in rows}


@pytest.mark.parametrize("n", [12, 20, 52, 250])
def test_swapped_halves_are_as_unlike_as_by_separate_orders(docs, n):
    import random

    r = random.Random(n)
    texts = [[f"w{r.randrange(10**6)}" for _ in range(n)] for _ in range(60)]
    rows = [(i, " ".join(w)) for i, w in enumerate(texts)] + [(100 + i, " ".join(w[n // 2 :] + w[: n // 2])) for i, w in enumerate(texts)]
    got = {x["doc_id"]: set(x["fp"]) for x in order_minhash.fingerprints(docs(rows)).collect()}
    dealt = sum(len(got[i] & got[100 + i]) for i in range(60)) / 60 / 32

    def separate(words, seed):
        kmers = [(xx(" ".join(words[i : i + 3]).encode(), seed), i) for i in range(n - 2)]
        return [v for v, _ in sorted(sorted(kmers)[:2], key=lambda e: e[1])]

    want = sum(separate(w, s) == separate(w[n // 2 :] + w[: n // 2], s) for w in texts for s in range(32)) / 60 / 32
    assert abs(dealt - want) < 0.06


def test_edited_texts_and_next_documents(docs):
    import hashlib

    rows = [(i * 3 % 17, " ".join(f"{'é' if j % 5 == 0 else 'w'}{(i * j) % 23}" for j in range(5 + i * 4))) for i in range(17)] + [(40, None), (41, ""), (42, "é")]
    got = {r["doc_id"]: r for r in order_minhash.edited_likeness(docs(rows)).collect()}
    text, order = {i: t or "" for i, t in rows}, sorted((i for i, _ in rows), reverse=True)
    as_text = lambda f: "".join(f"{v & 0xFFFFFFFF:08x}" for v in f)
    assert len(got) == len(rows)
    for at, i in enumerate(order):
        nxt = order[(at + 1) % len(order)]
        n = len(text[i])
        edited = text[i][: n - n // 3] + text[nxt][: n // 3]
        r = got[i]
        assert r["n_chars"] == n and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == as_text(signature(text[i])) and r["edited_fingerprint"] == as_text(signature(edited))
        for name, other in (("near_edited", signature(edited)), ("near_next", signature(text[nxt]))):
            own = signature(text[i])
            assert r[name] == pytest.approx(len(set(own) & set(other)) / 32 if own or other else 1.0)


def test_odd_documents_have_fingerprints(odd_docs, docs):
    got = order_minhash.edited_likeness(odd_docs).collect()
    assert len(got) == odd_docs.count()
    assert sorted(r["near_next"] for r in got if r["doc_id"] == 2)[1] == 1.0  # after a repeated row comes the same text
    assert all(0 <= r["near_edited"] <= 1 for r in got)
    assert order_minhash.edited_likeness(docs([])).count() == 0
    again = order_minhash.edited_likeness(docs([(1, "abcdef"), (1, "abcdef"), (1, "abcdef"), (None, None), (None, None)])).collect()
    assert len(again) == 5 and sum(r["near_next"] == 1.0 for r in again) == 3
    alone = order_minhash.edited_likeness(docs([(1, "only one text here")])).collect()
    assert alone[0]["near_next"] == 1.0
