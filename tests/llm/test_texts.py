import io
import random
import struct
import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallywise.llm import html_extract, sentencepiece, warc
from tallywise.llm.common import documents


@pytest.fixture(scope="module")
def vocabulary():
    return sentencepiece.load()


def test_ids_are_those_of_the_library(spark, sf_dir, vocabulary):
    from sentencepiece import SentencePieceProcessor

    lib, r = SentencePieceProcessor(model_file=sentencepiece.MODEL), random.Random(3)
    texts = ["", "  a", "Hello  world\n\tÉa 漢字😀 ▁x ", "   ", "a" * 500, " " * 40 + "b" + " " * 7, "naïve — “quotes” ½", "\u0000\u0001x"]
    texts += ["".join(r.choice("abcdefgh   ieéñ漢 \n.,THEing tion") for _ in range(r.randint(1, 60))) for _ in range(800)]
    texts += [x["text"] for x in documents(spark, sf_dir).limit(100).collect()]
    ids, bounds = sentencepiece.Encoder(vocabulary).encode(pa.array(texts, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == lib.encode(texts)
    back = sentencepiece.decode_ids(vocabulary, ids, bounds)
    assert all(b == t for b, t in zip(back, texts, strict=True) if sentencepiece.MARK not in t)


@pytest.mark.parametrize("unit", ["a", "é", "=", "ab", "hello", "漢", "字典", "\u0001x", "Zz9+", "the"])
def test_unbroken_texts(vocabulary, monkeypatch, unit):
    import time

    from sentencepiece import SentencePieceProcessor

    lib = SentencePieceProcessor(model_file=sentencepiece.MODEL)
    monkeypatch.setattr(sentencepiece.Vocabulary, "merged", None)
    text = "x" + unit * (100_000 // len(unit.encode()))
    began = time.time()
    ids, _ = sentencepiece.Encoder(vocabulary).encode(pa.array([text]))
    assert time.time() - began < 5
    assert ids.tolist() == lib.encode(text)


def test_long_chunks_of_mixed_signs(vocabulary):
    from sentencepiece import SentencePieceProcessor

    lib, r = SentencePieceProcessor(model_file=sentencepiece.MODEL), random.Random(8)
    texts = ["".join(r.choice("ABCDEFabcdef0123456789+/") for _ in range(20_000)), "".join(r.choice("的一是了我不人在他有這") for _ in range(7_000))]
    texts += ["".join(r.choice(["a" * r.randint(1, 700), "-" * r.randint(1, 900), "tion", "é漢", "ing"]) for _ in range(60)) for _ in range(12)]
    ids, bounds = sentencepiece.Encoder(vocabulary).encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == lib.encode(texts)


def test_what_does_not_decode_to_the_text_is_told(vocabulary):
    import hashlib

    texts = ["one ▁ two", "same", None, " lead", "▁"]
    ids, bounds = sentencepiece.Encoder(vocabulary).encode(pa.array(texts, pa.string()))
    digests, exact = sentencepiece.verified(vocabulary, ids, bounds, pa.array(texts, pa.string()))
    assert exact.tolist() == [False, True, True, True, False]
    assert digests == [hashlib.sha256((t or "").replace("▁", " ").encode()).hexdigest() for t in texts]


def test_tokens_of_odd_documents(spark, odd_docs, docs):
    got = sentencepiece.encode(odd_docs, check=True).collect()
    assert len(got) == odd_docs.count() and all(r["exact"] for r in got)
    assert all(r["n_tokens"] == len(r["tokens"]) for r in got)
    assert {r["doc_id"] for r in got if not r["tokens"]} == {3, 4, 6}
    back = sentencepiece.decode(sentencepiece.encode(odd_docs))
    assert sorted(map(str, back.collect())) == sorted(map(str, odd_docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect()))
    assert sentencepiece.encode(docs([])).count() == 0
    assert sentencepiece.decode(spark.createDataFrame([(1, None)], "doc_id long, tokens array<int>")).collect()[0]["text"] == ""


def page_rows(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("host", "shard", "h", "shards", "sha", "n", "p", "s", "refers_to", "text", "n_chars", "package")})


PAGE = """<html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body><header><h2>Site</h2></header><nav><ul><li>Home<li>News</ul></nav>
<div class="cookie-notice">We use cookies</div><!-- <p>no</p> --><article class="post"><h1>Big&amp;small</h1><p>One
 two&nbsp;three <b>bold</b><br>four<p class="ad">Buy!</p><ul><li>x<li>y</ul><form><input><p>sign up</p></form><section id="comments"><p>first!</p></section></article>
<aside>side</aside><div hidden>gone</div><footer>&copy; me</footer></body></html>"""


def test_markup_decides(spark):
    rows = [(1, "http://h.example/a", PAGE), (2, None, None), (3, "x", ""), (4, "http://h.example/b", "just text &lt;b&gt; &#233;"), (4, "http://h.example/b", "just text &lt;b&gt; &#233;"), (None, "u", "<p>open <b>ended"), (5, "u", "<div><nav>menu<article><p>still here</article>")]
    got = html_extract.extract(page_rows(spark, rows)).collect()
    assert len(got) == len(rows)
    text = {r["page_id"]: r["text"] for r in got}
    assert text[1] == "Big&small\nOne two three bold four\nx\ny"
    assert text[2] == text[3] == "" and text[4] == "just text <b> é" and text[None] == "open ended" and text[5] == "still here"
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert html_extract.extract(page_rows(spark, [])).count() == 0


def test_repeats_go_where_markup_is_silent(spark):
    top, foot = "Home About Contact us today for more information now", "All rights reserved by the great company of this town"
    rows = [(i, f"http://h.example/{i}", f"<div>{top}</div><div>Unique story {i} told by {i * 7} people</div><div>{foot}</div>") for i in range(150)]
    got = {r["page_id"]: r["text"] for r in html_extract.extract(page_rows(spark, rows)).collect()}
    assert all(top not in t and foot not in t and f"{i}" in t for i, t in got.items())
    declared = [(i, f"http://k.example/{i}", f"<article><p>{top}</p></article>") for i in range(20)]
    assert {r["text"] for r in html_extract.extract(page_rows(spark, declared)).collect()} == {top}


@pytest.mark.parametrize(
    ("html", "want"),
    [
        *[(f"<body><nav>menu</nav><div {w}><article><p>the text</p></article></div></body>", "the text") for w in ("class='layout has-sidebar'", "class=no-sidebar", "class='post with-comments'", "id='page-widget'", "class='widget sidebar'", "id=content-menu")],
        ("<div class='sidebar'><main><div class=widget><article>the text</article></div></main></div>", "the text"),
        ("<article><h2 id='related-work'>Related work</h2><h3 class=share id=search>Search</h3><section id='search'><p>how to</p></section><div class='social-science'>x</div></article>", "Related work\nSearch\nhow to\nx"),
        ("<article><p>so <math><mi>a</mi><mo>+</mo><mi>b</mi></math> <button>press</button> <object data=x>fall back</object></p></article>", "so a+b press fall back"),
        ("<article><p>a</p><div class='ad'>Buy</div><section class='comments'><article>first!</article></section><div class=sidebar><article>teaser</article></div><p>b</p></article>", "a\nb"),
        ("<article><p>a</p></article><div class='related'><article>other</article></div><section id=comments><article>first!</article></section>", "a"),
        ("<div>the story</div><div class=comments><article>first!</article></div><div class='site-footer'>us</div>", "the story"),
        ("<div class=sidebar hidden><article>gone</article></div><p>here</p>", "here"),
        *[(f"<article>{x}</article>", "kept") for x in ("<p class='comment'>kept</p>", "<table class=share><tr><td>kept</table>", "<div class=login><p>kept</p></div>", *[f"<div class={n}>kept</div>" for n in ("social", "search", "skip", "promo", "notice", "related")])],
        ("<article><p>a</p><ol class='commentlist'><li>first!</ol><section class='comments-area'><p>me too</p></section><span class=ad>Buy</span><p>b</p></article>", "a\nb"),
        ("<article><p>a <svg><title>t</title><text>drawn</text><p>b</p><p>c</p></article>", "a\nb\nc"),
        ("<article><p>a <svg><svg><text>x</text></svg><text>y</text></svg> b</p><video>no <canvas>film</video><p>c</p></article>", "a b\nc"),
        ("<article><div>a <audio>b</div><p>c</p><noscript><p>d</p></noscript><p>e <span hidden>f</span> g <select><option>h</select></p><template><p>i</p></template></article>", "a\nc\nd\ne g"),
        ("<div>story <button>press</div><p>more</p><canvas>x</div>", "story\nmore"),
    ],
)
def test_names_are_whole_and_end_at_an_article(html, want):
    blocks = html_extract.page_blocks(html)
    kinds = {kind for kind, *_ in blocks}
    assert "\n".join(t for kind, _, t in blocks if kind == (html_extract.MAIN if html_extract.MAIN in kinds else html_extract.OPEN)) == want


def test_deep_and_long_pages_take_linear_time():
    import time

    began = time.time()
    deep = html_extract.page_blocks("<div>" * 60_000 + "the text" + "</div>" * 60_000 + "<b>" * 60_000 + "more" + "</i>" * 60_000)
    assert [t for *_, t in deep] == ["the text", "more"]
    long = html_extract.page_blocks("<article>" + "<p>some words here</p>" * 100_000 + "</article>")
    assert len(long) == 100_000 and time.time() - began < 20


@pytest.mark.parametrize("most", [200_000, 0])
def test_repeats_count_over_the_whole_host(spark, monkeypatch, most):
    monkeypatch.setattr(html_extract, "HOSTS_MOST", most)
    monkeypatch.setattr(html_extract, "RUNS_MOST", most)
    few, half = "A notice that stands on only twenty pages of this host", "Another menu that is found on twelve of a hundred pages"
    rare = "Six pages of the host tell this in just these words"
    rows = []
    for i in range(1000):
        # declared pages count too
        notes = [few] * (i % 50 == 0) + [half] * (i % 25 in (1, 2, 3)) + [rare] * (i % 160 == 5 and i < 960)
        body = f"<div>{i} people know story {i * 7}</div>"
        rows.append((i, f"http://h.example/{i}", "".join(f"<div>{n}</div>" for n in notes) + (f"<article>{body}</article>" if i % 100 == 0 else body)))
    rows += [(2000 + i, f"http://g.example/{i}", f"<div>{few}</div>") for i in range(2)]
    got = {r["page_id"]: r["text"] for r in html_extract.extract(page_rows(spark, rows).repartition(7)).collect()}
    assert sum(rare in t for t in got.values()) == 6  # fewer pages than PAGES
    for i in range(1000):
        assert few not in got[i] and half not in got[i] and f"{i} people know story {i * 7}" in got[i]
    assert got[2000] == got[2001] == few


def test_one_threshold_at_every_size_of_a_host(spark):
    note = "a quotation of quite a few words stands here"
    for pages in (10, 400):
        rows = [(i, f"http://h.example/{i}", f"<div>{i} tells story {i * 3}</div>" + f"<div>{note}</div>" * (i < 8)) for i in range(pages)]
        for least in (8, 9):
            got = [r["text"] for r in html_extract.extract(page_rows(spark, rows), least_pages=least).collect()]
            assert sum(note in t for t in got) == (8 if least == 9 else 0)


def test_covered_tokens_against_brute_force():
    import numpy as np

    r = np.random.default_rng(1)
    for _ in range(30):
        page = np.sort(r.integers(0, 6, 200))
        tokens = r.integers(0, 4, 200).astype(np.uint64)
        want, runs = np.zeros(200, bool), {}
        for i in range(200 - html_extract.RUN + 1):
            if page[i] == page[i + html_extract.RUN - 1]:
                runs.setdefault(tuple(tokens[i : i + html_extract.RUN]), []).append(i)
        for at in runs.values():
            if len({page[i] for i in at}) >= 3:
                for i in at:
                    want[i : i + html_extract.RUN] = True
        assert (html_extract.covered(tokens, page, 3) == want).all()


@pytest.mark.parametrize("most", [200_000, 0])
def test_declared_pages_are_counted_too(spark, monkeypatch, most):
    monkeypatch.setattr(html_extract, "HOSTS_MOST", most)
    monkeypatch.setattr(html_extract, "RUNS_MOST", most)
    note = "ten words that every page of the host says here"
    rows = [(i, f"http://{'h' if i < 30 else 'k'}{i // 37}.example/{i}", f"<nav>{note}</nav><article><p>{i} tells {i * 7}</p><p>{note}</p><p>{note} {i}</p></article>") for i in range(40)]
    got = html_extract.extract(page_rows(spark, rows).repartition(5)).collect()
    assert len(got) == 40
    for r in got:
        i = r["page_id"]
        assert r["text"] == f"{i} tells {i * 7}\n{note}\n{note} {i}"  # markup is believed
        assert r["n_repeated"] == (20 if i < 30 else 0)  # the last hosts have fewer pages than PAGES


def test_filter_passes_every_boilerplate_run(monkeypatch):
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(html_extract, "HELD", 500)
    r = np.random.default_rng(2)
    notes = [" ".join(map(str, r.integers(0, 10**6, 12))) for _ in range(30)]
    html = ["".join(f"<p>{notes[j]}</p>" for j in r.integers(0, 30, 4)) + f"<p>{' '.join(map(str, r.integers(0, 10**6, 30)))}</p>" for _ in range(200)]
    batches = [pa.RecordBatch.from_arrays([pa.array(html[a : a + 16]), pa.array([f"h{i % 3}" for i in range(a, min(200, a + 16))])], ["html", "host"]) for a in range(0, 200, 16)]
    pages = {}
    for n, (_, stream, host) in enumerate(html_extract._streams(iter(batches))):
        at, keys = stream.runs(host)
        for k, p in zip(keys, stream.page[at], strict=True):
            pages.setdefault(int(k), set()).add((n, int(p)))
    lots = list(html_extract._cells(8)(iter(batches)))
    assert len(lots) > 1
    cells = np.concatenate([html_extract._unpacked(x) for x in lots])
    assert sorted(cells.tolist()) == sorted(k >> 28 for x in batches for _, s, h in html_extract._streams(iter([x])) for k, n in _pages_of(s, h).items() for _ in range(min(8, n)))
    table = pa.Table.from_batches(lots).sort_by("piece")
    bits = np.zeros((1 << html_extract.PIECE, 1 << (html_extract.TOLD - html_extract.PIECE - 3)), np.uint8)
    for batch in html_extract._often_cells(8)(iter(table.to_batches(max_chunksize=7))):
        for k, b in zip(*(batch.column(c).to_pylist() for c in ("piece", "bits")), strict=True):
            assert not bits[k].any()  # a piece comes once
            bits[k] = np.frombuffer(b, np.uint8)
    every = np.array(list(pages), np.uint64)
    want = np.array([len(pages[int(k)]) >= 8 for k in every])
    passed = html_extract._told(every, bits.ravel())
    assert want.sum() > 100 and passed[want].all() and (passed & ~want).sum() <= 2


def _pages_of(stream, host):
    """How many pages have each run."""
    found = {}
    at, keys = stream.runs(host)
    for k, p in zip(keys, stream.page[at], strict=True):
        found.setdefault(int(k), set()).add(int(p))
    return {k: len(p) for k, p in found.items()}


def test_packages_are_zips():
    members = [("archive/a", b"x" * 1000), ("indexes/b", b"")]
    for zip64 in (False, True):
        data = warc.zip_stored(members, zip64)
        assert {i.filename: zipfile.ZipFile(io.BytesIO(data)).read(i) for i in zipfile.ZipFile(io.BytesIO(data)).infolist()} == dict(members)
        reads = []
        found = warc.zip_members(lambda at, n, d=data: reads.append(n) or d[at : at + n], len(data))
        assert {k: data[a : a + n] for k, (a, n) in found.items()} == dict(members)
    other = io.BytesIO()
    with zipfile.ZipFile(other, "w", zipfile.ZIP_STORED) as z:
        z.writestr("one", b"abc")
    data = other.getvalue()
    (at, n), = warc.zip_members(lambda a, k: data[a : a + k], len(data)).values()
    assert data[at : at + n] == b"abc"
    with pytest.raises(ValueError, match="not a ZIP"):
        warc.zip_members(lambda a, n: b"nothing at all here to be found"[a : a + n], 31)


def test_archived_pages(spark, tmp_path):
    rows = [(5, "http://a b/\r\n", "<p>é</p>"), (3, "u", "<p>é</p>"), (9, None, "<p>é</p>"), (1, "v", None), (2, "w", ""), (7, "x", "alone"), (7, "x", "alone"), (None, "y", "alone")]
    got = sorted(map(tuple, warc.archived_pages(page_rows(spark, rows)).collect()), key=str)
    dig = lambda t: warc.payload_digest((t or "").encode())
    want = [(5, 9, dig(rows[0][2]), "revisit", 3), (3, 9, dig(rows[0][2]), "response", None), (9, 9, dig(rows[0][2]), "revisit", 3), (1, 0, dig(""), "response", None), (2, 0, dig(""), "revisit", 1)]
    want += [(7, 5, dig("alone"), "response", None)] * 2 + [(None, 5, dig("alone"), "revisit", 7)]
    assert got == sorted(want, key=str)
    assert dig("") == "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ"
    assert warc.archived_pages(page_rows(spark, [])).count() == 0
    assert {r["record_type"] for r in warc.archived_pages(page_rows(spark, rows[:3]), min_bytes=10).collect()} == {"response"}
    package = warc.write_packages(page_rows(spark, rows)).first()["package"]
    (tmp_path / "p.wacz").write_bytes(package)
    payloads = {r["payload"].decode() for r in warc.read_package_files(spark, str(tmp_path)).collect()}
    assert "<p>é</p>" in payloads or "alone" in payloads


def foreign(url, body):
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + body
    return f"WARC/1.0\r\nwarc-type:response\r\nWARC-Target-URI: {url}\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def test_packages_of_other_writers(spark, tmp_path):
    import gzip
    import json

    bodies = {c: c.encode() * 5000 + b"\r\n\r\n" for c in "abcdefg"}
    records = {c: foreign(f"http://h/{c}", b) for c, b in bodies.items()}
    packed = {c: gzip.compress(r) for c, r in records.items()}
    at = lambda parts: [sum(map(len, parts[:i])) for i in range(len(parts))]
    one, two = [packed["a"], packed["b"]], [packed["c"], packed["d"]]
    line = lambda c, o, n, f: f"h)/{c} 20200101000000 " + json.dumps({"url": f"http://h/{c}", "offset": str(o), "length": str(n), "filename": f, "note": "{"})
    index = ["!meta 0 {\"format\": \"x\"}", *(line(c, o, len(packed[c]), "one.warc.gz") for c, o in zip("ab", at(one), strict=True)), ""]
    other = [line(c, o, len(packed[c]), "archive/two.warc.gz") for c, o in zip("cd", at(two), strict=True)]
    members = [("archive/one.warc.gz", b"".join(one), 0), ("archive/two.warc.gz", b"".join(two), 0), ("archive/three.warc", records["e"] + records["f"], 0), ("archive/four.warc.gz", packed["g"] * 2, 0)]
    members += [("indexes/index.cdxj", "\n".join(index).encode(), zipfile.ZIP_DEFLATED), ("indexes/more.cdx.gz", gzip.compress("\n".join(other).encode()), 0), ("pages/pages.jsonl", b"{}" * 900, zipfile.ZIP_DEFLATED), ("datapackage.json", b"{}", zipfile.ZIP_DEFLATED)]
    with zipfile.ZipFile(tmp_path / "a b.wacz", "w") as z:
        for name, content, method in members:
            z.writestr(name, content, method)
    want = sorted([*bodies.values(), bodies["g"]])
    got = warc.read_package_files(spark, str(tmp_path)).collect()
    assert sorted(bytes(r["payload"]) for r in got) == want
    assert all(r["page_id"] is None and r["record_type"] == "response" and r["payload_digest"] == warc.payload_digest(bytes(r["payload"])) for r in got)
    data = (tmp_path / "a b.wacz").read_bytes()
    assert sorted(p for _, p in warc.read_package(lambda a, n: data[a : a + n], len(data))) == want
    wide = warc.zip_stored([(n, c) for n, c, m in members if n.startswith("archive")], zip64=True)
    assert sorted(p for _, p in warc.read_package(lambda a, n: wide[a : a + n], len(wide))) == want
    with zipfile.ZipFile(tmp_path / "bad.wacz", "w") as z:
        z.writestr("archive/x.warc.gz", b"".join(one), zipfile.ZIP_DEFLATED)
    data = (tmp_path / "bad.wacz").read_bytes()
    with pytest.raises(ValueError, match="x.warc.gz is not stored"):
        list(warc.read_package(lambda a, n: data[a : a + n], len(data)))


def test_package_files_beyond_2_gib(spark, tmp_path):
    import gzip

    record = gzip.compress(foreign("http://h/z", b"far away"))
    gap = (4 << 30) + 5
    whole = warc.zip_stored([("archive/data.warc.gz", record)], zip64=True)
    # a sparse file: the member and the directory stand beyond 4 GiB, and all offsets move there
    local = whole[: whole.index(warc.CENTRAL)]
    with open(tmp_path / "large.wacz", "wb") as f:
        f.seek(gap)
        f.write(local)
        name = b"archive/data.warc.gz"
        extra = struct.pack("<2H3Q", 1, 24, len(record), len(record), gap)
        directory = struct.pack(warc.CENTRAL_FORM, warc.CENTRAL, 45, 45, 0x800, 0, 0, 33, 0, warc.FULL32, warc.FULL32, len(name), len(extra), 0, 0, 0, 0, warc.FULL32) + name + extra
        start = f.tell()
        f.write(directory)
        end64 = f.tell()
        f.write(struct.pack(warc.END64_FORM, warc.END64, 44, 45, 45, 0, 0, 1, 1, len(directory), start))
        f.write(struct.pack(warc.LOCATOR64_FORM, warc.LOCATOR64, 0, end64, 1))
        f.write(struct.pack(warc.END_FORM, warc.END, 0, 0, warc.FULL16, warc.FULL16, warc.FULL32, warc.FULL32, 0))
    got = warc.read_package_files(spark, str(tmp_path)).collect()
    assert [bytes(r["payload"]) for r in got] == [b"far away"] and got[0]["url"] == "http://h/z"
