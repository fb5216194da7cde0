import pytest

#: Columns whose names the operators use inside.
CLASHING = "id, row, best, order, bucket, target, copies, token, n, a, b, hist, prefix, fp, part, text_hash, next_fp, host, shard, h, sha, winner, payload, tokens, lang_pred, score, __id, __copies".split(", ")


@pytest.fixture
def docs(spark):
    """Builds documents from (doc_id, text[, lang, source]), with more columns of clashing names."""
    from pyspark.sql import functions as F

    def build(rows, parts=3):
        full = [(*r, *[None] * (4 - len(r)))[:4] for r in rows]
        df = spark.createDataFrame(full, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
        return df.withColumns({c: F.lit(7) for c in CLASHING}).repartition(parts)

    return build


@pytest.fixture
def odd_docs(docs):
    """Nulls, empty and blank texts, repeated rows, a long text, ties."""
    long = " ".join(f"word{i % 977} of" for i in range(60_000))
    return docs([(1, "Hello World again today"), (2, "hello world AGAIN today"), (2, "hello world AGAIN today"), (3, None), (4, ""), (5, "   \n"), (6, None, "en", "s"), (7, long, "en", "s"), (8, "…!? 123", "en"), (None, "a text without id", None, "t"), (9, "é È ñ", "es", None), (10, "x")])
