"""The registered queries of this subpackage, thin over its operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallywise.llm import centroids, exact_dedup, html_extract, language_id, merkle, mixing, ngram_join, order_minhash, quality, repeated_phrases, sentencepiece, toxicity, warc
from tallywise.llm.common import documents, pages


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text, and whether they decode to it."""
    return sentencepiece.encode(documents(spark, sf_dir), check=True)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole text, learned from labelled rows that are not held out; null and empty texts score as clean."""
    return toxicity.toxicity(documents(spark, sf_dir), labels(spark, sf_dir))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text, learned from rows with a language that are not held out; ``und`` without a letter."""
    return language_id.languages(documents(spark, sf_dir))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page; null html gives an empty text, repeated rows a row each."""
    return html_extract.extract(pages(spark, sf_dir))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes, at most 3 times its size; a null source is the last, null texts have no words."""
    return mixing.mix_sources(documents(spark, sf_dir))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grade probabilities of every whole text, from the label table; null and empty texts are graded too."""
    return quality.quality(documents(spark, sf_dir), quality.usefulness(labels(spark, sf_dir)))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row that stays for every row, by the text with A-Z lower-cased; null counts as empty, of rows that repeat id and text one stays."""
    return exact_dedup.exact_groups(documents(spark, sf_dir))


def op8_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and its edited form, and how alike they and the next text are; a row for every row."""
    return order_minhash.edited_likeness(documents(spark, sf_dir))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents that share nine tenths of their three-word shingles; rows without words are alone."""
    return ngram_join.jaccard_groups(documents(spark, sf_dir), ngram=3, percent=90)


def op10_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record for every page, written to ZIP packages and read back; the smallest page_id of equal payloads is the response."""
    return warc.archived_pages(pages(spark, sf_dir))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, subroot, root and proof digest of every document, and whether its tampered form still folds to the root; null langs are a group."""
    return merkle.tampered_manifest(documents(spark, sf_dir))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster and squared distance of every vector with 64 finite components, as integers, after three rounds from 16 hashed starts."""
    return centroids.clusters(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_repeated_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every whole text, and what is left without those under windows of 35 words that occur elsewhere too; null texts have none."""
    return repeated_phrases.repeat_report(documents(spark, sf_dir))


_ALL = (op1_sentencepiece, op2_toxicity, op3_language_id, op4_html_text, op5_mix_sources, op6_quality, op7_exact_dedup, op8_order_minhash, op9_ngram_join, op10_warc_zip, op11_merkle_manifest, op12_centroids, op13_repeated_phrases)
QUERIES = {f.__name__: f for f in _ALL}

ORACLES = {"op5_mix_sources": mixing.ORACLE, "op7_exact_dedup": exact_dedup.ORACLE, "op9_ngram_join": ngram_join.ORACLE, "op10_warc_zip": warc.ORACLE, "op11_merkle_manifest": merkle.ORACLE, "op12_centroids": centroids.ORACLE, "op13_repeated_phrases": repeated_phrases.ORACLE}
