"""A corpus pipeline: five stages over documents, each written as Parquet and read by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallywise.llm.common import documents
from tallywise.llm.exact_dedup import drop_exact_copies
from tallywise.llm.language_id import keep_identified
from tallywise.llm.mixing import mixed_documents
from tallywise.llm.ngram_join import drop_near_copies
from tallywise.llm.sentencepiece import encode
from tallywise.sources.staging import staged


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in an identified language; those that the classifier rejects go.

    Null texts and texts without a letter go; rows that repeat a doc_id are judged by their own text.
    """
    return keep_identified(docs)


def remove_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased) the document with the largest doc_id.

    A null doc_id is the smallest, null texts are equal to empty ones; of rows that repeat id and text one stays.
    """
    return drop_exact_copies(docs)


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a Jaccard similarity of 0.8 or more.

    The smallest doc_id stays (null last), of repeated ids the smallest text hash; documents without words all stay.
    """
    return drop_near_copies(docs, ngram=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them, three times at most.

    A null source is a source; documents without words come as often as their source is taken whole.
    """
    return mixed_documents(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and token ids of every row; null and empty texts have none."""
    return encode(docs)


STAGES = [("language ID", identify_language), ("exact dedup", remove_exact_copies), ("n-gram Jaccard join", remove_near_copies), ("mixing", mix), ("SentencePiece", tokenize)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: A recurrent network and a tokeniser are beyond SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None
