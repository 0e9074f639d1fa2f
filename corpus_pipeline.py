"""Documents to training tokens: quality, exact and near duplicates, mixing, tokenisation.

Each stage takes (spark, docs, sf_dir), applies one operator to all of ``docs``
and returns the next stage's documents; the last returns tokens.

All stages take null texts as empty, texts of any length, rows that repeat an id
or have none, tables without rows and columns of any name; what they make of
them, and of ties, the operators' docstrings say.  Rows, not ids, are kept or
dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracewinnow.llm import exact_dedup, mixing, quality, simhash, tokens
from tracewinnow.llm.common import materialise, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the rule ensemble, trained on the labelled ones, doesn't reject."""
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of equal texts."""
    return exact_dedup.keep_first(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each component of close fingerprints, or of similar texts however far their fingerprints are."""
    return simhash.keep_one(docs, wider_bits=64)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them: a document taken twice is two rows."""
    return mixing.mixed(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of each row."""
    return tokens.encode(docs).select("doc_id", "n_tokens", "ids")


STAGES = [
    ("quality classifier", good_quality),
    ("exact dedup", exact_copies),
    ("SimHash near-dedup", near_copies),
    ("mixing sources to target weights", mixture),
    ("SentencePiece encoding", token_ids),
]

#: No SQL can express the classifier, the components, the sampling or the tokens; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialise(docs, f"pipeline-{k}")
    return docs
