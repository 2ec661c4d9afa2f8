"""A corpus pipeline: rules, exact dedup, near dedup, secret removal, packing.

Every stage takes what the one before kept, as a table written to the shared folder, and returns the
columns of ``documents``; the last one returns the pieces of packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vidspark.llm.common import stored, table, vocabulary
from vidspark.llm.cuckoo import drop_copies
from vidspark.llm.jaccard import one_of_each
from vidspark.llm.packing import pack
from vidspark.llm.rules import quality_filter
from vidspark.llm.secrets import redact


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or lie outside their language's bands go."""
    return quality_filter(docs, vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal up to the case of A-Z the one with the largest id stays."""
    return drop_copies(docs)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 the one with the least id stays."""
    return one_of_each(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Found secrets are replaced; every document stays."""
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2,048 tokens."""
    return pack(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("ngram_jaccard", ngram_jaccard),
    ("secret_scan", secret_scan),
    ("packing", packing),
]

# Tokenisers and MinHash have no SQL form; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
