"""A corpus from raw documents to ids: quality rules, line dedup, near-duplicates, mixing, BPE.

Each stage reads what its predecessor kept and all but the last return the columns of documents, whatever further columns
the table has. Null and empty texts have too few words for the quality rules and go there; an empty table stays empty
throughout. Documents without an id are kept apart from others only by their texts: line dedup takes equal ones as one
document, near-duplicates leave them all. Repeated rows stay repeated until the mix, which counts each. Very long texts are
whole in every stage. Nothing is limited to a part of the table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from voltgrain.llm import bpe, jaccard, line_dedup, mixing, quality
from voltgrain.llm.common import table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality.quality_filter(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs of 50 words or more are deleted from the texts."""
    return line_dedup.without_later_copies(docs)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at a similarity of 0.8 or more, the one of the smallest id stays."""
    return jaccard.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes: a row for each document and pass, with the words taken."""
    return mixing.mixed(docs)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and digest of each text's ids, and digest of what they decode to."""
    return bpe.digests(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", dedup_documents),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", bpe_encoding),
]

#: Suffix arrays, permutations by hash and BPE are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "pipeline")
    return STAGES[-1][1](spark, docs, sf_dir)
