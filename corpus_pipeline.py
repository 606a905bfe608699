"""Corpus pipeline: quality rules, line dedup, near-dedup, mixing and packing, in this order.

Each stage gets what its predecessor kept, as written to Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigmill.llm import line_dedup, mixing, packing, quality_rules, simhash
from sigmill.llm.common import table, written

#: Words of a shingle, bits by which fingerprints of near copies may differ, and the
#: similarity of sets of shingles from which texts are near copies whatever their fingerprints.
SHINGLE_WORDS, BUDGET, SIMILARITY = 5, 3, 0.8


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality_rules.keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that repeat in windows of three; n_chars follows the text."""
    return line_dedup.deduplicated(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the least doc_id."""
    return simhash.keep_one(docs, SHINGLE_WORDS, BUDGET, SIMILARITY)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: none, once or twice."""
    return mixing.mixture(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the packed sequences."""
    return packing.document_pieces(docs)


STAGES = [("quality_rules", rules), ("line_dedup", lines), ("near_dedup", copies), ("mixing", mixed), ("packing", packed)]

#: SQL expresses neither fingerprints nor token ids; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES):
            docs = written(docs, f"pipeline-{name}")
    return docs
