"""The corpus pipeline: quality rules, line dedup, near-duplicate removal, benchmark decontamination, packing.

Each stage reads what the stage before it wrote and works on all of it. All but the last return the columns of documents,
whatever these are called; n_chars follows the text where lines go.

Defined cases: documents without words (null or empty text among them) fail the quality rules and go; texts of any length
are read whole; rows that repeat a doc_id and a text are judged alike up to line dedup, and near-duplicate removal keeps
one of them; documents with null doc_id are compared like others, and of a group of near duplicates that with the least doc_id
stays, null first; rows that share a doc_id but not their text are judged by their texts, but go together if one of them
holds a benchmark item; an empty table gives an empty result in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.llm import decontaminate, line_dedup, ngram_join, packing, quality_rules
from quire.llm.common import new_path, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.kept(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier line repeats, or nearly, go; so do documents that keep no word."""
    return line_dedup.without_repeated_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return ngram_join.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, packed into sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("best_fit_packing", pack),
]

#: The robust estimates, latent space and packing are iterative: no SQL gives these rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
