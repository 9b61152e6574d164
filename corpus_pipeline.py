"""From raw documents to token digests, stage by stage. Each stage reads what the one before it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyform.llm import decontaminate, near_dedup, pieces, quality, suffix_dedup
from tallyform.llm.queries import piece_model
from tallyform.llm.shared import importable, stage, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules (operator 2), whose references are those of the documents given."""
    importable(spark)
    return quality.keep_good(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (operator 3): the one of least id."""
    importable(spark)
    return near_dedup.keep_one(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with 200-byte strings that occur more than once cut out (operator 6)."""
    importable(spark)
    return suffix_dedup.cut_repeats(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark (operator 5)."""
    importable(spark)
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and digests of each document's pieces, and of the text that they decode to (operator 4)."""
    importable(spark)
    return pieces.encoding_digests(docs, piece_model())


STAGES = [
    ("quality rules", good_quality),
    ("near-duplicates", one_of_each),
    ("suffix-array dedup", without_repeats),
    ("decontamination", without_benchmark),
    ("piece encoding", encoded),
]

#: Training, anchors and piece merges have no SQL form; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
