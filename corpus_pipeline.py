"""The corpus pipeline: documents through quality rules, line dedup, near-duplicate removal, decontamination and mixing.

Each stage takes (spark, docs, sf_dir), ``docs`` being all that the stage before it kept, and returns
a DataFrame; ``run`` writes each stage's rows to the shared folder, drops what the stage kept there meanwhile,
and hands the next one what it reads back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import decontam, jaccard_join, line_dedup, mixing, oracles, quality_rules
from foliant.llm.storage import settled


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three documents or more hold stay in the one of the largest doc_id; ``n_chars`` follows the text."""
    return line_dedup.dedup(docs).withColumn("n_chars", F.length("text").cast("bigint"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates stays, that of the smallest doc_id."""
    return jaccard_join.one_row_per_group(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are left, with what the mix takes of each and the first slot that holds it."""
    return mixing.mixed(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("near_duplicates", near_duplicates),
    ("decontamination", benchmark),
    ("mixing", mixed),
]

#: The stages in SQL, which counts all common shingles and words, so it is for small tables.
ORACLE_SQL: str | None = oracles.pipeline_sql()


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = settled(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), name)
    return docs
