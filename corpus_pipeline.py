"""A corpus pipeline of five operators: quality rules, line dedup, near-dedup, mixing, tokens.

Each stage is a function (spark, docs, sf_dir) -> DataFrame over everything its predecessor kept, and what it decides is final:
rejected documents, repeated lines and near-duplicates are gone for the stages behind it. All stages but the last
return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointlens.llm import bpe, linededup, mixing, neardup, quality
from pointlens.llm.common import shared_dir, table
from pointlens.llm.queries import tokenizer_path, trusted_labels
from pointlens.sources.shared import remove

#: No SQL for run(): XXH64 shingle sets, their components and BPE have no DuckDB form. Tests hold it against brute force.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.keep_good(docs, trusted_labels(spark, sf_dir))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later repeats of runs of lines; n_chars follows the text."""
    thinned = linededup.dedup_lines(docs).withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return thinned.select(*docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: sets of five-word shingles with a Jaccard similarity of 0.8 or more."""
    return neardup.keep_one(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target weight asks, shuffled."""
    return mixing.mix(docs).select(*docs.columns)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the mixed documents."""
    return bpe.encode_digest(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [("quality", quality_stage), ("lines", line_stage), ("near", near_stage), ("mixing", mixing_stage), ("tokens", token_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what a stage returns is written as Parquet and read again, and deleted when the next one is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = f"{shared_dir(spark)}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:
            remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
