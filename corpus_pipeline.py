"""The corpus pipeline: quality rules, near-duplicates, secrets, source mixing and packing.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the last
return the columns of documents. No stage can be told in SQL as a whole (hashing, a fitted model and a
packing plan are among them), so ORACLE_SQL is None and tests hold run() against a brute-force version.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from cuelake.llm import mixing, packing, quality_rules, secret_crf, simhash
from cuelake.llm.common import scratch
from cuelake.session import read_table, remove_folder, shared_folder


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go; null and empty texts among them."""
    return quality_rules.keep_good(docs)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the smallest id."""
    return simhash.drop_near_duplicates(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text, n_chars is counted anew; every document stays, null texts as null."""
    return secret_crf.mask_secrets(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target weight draws it, in shuffled order; a null source is one of
    its own. Columns of docs that are named like the operator's own stay the caller's."""
    return mixing.mix(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in full sequences; a null text is empty."""
    return packing.best_fit_pack(docs)


STAGES = [
    ("quality rules", quality_stage),
    ("SimHash near-dedup", dedup_stage),
    ("secret scans", secrets_stage),
    ("mixing sources", mixing_stage),
    ("best-fit packing", packing_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. What a stage returns is written as Parquet to the shared folder of
    spark.checkpoint.dir and read again as the next one's docs; it is deleted once the next one is written. No rows
    give no rows, and columns that documents does not have are kept up to the packing."""
    shared = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, done = read_table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES[:-1]):
        path = f"{shared}/{k}"
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if done:
            remove_folder(spark, done)
        docs, done = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
