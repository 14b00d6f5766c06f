"""Corpus pipeline: documents -> quality rules -> one document of each near-duplicate class ->
secrets marked out -> sources mixed to target weights -> token ids.

Every stage is a function (spark, docs, sf_dir) -> DataFrame; ``run`` writes what a stage returns as
Parquet into the shared checkpoint folder and hands the reread table to the next one, so a lost
executor costs a stage's unfinished tasks only. All stages but the last return the columns of
``documents``; the last returns them with the token ids instead of the text. A document that the
mix takes twice stands twice. SQL can express neither the risk-controlled cutoffs nor the merges,
so there is no oracle; the tests compare each stage with a brute-force version.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from autotab.llm import bpe, mixing, neardup, quality, secret_scan
from autotab.llm.common import table
from autotab.session import checkpoint_dir


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.filter_documents(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.first_of_class(docs)


def secrets_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact_documents(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.shuffled(mixing.mix(docs)).select(docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs, bpe.vocabulary_path()).withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [("quality", quality_rules), ("near_duplicates", near_duplicates), ("secrets", secrets_out), ("mixing", mix_sources), ("tokens", token_ids)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4()}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
