"""Corpus preparation: text operators as stages, each over all that the stage before it kept.

language ID (documents without a letter, or without any recognisable language, go), exact deduplication, near-duplicate removal (five words, 0.8), secret
scan (secrets are masked, no document goes), packing. Each stage's result is stored as Parquet in the folder that spark.checkpoint.dir
names and read again as the next one's documents. Rows with a null doc_id are linked with nothing and stay; their secrets are masked like
any other's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import exact_dedup, language_id, near_dedup, packing, secret_scan
from quarry.llm._util import materialize, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found; those with no letter (`und`) go."""
    return docs.filter(language_id.predicted(spark, language_id.train(docs), F.col("text"))["lang"] != "und")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(docs, size=5, percent=80)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("language_id", language), ("exact_dedup", exact), ("near_dedup", near), ("secret_scan", secrets), ("packing", packed)]

#: Language ID and near-duplicate groups are beyond SQL; tests/llm hold the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{name}")
    return docs
