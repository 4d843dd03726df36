"""Corpus pipeline: quality rules, near-duplicates, personal data, mixing, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor
kept and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumenframe.llm import jaccard_dedup, mixing, packing, pii, quality_rules
from lumenframe.llm.common import documents, stage_table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules (op 9) reject go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_rules.judge(docs, labels, whole=True).where("kept").select("_all.*")


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts at 5-word Jaccard similarity 0.8 or more stays: the one of the smallest id."""
    return jaccard_dedup.dedup(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data (op 7) is masked by its kind."""
    return pii.mask(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are put in the Pfair order of their sources (op 10); all stay."""
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are tokenised and packed into windows (op 8), task by task in the Pfair order.

    Spark reads the files of a stored table by size, so the order is derived again: it follows from ids and sources.
    """
    return packing.pack(mixing.mix(docs), packing.tokenizer_path())


STAGES = [
    ("quality_rules", quality),
    ("simhash_dedup", dedup),
    ("pii_masking", personal_data),
    ("pfair_mixing", mixed),
    ("packing", packed),
]

#: The stages sketch, bootstrap and tokenise, which SQL does not express; tests hold them against plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stored in the shared folder for the next."""
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage_table(docs, f"pipeline-{name}")
    return docs
