"""The corpus pipeline: five stages over ``documents``, each written and reread.

1. language ID: documents without a letter or a prevailing language go;
2. n-gram Jaccard join: one document of each class of near duplicates stays;
3. benchmark decontamination: documents into which a test item leaked go;
4. secret scans: secrets are replaced in the text, all documents stay;
5. source mix: documents that the mix takes, with how many of their words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cellquarry.llm.cluster import stored
from cellquarry.llm.decontamination import keep_clean
from cellquarry.llm.language_id import keep_identified
from cellquarry.llm.ngram_join import keep_one
from cellquarry.llm.secret_scan import redact_secrets
from cellquarry.llm.source_mix import apply_mix


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def scan_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact_secrets(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return apply_mix(docs)


STAGES = [
    ("language_id", language_id),
    ("ngram_jaccard_join", near_duplicates),
    ("decontamination", decontaminate),
    ("secret_scan", scan_secrets),
    ("source_mix", mix_sources),
]

#: A field's posteriors and a tiling by repeated marking have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from the table ``documents`` to the mix."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
