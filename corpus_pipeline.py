"""A training corpus from ``documents``: each stage reads what the stage before it kept.

language ID rejects what is no known language, exact dedup and the n-gram Jaccard join keep one document of each
group, PII masks personal data in the texts, and packing gives the pieces of the windows that a model is trained on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from vellum.llm import exact_dedup, language_id, ngram_join, packing, pii
from vellum.llm.common import delete, table, work_path


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts of a known language stay; null and empty ones, and those without letters, go."""
    return language_id.keep_identified(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text stays, that with the smallest id; a null text is an empty one."""
    return exact_dedup.distinct_documents(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles and a similarity of 0.8; the smallest id of each class stays."""
    return ngram_join.one_of_each(docs, shingle=5, percent=80)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """n_chars follows the text."""
    return pii.masked(docs).withColumn("n_chars", F.length("text").cast("long"))


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all windows; a null or empty text is its end id alone."""
    return packing.packed(docs)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("ngram_jaccard_join", drop_near_copies),
    ("pii", mask_personal_data),
    ("packing", pack_windows),
]

#: SQL can't express the tokeniser or the packing; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's rows are written to the shared folder; a stage's table goes once its successor's is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = work_path(spark, f"stage-{name}")
        made = stage(spark, docs, sf_dir)
        made.write.parquet(path)
        if before is not None:
            delete(spark, before)
        docs, before = spark.read.schema(made.schema).parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
