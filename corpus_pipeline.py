"""A corpus pipeline: quality rules, exact and near deduplication, mixing, SentencePiece encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``docs``, whatever
they are called. Null texts count as empty: the quality rules reject them, and empty texts that reach a later stage are one
set of equal texts, are linked with nothing as near copies, are drawn as others of their cell and have no pieces. Null ids and
sources are values like others (ids sort last). Rows that repeat id and text are one document after exact dedup. Empty
tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sightline.llm import exact_dedup, mixing, near_dup, quality, sentencepieces
from sightline.llm.common import materialise


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the host-level rules keep."""
    return quality.keep_good(docs)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each set of equal texts."""
    return exact_dedup.drop_exact_duplicates(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component (5-word shingles, similarity 0.8 or more)."""
    return near_dup.drop_near_duplicates(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled so that three quarters of the tokens stay, at the target weights."""
    return mixing.mix_documents(docs, settings=mixing.Settings(share=0.75))


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_pieces, pieces, round_trip``."""
    return sentencepieces.pieces_and_back(docs)


STAGES = [
    ("quality rules", quality_stage),
    ("exact dedup", exact_stage),
    ("near dedup", near_stage),
    ("source mixing", mixing_stage),
    ("sentencepiece", pieces_stage),
]

#: SQL can't express the last stage; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stage's result written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = materialise(stage(spark, docs, sf_dir), f"stage{number}")
    return docs
