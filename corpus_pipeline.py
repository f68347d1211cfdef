"""The corpus pipeline: quality, exact and near duplicates, mixing, encoding.

``STAGES`` are (name, function); each function takes (spark, docs, sf_dir) and
works on all that the stage before it kept. ``run`` applies them to
``documents``; what a stage returns is written as Parquet to the shared folder
and read again as the next one's documents. All but the last return the columns
of ``documents``; mixing returns a document once per epoch that takes it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cairnwise.llm import bagminhash, exact_dedup, kneser_ney, mixing, sentencepieces
from cairnwise.llm.queries import TOKENIZERS, read, trusted_ids
from cairnwise.session import materialise


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects."""
    return kneser_ney.drop_low_quality(docs, trusted_ids(spark, sf_dir))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each text."""
    return exact_dedup.drop_exact_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates."""
    return bagminhash.drop_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents so that sources reach their target weights."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids, piece ends and decoded text of every document."""
    return sentencepieces.encode_documents(docs, f"{TOKENIZERS}/piece_bpe_32k.model")


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("mix", mix), ("encode", encode)]

#: SQL cannot express the first, third and last stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
