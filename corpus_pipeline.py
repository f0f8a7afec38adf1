"""A corpus pipeline of five stages over ``documents``; each works on all that the one before it kept.

Every stage but the last returns the columns of ``documents``; ``run`` writes each stage's result as
Parquet to the shared folder and gives the next one what it reads back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm import line_dedup, mixing, near_dedup, packing, toxicity
from touchline.llm.common import read, release, scratch_scope, stage


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model predicts to be toxic go."""
    labels = read(spark, sf_dir, "labels")
    fold = F.crc32(F.col("doc_id").cast("string")) % 3
    model = toxicity.train(docs.where(fold != 1), labels.where(fold != 1))
    return docs.where(toxicity.scorer(model)(F.col("text")) < toxicity.THRESHOLD)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines with an earlier equal or one-edit copy go from the texts; every document stays."""
    out = line_dedup.dedup_lines(docs, counts=None)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one document stays: that with the smallest id, null ids last."""
    return near_dedup.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; the last words taken of a source may be part of one."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of a document: its tokens, its sequence and its place there."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_documents),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL has neither the tokenizer nor the trained model; tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    with scratch_scope() as made:
        for name, function in STAGES[:-1]:
            docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
            release(spark, made, keep=docs)  # what the stage worked with, and the stage before
    return STAGES[-1][1](spark, docs, sf_dir)
