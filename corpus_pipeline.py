"""The training-data pipeline: toxic documents go, repeated passages are cut, of near-duplicates one
stays, documents that hold benchmark items go, and what is left is mixed to target weights.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes it to the shared folder
and gives what it reads back to the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lintlake.llm import decontamination, line_dedup, near_dedup, source_mixing, toxicity
from lintlake.llm._store import keep, table

TOXIC_SCORE = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below TOXIC_SCORE. Rows without id are scored too."""
    sample = toxicity.labelled_sample(docs, table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, sample, TOXIC_SCORE)


def cut_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages of lines that an earlier document has."""
    cut = line_dedup.line_dedup(docs)
    if "n_chars" in docs.columns:
        size = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars"))
        cut = cut.withColumn("n_chars", size.cast(docs.schema["n_chars"].dataType))
    return cut.select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, that with the smallest id. Five words, 80 percent; rows without
    id stay, as they are in no group, and of repeated rows all stay."""
    found = near_dedup.near_duplicates(docs, shingle=5, percent=80, symbols=48)
    gone = found.where("not kept").select("doc_id")
    return docs.hint("merge").join(gone, "doc_id", "left_anti").select(*docs.columns)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item. Every row is judged by its own text, rows without id too."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its size, taken words and training positions, in training order;
    what the mix does not take comes last."""
    mixed = source_mixing.mix_sources(docs, keep_columns=True)
    return mixed.orderBy(F.asc_nulls_last("position"), "doc_id")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", cut_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("mixing", mix),
]
ORACLE_SQL = None  # compression lengths and trained dictionaries are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), name)
    return docs
