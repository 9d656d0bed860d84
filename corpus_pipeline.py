"""A corpus from raw documents to tokens: each stage's rows are written and read again for the next.

All stages but the last return the columns of documents; ``n_chars`` follows a changed text. Every stage judges
rows and not doc_ids: rows of one doc_id, or of none, stay or go each by its own text. Rows with a null doc_id
cannot be ordered among others, so the two stages that dedup keep them as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchloom.llm import bpe, chunks, decontaminate, minhash, quality
from patchloom.llm._store import Scratch
from patchloom.llm.queries import vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts to be good stay."""
    return quality.chosen(docs.select(COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one of the smallest doc_id."""
    return minhash.deduplicated(docs.select(COLUMNS), Scratch(spark, "near"))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that a document of a smaller doc_id has are taken out; documents that nothing is left of go."""
    left = chunks.dedupe(docs.select(COLUMNS).withColumn("_empty", F.col("text") == ""), Scratch(spark, "substring"))
    return left.where("text is null or text <> '' or _empty").select(COLUMNS)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go."""
    return decontaminate.clean(docs.select(COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokenised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of documents with token_ids and n_tokens, and the text that the ids decode to."""
    encoded = bpe.encode(docs.select(COLUMNS), vocabulary()).withColumn("n_tokens", F.size("token_ids").cast("long"))
    return bpe.decode(encoded, vocabulary())


STAGES = [
    ("quality_classifier", classify),
    ("minhash_near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("benchmark_decontamination", decontaminated),
    ("bpe", tokenised),
]
#: The classifier is fitted by gradients and chunks are cut by a rolling hash: beyond SQL. tests/llm holds the
#: stages against plain versions written for the tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return docs
