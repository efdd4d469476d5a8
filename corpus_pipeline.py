"""The corpus pipeline: each stage's result is written as Parquet and read again as the next one's documents.

Null texts count as empty and are kept like others; rows with a null doc_id pass through (one stays of equal texts).
Texts are read whole. Columns keep their names until the last stage, whatever they are. Empty documents make an empty
result. A stage's tables are deleted once its result is written, and a result once the next one is.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from kinsplit.llm import exact_dedup, mixing, near_dedup, packing, toxicity
from kinsplit.llm.catalog import tokenizer_paths
from kinsplit.plans.names import column, columns
from kinsplit.plans.storage import delete, forget_at_exit, mark, release_since, shared_dir


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.5 or more go."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.score(docs, model)
    return scored.where(column(scored.columns[-1]) < 0.5).select(*columns(docs))


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the largest doc_id stays."""
    return exact_dedup.drop_exact_duplicates(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the smallest doc_id stays."""
    return near_dedup.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once, or twice."""
    return mixing.take_copies(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents, repeats included, with their places in sequences."""
    return packing.pack_documents(docs, *tokenizer_paths())


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_exact),
    ("near dedup", drop_near),
    ("source mixing", mix_sources),
    ("best-fit packing", pack_sequences),
]

# Classifier, shingle signatures and packing have no SQL form; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, base = spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{shared_dir(spark)}/kinsplit/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        point = mark()
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
        release_since(point)
        if k:
            delete(spark, f"{base}/{k - 1}")
    forget_at_exit(spark, base)
    return docs
