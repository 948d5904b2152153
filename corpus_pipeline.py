"""The corpus pipeline: toxicity, near-dedup, benchmark decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and works on all rows of ``docs``, the Parquet that its predecessor wrote; all
but the last return the columns of ``docs``.  A stage's scratch tables are deleted when the next one starts: write its result before.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panellink.llm import decontam, mixing, sharding, simhash, toxicity
from panellink.llm.common import clear_scratch, col_of, scratch_of, scratch_root


def _carried(found: DataFrame, docs: DataFrame) -> DataFrame:
    return found.select(*[col_of(found, f"carry_{c}").alias(c) for c in docs.columns])


#: Scratch tables of the stage before, whose result is written by the time the next one starts.
_TABLES: list[str] = []


def _stage(f: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage that first deletes the scratch tables of the stage before."""

    @wraps(f)
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        clear_scratch(spark, _TABLES)
        with scratch_of(_TABLES):
            return f(spark, docs, sf_dir)

    return stage


@_stage
def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the model, learned from ``labels``, predicts as toxic."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _carried(toxicity.score_documents(docs, model, carry=tuple(docs.columns)).where("predicted = 0"), docs)


@_stage
def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, that of the smallest id, of each component of documents whose five-word shingles agree at 0.8 or more."""
    return _carried(simhash.near_duplicates(docs, shingle=5, similarity=0.8, carry=tuple(docs.columns)).where("keep"), docs)


@_stage
def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a window of a benchmark item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _carried(decontam.decontaminate(docs, items, carry=tuple(docs.columns)).where("NOT contaminated"), docs)


@_stage
def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat each document as often as the mix takes it."""
    mixed = mixing.mix_sources(docs, carry=tuple(docs.columns)).where("copies > 0")
    return _carried(mixed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))), docs)


@_stage
def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with size, text_crc32, law, shard and slot."""
    placed = sharding.shard_documents(docs, carry=tuple(c for c in docs.columns if c != "doc_id"))
    rest = [col_of(placed, f"carry_{c}").alias(c) for c in docs.columns if c not in ("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")]
    return placed.select("doc_id", *rest, "size", "text_crc32", "law", "shard", "slot", "grown_shard")


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: SQL can't express the learned model of the first stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written as Parquet and reread as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    root = f"{scratch_root(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{root}/{k}-{name}")
            docs = spark.read.parquet(f"{root}/{k}-{name}")
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {}
