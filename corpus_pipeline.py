"""A corpus pipeline of operators from ``ratiosift.llm``: from documents to packed training sequences.

Every stage reads what its predecessor wrote. Toxic documents go, documents of low quality go, one document of each group
of near-duplicates stays, documents with benchmark passages go, and the rest are packed into sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ratiosift.llm.decontaminate import without_benchmark
from ratiosift.llm.near_dedup import deduplicated
from ratiosift.llm.packing import pack
from ratiosift.llm.quality import of_quality
from ratiosift.llm.queries import tokenizer_path
from ratiosift.llm.shared import Scratch
from ratiosift.llm.toxicity import without_toxic


def _toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_toxic(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return of_quality(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def _near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return deduplicated(spark, docs)


def _decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_benchmark(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(spark, docs, tokenizer_path())


STAGES = [("toxicity", _toxicity), ("quality", _quality), ("near_dedup", _near_dedup), ("decontaminate", _decontaminate), ("pack", _pack)]

#: Trained and iterative stages cannot be said in SQL; tests/llm/test_pipeline.py recomputes them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies ``STAGES`` to the documents; each stage's rows are written as Parquet and read by the next. The last stage's
    table stays, the others are deleted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name, last=name == STAGES[-1][0])
    scratch.close()
    return docs
