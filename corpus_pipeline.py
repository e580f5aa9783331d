"""A corpus from raw documents to packed training sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import decontaminate, line_dedup, packing, quality, simhash_dedup
from tidewater.llm.common import materialize
from tidewater.llm.queries import tokenizer_path
from tidewater.session import ship_package


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_good(docs, quality.learn(docs, labels))


def distinct_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that occur before, exactly or up to one edit, go; every document stays, with ``n_chars`` counted anew."""
    return line_dedup.dedup_lines(docs).withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast(docs.schema["n_chars"].dataType))


def near_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: shingles of five words, fingerprints within 6 bits, and 0.8 of the shingles shared."""
    return simhash_dedup.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that give a benchmark item away go."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as pieces of sequences of 1024 tokens."""
    return packing.pack(spark, docs, tokenizer_path("byte_bpe_50k.json"), end_id=2, capacity=1024)


STAGES = [
    ("quality_classifier", good_quality),
    ("line_dedup", distinct_lines),
    ("simhash_near_dedup", near_distinct),
    ("decontamination", decontaminated),
    ("best_fit_packing", packed),
]

#: Classifier scores, deletion neighbourhoods and tokenizer ids have no SQL form; ``tests/llm/test_pipeline.py`` holds every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each stage's result is written and read back."""
    ship_package(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, f"pipeline-{name}")
    return docs
