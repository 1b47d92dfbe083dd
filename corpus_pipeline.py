"""The corpus pipeline: from documents to packed training sequences.

Each stage takes what the one before it kept, and returns the columns of documents; the last returns the pieces of the packed
sequences. Documents without a recognised language go, then all but one of equal texts, all but one of near-duplicates, and
those that contain benchmark passages; the rest are packed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexloom.llm import crf, decontaminate, digest_index, packing, simhash
from lexloom.llm.common import write_scratch


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return crf.accept(docs, crf.train(docs))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return digest_index.dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.representatives(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [("language", language), ("exact_dedup", exact), ("near_dedup", near), ("decontaminate", benchmark), ("pack", pack)]

#: Language identification, near-duplicates and packing can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the documents that the stages keep."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = write_scratch(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
