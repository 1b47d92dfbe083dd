"""Streams over the events table, run to their end and held against the batch result."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.plans.registry import query, table
from lexloom.streaming import incremental


def shared_folder(spark: SparkSession) -> str:
    """A new folder that all executors share; a local one only for a session in one JVM."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="lexloom-streams-")
    return f"{root.rstrip('/')}/streams/{uuid.uuid4().hex}"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


@query("SELECT user_id AS entity, min(ts)::DATE AS earliest, max(ts)::DATE AS latest FROM events GROUP BY ALL")
def stream_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = shared_folder(spark)
    rows = events(spark, sf_dir).select(F.col("user_id").alias("entity"), F.col("ts").cast("date").alias("date"))
    incremental.entity_ranges(rows, f"{at}/checkpoint", f"{at}/out").awaitTermination()
    return incremental.read_ranges(spark, f"{at}/out")


@query("SELECT DISTINCT event_type, user_id FROM events")
def stream_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = shared_folder(spark)
    rows = events(spark, sf_dir).select("event_type", "user_id", F.concat_ws("|", "event_type", F.col("user_id").cast("string")).alias("key"))
    incremental.growing_dataset(rows, f"{at}/checkpoint", f"{at}/out", "key").awaitTermination()
    return spark.read.parquet(f"{at}/out").select("event_type", "user_id")
