"""Incremental processing: files that keep arriving, tables that are brought up to date by batch.

A query's checkpoint holds how far it came, so a restart neither skips nor repeats input; the tables are keyed by batch or by row, so
that a batch that is run again replaces itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def arriving(spark: SparkSession, path: str, schema: str, form: str = "json", files: int = 100, **options) -> DataFrame:
    return spark.readStream.format(form).schema(schema).option("maxFilesPerTrigger", files).options(**options).load(path)


def _run(stream: DataFrame, checkpoint: str, batch: Callable[[DataFrame, int], None]) -> StreamingQuery:
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def keyed_batches(stream: DataFrame, checkpoint: str, out: str, work: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """``work`` on each batch, written to the batch's own folder below ``out``; a batch that is run again overwrites it."""
    return _run(stream, checkpoint, lambda df, n: work(df).write.mode("overwrite").parquet(f"{out}/batch={n}"))


def entity_ranges(stream: DataFrame, checkpoint: str, out: str) -> StreamingQuery:
    """Date ranges of entities over all input so far: each batch leaves its own ranges, and a reader takes the widest. Late dates
    count like early ones."""
    ranges = lambda df: df.groupBy("entity").agg(F.min("date").alias("earliest"), F.max("date").alias("latest"))
    return keyed_batches(stream, checkpoint, out, ranges)


def read_ranges(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(out).groupBy("entity").agg(F.min("earliest").alias("earliest"), F.max("latest").alias("latest"))


def growing_dataset(stream: DataFrame, checkpoint: str, out: str, key: str) -> StreamingQuery:
    """Rows whose key no earlier batch had, of one batch's the least by all columns; the folder is the ledger of used keys."""

    def batch(df: DataFrame, n: int) -> None:
        new = df.groupBy(key).agg(F.min(F.struct(*df.columns)).alias("row")).select("row.*")
        if n:
            used = df.sparkSession.read.parquet(out).where(F.col("batch") < n)
            new = new.join(used.select(key), key, "left_anti")
        new.write.mode("overwrite").parquet(f"{out}/batch={n}")

    return _run(stream, checkpoint, batch)


def windowed_counts(stream: DataFrame, time: str, by: str, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """An extension: counts by event-time window, closed once the watermark has passed."""
    stream = stream.withColumn(time, F.col(time).cast("timestamp"))
    return stream.withWatermark(time, late).groupBy(F.window(time, window), by).agg(F.count(F.lit(1)).alias("n"))


def distinct_events(stream: DataFrame, key: str, time: str, late: str = "10 minutes") -> DataFrame:
    """An extension: one row for each key within the lateness."""
    stream = stream.withColumn(time, F.col(time).cast("timestamp"))
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])
