"""Sinks. A write goes to a new folder or replaces a whole one; nothing is edited in place."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def batched_json(df: DataFrame, path: str, rows: int = 1000) -> None:
    """JSON lines in files of at most ``rows`` rows. An existing folder is an error; take a new one for each run."""
    df.write.option("maxRecordsPerFile", rows).json(path)


def json_lines(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def entity_rows(df: DataFrame, undated: bool = False) -> DataFrame:
    """Entities for export: missing dates are ``0``; without dates only if wanted."""
    rows = df if undated else df.where("earliest IS NOT NULL")
    text = lambda c: F.coalesce(F.date_format(c, "yyyy-MM-dd"), F.lit("0"))
    return rows.select(F.col("entity").alias("Entity"), F.coalesce("url", F.lit("")).alias("Wikipedia_URL"), text("earliest").alias("Earliest_Date"), text("latest").alias("Latest_Date"))


def entity_csv(df: DataFrame, path: str, undated: bool = False) -> None:
    entity_rows(df, undated).orderBy("Entity").write.option("header", True).csv(path)


def entity_json(df: DataFrame, path: str, undated: bool = False) -> None:
    """JSON arrays: each file of the folder is one, in the order of the entities."""

    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = True
        for batch in batches:
            rows = batch.column("json").to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([("[" if first and not i else ",") + row for i, row in enumerate(rows)], pa.string())], ["value"])
            first = first and not rows
        yield pa.RecordBatch.from_arrays([pa.array(["[]" if first else "]"])], ["value"])

    rows = entity_rows(df, undated).orderBy("Entity")
    rows.select(F.to_json(F.struct("*")).alias("json")).mapInArrow(arrays, "value string").write.text(path)


def per_bucket(df: DataFrame, path: str, column: str = "total") -> None:
    df.write.partitionBy(column).json(path)


def keyed_table(df: DataFrame, name: str, path: str, key: str, buckets: int = 64) -> None:
    """A Parquet table bucketed by its key, so that joins and lookups by it don't shuffle."""
    df.write.bucketBy(buckets, key).sortBy(key).option("path", path).mode("overwrite").saveAsTable(name)


def csv_report(df: DataFrame, path: str) -> None:
    df.write.option("header", True).mode("overwrite").csv(path)


def one_row_json(df: DataFrame, path: str) -> None:
    """Statistics and ledgers: one file with one row."""
    df.coalesce(1).write.mode("overwrite").json(path)
