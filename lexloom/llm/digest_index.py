"""Exact deduplication against a persistent digest index.

The index is a Parquet table, bucketed and sorted by SHA-256 digest, at a path that outlives the session. New rows are
digested, grouped, kept apart from what the index already holds by a sort-merge anti-join on the buckets, and appended.
DataFrame functions only.

Defined results: a null text counts as empty; texts are compared unchanged; of equal texts in one batch the row with the
largest id stays (a null id is the smallest; of repeated rows with one id exactly one stays); a digest that an earlier
batch brought keeps that batch's row and every new row of it is dropped; an empty batch changes nothing; a batch
that comes again under its name gets its first verdict. Columns other
than the id and the text are not read, so their names don't matter.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm.common import ROW, exists, keyed, scratch_path, write_scratch

SCHEMA = "digest BINARY, keep_id BIGINT, batch STRING"


class DigestIndex:
    """A persistent set of digests, one row each: digest, id of the row that stays, batch that brought it.

    The number of buckets is part of the files: a reopened index has the one that it was made with, whatever is asked for. It stands in a
    file beside the table's.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        stored = f"{self.path}/buckets"
        if not exists(spark, f"{stored}/_SUCCESS"):
            spark.range(1).select(F.lit(buckets).alias("buckets")).coalesce(1).write.mode("overwrite").parquet(stored)
        self.buckets = spark.read.schema("buckets int").parquet(stored).first()["buckets"]
        self.table = f"digest_index_{uuid.uuid5(uuid.NAMESPACE_URL, self.path).hex}"
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} ({SCHEMA}) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}/digests'"
        )
        spark.catalog.refreshTable(self.table)

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def append(self, fresh: DataFrame) -> None:
        fresh.select("digest", "keep_id", "batch").repartition(self.buckets, "digest").sortWithinPartitions("digest").write.insertInto(self.table)
        self.spark.catalog.refreshTable(self.table)

    def ingest(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None) -> DataFrame:
        """Digest ``docs``, append what is new and return one row per row of ``docs``:
        doc_id, digest, keep_id, group_size (rows of that text in this batch), kept.

        ``batch`` names the batch. One that has been ingested before, wholly or in part since the driver was lost, gets its first verdict again: what
        it brought itself isn't held against it, and only what the index lacks is appended."""
        batch = batch or uuid.uuid4().hex
        rows = write_scratch(
            docs.select(
                F.col(id_col).cast("long").alias("doc_id"),
                F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256)).alias("digest"),
            ).withColumn("row", F.monotonically_increasing_id()),
            "digests",
        )
        groups = rows.groupBy("digest").agg(F.max(F.struct("doc_id", "row")).alias("top"), F.count(F.lit(1)).alias("group_size"))
        fresh = groups.join(self.read().hint("merge"), "digest", "left_anti").select("digest", F.col("top.doc_id").alias("keep_id"), F.col("top.row").alias("keep_row"), "group_size", F.lit(True).alias("new"))
        own = F.when(F.col("batch") == batch, F.col("top.row"))
        known = groups.join(self.read().hint("merge"), "digest").select("digest", "keep_id", own.alias("keep_row"), "group_size", F.lit(False).alias("new"))
        verdicts = write_scratch(fresh.unionByName(known), "verdicts")
        self.append(verdicts.where("new").withColumn("batch", F.lit(batch)))
        return rows.join(verdicts, "digest").select("doc_id", "digest", "keep_id", "group_size", F.coalesce(F.col("row") == F.col("keep_row"), F.lit(False)).alias("kept"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", index: DigestIndex | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; without ``index`` against a new, empty one. Where ids are
    missing or repeated, the last row of equal texts stays."""
    spark = docs.sparkSession
    docs, key = keyed(docs, id_col)
    index = index or DigestIndex(spark, scratch_path(spark, "digest-index"))
    stay = write_scratch(index.ingest(docs, key, text_col).where("kept").select(F.col("doc_id").alias("__stay")), "stay")
    return docs.join(stay.hint("merge"), docs[key] == stay["__stay"], "left_semi").drop(ROW)


def op4_digest_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as one batch for a new index."""
    index = DigestIndex(spark, scratch_path(spark, "digest-index"))
    found = index.ingest(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP4_SQL = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""
