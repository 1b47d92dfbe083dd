"""Token ids in files, coded by an adaptive context-mixing range coder.

File format: a folder of Parquet parts in ascending id order, one row per segment. A segment's payload is ``LEXM``, the number of
blocks, and the blocks. A block has up to ``BLOCK`` ids and can be read by itself: a header (ids, bytes of code, CRC-32 of the
ids, little-endian), and the code, which begins with the different ids as gaps. The segment's documents (id, ids before it in the segment,
number of ids) are columns of the row.

Model of a block, started anew in each (``jvm/MixingCoder.java``): the distributions of order 0, 1 and 2 over the next id are mixed
with weights that are learned as it is coded, and the mixed probabilities share out the interval of a range coder. Each id depends on
those before it, so the loop over a block's ids is Java, compiled by the compiler that Spark has for its own code; it
runs in the executors' JVMs as a function of a binary column, and reading the files back needs no Python at all.

Defined results: a null text counts as empty and has its end id only; null ids come first; repeated rows are written each,
in any order; an empty table has no segments; a damaged block raises an error. Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom.llm import jvm, tokens
from lexloom.llm.common import scratch_path

#: Ids that learn one model, and text bytes of a segment (a longer text has a segment of its own).
BLOCK, SEGMENT_BYTES = 1 << 18, 12 << 20


def encoded(ids: str, block: int = BLOCK) -> Column:
    """The payload of a binary column of little-endian 32-bit ids; the session must have the functions of :mod:`lexloom.llm.jvm`."""
    return F.call_function("lexloom_encode_ids", F.col(ids), F.lit(block))


def decoded(payload: str) -> Column:
    """The ids of a payload, as :func:`encoded` takes them; a damaged payload raises an error."""
    return F.call_function("lexloom_decode_ids", F.col(payload))


def write_ids(docs: DataFrame, path: str, tokenizer_path: str | None = None, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode the texts and write their ids below ``path``, in ascending id order."""
    where = tokenizer_path or tokens.default_path()
    jvm.register(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, segment = TaskContext.get().partitionId(), 0
        for batch in (part for whole in batches for part in tokens.by_bytes(whole, "text", SEGMENT_BYTES)):
            ids, bounds = tokens.encode(where, batch.column("text"), end_id)
            row = [[part], [segment], [len(ids)], [batch.column("doc_id").to_pylist()], [bounds[:-1].tolist()], [np.diff(bounds).tolist()], [ids.astype("<u4").tobytes()]]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, types, strict=True)], ["part", "segment", "n_ids", "doc_ids", "offsets", "lengths", "ids"])
            segment += 1

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # the text's hash parts rows that share one id
    rows = rows.withColumn("salt", F.xxhash64("text")).repartitionByRange("doc_id", "salt").sortWithinPartitions("doc_id", "salt").drop("salt")
    rows = rows.mapInArrow(run, "part int, segment int, n_ids long, doc_ids array<long>, offsets array<long>, lengths array<long>, ids binary")
    rows.select("part", "segment", "n_ids", "doc_ids", "offsets", "lengths", encoded("ids").alias("payload")).write.option("compression", "none").parquet(path)


def read_ids(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """One row per document of the files: doc_id, start (ids before it), n_tokens, ids_crc32, and its ids if wanted."""
    jvm.register(spark)
    files = spark.read.parquet(path)
    # a row for each segment: about a millionth of the ids
    before = files.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", (F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("part_start"))
    inside = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, 0)
    starts = files.select("part", "segment", (F.sum("n_ids").over(inside) - F.col("n_ids")).alias("own_start")).join(before, "part")
    starts = starts.select("part", "segment", (F.col("own_start") + F.col("part_start")).alias("start"))

    def document(ids: Column, d: Column) -> Column:
        own = F.substring(ids, F.lit(1) + 4 * d["offsets"].cast("int"), 4 * d["lengths"].cast("int"))
        return F.struct(d["doc_ids"].alias("doc_id"), d["offsets"].alias("offset"), d["lengths"].alias("n_tokens"), F.crc32(own).alias("ids_crc32"), *([own.alias("raw")] if with_ids else []))

    # a list of one, so that a payload is decoded once for all its documents
    whole = F.transform(F.array(decoded("payload")), lambda ids: F.when(F.octet_length(ids) == 4 * F.col("n_ids"), ids).otherwise(F.raise_error(F.lit("a segment doesn't have the ids of its documents"))))
    found = F.flatten(F.transform(whole, lambda ids: F.transform(F.arrays_zip("doc_ids", "offsets", "lengths"), lambda d: document(ids, d))))
    rows = files.select("part", "segment", F.explode(found).alias("d")).select("part", "segment", "d.*")
    out = rows.join(starts, ["part", "segment"])
    out = out.select("doc_id", (F.col("start") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32", *(["raw"] if with_ids else []))
    return out.mapInArrow(numbers, "doc_id long, start long, n_tokens long, ids_crc32 long, ids array<int>") if with_ids else out


def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column's little-endian 32-bit numbers as lists."""
    for batch in batches:
        raw = [np.frombuffer(x.as_buffer(), "<i4") for x in batch.column("raw")]
        ends = np.cumsum([0, *map(len, raw)]).astype(np.int32)
        ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*raw, np.zeros(0, np.int32)])))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], ids], [*batch.schema.names[:-1], "ids"])


def op8_mixing_coder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, written and read back."""
    path = scratch_path(spark, "token-ids")
    write_ids(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return read_ids(spark, path, with_ids=False)
