"""Packing of documents into sequences by best-fit decreasing.

Documents are encoded, ended by an id, and cut: overlong ones first into full windows, so that one remainder is left.
Best-fit decreasing then runs once over the whole corpus, exactly, and yet with bounded work on the driver: only the
number of pieces of each length matters to it, and there are no more lengths than the capacity. Windows with equal room
are kept as intervals of window numbers; a segment tree indexed by remaining capacity finds the tightest open windows, and
all equal pieces that fit are placed in one step. The resulting plan, runs of pieces by length and rank, is then applied to the
pieces in parallel.

Ranks within a length are dealt by a hash of the id, so that a length that a third of all pieces share has many tasks.

Defined results: a null or empty text is one piece, its end id; repeated rows are packed as often as they occur; a null
id stays null; an empty table gives no pieces. Other columns aren't read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom.llm import tokens
from lexloom.llm.common import trimmed, write_scratch

#: Text bytes that are encoded at a time: the arrays beside them take many times as much, in each Python worker of an executor.
PART_BYTES = 2 << 20
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class CapacityTree:
    """Which remaining capacities have open windows; finds the least one that is large enough."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << capacity.bit_length()
        self.any = [False] * (2 * self.size)

    def put(self, room: int, value: bool) -> None:
        at = self.size + room
        self.any[at] = value
        while at > 1:
            at >>= 1
            self.any[at] = self.any[2 * at] or self.any[2 * at + 1]

    def tightest(self, least: int) -> int | None:
        at = self.size + least
        if self.any[at]:
            return least
        while at > 1:
            if not at & 1 and self.any[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.any[2 * at] else 2 * at + 1
                return at - self.size
            at >>= 1
        return None


def best_fit_plan(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Best-fit decreasing of counts[length] pieces: rows (length, first rank, pieces, first window, offset).

    The pieces of one length with ranks from ``first rank`` on go to as many windows from ``first window`` on, one each.
    """
    rooms: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
    tree, windows, plan = CapacityTree(capacity), 0, []

    def put(room: int, first: int, n: int) -> None:
        if room and n:
            rooms[room].append((first, n))
            tree.put(room, True)

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                room, first, n = capacity, windows, -(-left // (capacity // length))
                windows += n
            else:
                first, n = rooms[room].pop()
                if not rooms[room]:
                    tree.put(room, False)
            fit = room // length
            k = min(n, left // fit)
            if not k:  # the last pieces share one window
                k, fit = 1, left
            for j in range(fit):
                plan.append((length, rank + j * k, k, first, capacity - room + j * length))
            rank, left = rank + fit * k, left - fit * k
            put(room - fit * length, first, k)
            put(room, first + k, n - k)
    return np.array(plan, np.int64).reshape(-1, 5)


def cut(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, length) of the pieces of documents with so many ids each: full windows, then the remainder."""
    n = -(-lengths // capacity)
    doc = np.repeat(np.arange(len(lengths)), n)
    start = (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * capacity
    return doc, start, np.minimum(capacity, lengths[doc] - start)


def encoded_pieces(docs: DataFrame, path: str, capacity: int, end_id: int, with_ids: bool, id_col: str, text_col: str) -> DataFrame:
    schema = PIECES + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in tokens.by_bytes(whole, "text", PART_BYTES)):
            ids, bounds = tokens.encode(path, batch.column("text"), end_id)
            doc, start, length = cut(np.diff(bounds), capacity)
            at, view = bounds[doc] + start, memoryview(ids.astype("<u4", copy=False)).cast("B")
            sums = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(at.tolist(), (at + length).tolist(), strict=True)]
            cols = [batch.column("doc_id").take(pa.array(doc)), start, length, np.array(sums, np.int64), np.diff(bounds)[doc]]
            if with_ids:
                cols.append(pa.ListArray.from_arrays(pa.array(np.append(at, len(ids)).astype(np.int32)), pa.array(ids.astype(np.int32))))
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"][: len(cols)]
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in cols], names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(trimmed(run), schema)


def pack(docs: DataFrame, path: str | None = None, capacity: int = 1024, end_id: int = 0, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text", splits: int = 1024) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id (from 0, without gaps), offset; and
    ``ids`` if wanted. Sequences are padded to ``capacity`` by whoever writes them; nothing overlaps."""
    pieces = write_scratch(encoded_pieces(docs, path or tokens.default_path(), capacity, end_id, with_ids, id_col, text_col), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each length, capacity at most
    plan = best_fit_plan(counts, capacity)
    plan = plan[np.lexsort((plan[:, 1], plan[:, 0]))]
    table = docs.sparkSession.sparkContext.broadcast(plan)  # its size depends on the capacity, not on the corpus

    split = F.pmod(F.xxhash64("doc_id", "start"), F.lit(splits)).cast("int")
    rows = pieces.withColumn("split", split)
    parts = rows.groupBy("length", "split").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("split").rowsBetween(Window.unboundedPreceding, 0)
    parts = parts.select("length", "split", (F.sum("n").over(before) - F.col("n")).alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "split").orderBy("doc_id", "start")) - 1
    ranked = rows.withColumn("own", own).join(parts, ["length", "split"]).withColumn("rank", F.col("own") + F.col("before")).drop("own", "before", "split")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = table.value
        keys = steps[:, 0] << 44 | steps[:, 1]
        for batch in batches:
            rank = batch.column("rank").to_numpy().astype(np.int64)
            at = np.searchsorted(keys, batch.column("length").to_numpy() << 44 | rank, side="right") - 1
            names = [x for x in batch.schema.names if x != "rank"]
            cols = [batch.column(x) for x in names] + [pa.array(steps[at, 3] + rank - steps[at, 1]), pa.array(steps[at, 4])]
            yield pa.RecordBatch.from_arrays(cols, [*names, "sequence_id", "offset"])

    names = [x for x in ranked.columns if x != "rank"]
    schema = ", ".join([f"{x} {ranked.schema[x].dataType.simpleString()}" for x in names] + ["sequence_id long", "offset long"])
    return ranked.select(*names, "rank").mapInArrow(trimmed(place), schema)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 1024 ids."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
