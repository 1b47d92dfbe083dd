"""Benchmark decontamination by spaced-seed hashing.

Texts become words. A mask such as 1101 reads some of the words in a window and ignores the others, so that a
substituted word spoils only the windows that read it. The hashes of all windows of the benchmark under all masks are
joined with those of the documents; around each hit the two texts are laid on one another and the longest overlap in which
at least ``similarity`` of the words agree is a leak if it agrees in ``least`` words, or in all of a shorter item.

The benchmark's hashes are broadcast in blocks of at most ``block_words`` words: one block, and one pass over the
documents, for up to that many; a larger benchmark takes a pass for each block.

Defined results: a null or empty text or item leaks nothing; items shorter than a mask are looked for as a whole;
repeated rows each give their own leaks; a null id stays null; an empty table on either side gives no rows. Columns other
than ids and texts aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm.common import trimmed
from lexloom.llm.tokens import by_bytes
from lexloom.llm.words import hashes, letter_words, rolling

#: Positions that are read have a 1. Weight six each; any two differ in most distances between them.
MASKS = ("11011011", "1101001011", "111000111", "1010110011")
SIMILARITY, LEAST_WORDS, BLOCK_WORDS = 0.8, 10, 2_000_000
LEAKS = "doc_id long, item_id long, start long, end long, item_start long, item_end long, agreeing long, similarity double"


def offsets(mask: str) -> list[int]:
    return [i for i, x in enumerate(mask) if x == "1"]


def longest_overlap(agree: np.ndarray, similarity: float) -> tuple[int, int]:
    """Bounds of the longest stretch with at least this share of agreement that begins and ends in agreement."""
    sums = np.concatenate([[0], np.cumsum(agree)]) - similarity * np.arange(len(agree) + 1)
    lows = np.minimum.accumulate(sums)
    first = np.searchsorted(-lows, -(sums + 1e-9), side="left")
    lengths = np.arange(len(sums)) - first
    end = int(np.argmax(lengths))
    start = int(first[end])
    found = np.flatnonzero(agree[start:end])
    return (start + int(found[0]), start + int(found[-1]) + 1) if len(found) else (0, 0)


class Seeds:
    """All windows of a block of items: sorted hashes with their item and place, by mask."""

    def __init__(self, ids: list[int | None], texts: list[str | None], masks: tuple[str, ...] = MASKS) -> None:
        index, bounds, words = letter_words(pa.array(texts, pa.string()))
        values = hashes(words)[index]
        self.ids, self.bounds, self.values = ids, bounds, values
        lengths = np.diff(bounds)
        item = np.repeat(np.arange(len(ids)), lengths)
        left = bounds[1:][item] - np.arange(len(values)) if len(values) else np.zeros(0, np.int64)
        shortest = max(map(len, masks))
        self.masks = [(offsets(m), len(m), None) for m in masks]
        self.masks += [(list(range(n)), n, n) for n in sorted({int(x) for x in lengths if 0 < x < shortest})]
        self.tables = []
        for reads, span, only in self.masks:
            hashed = rolling(values, reads)
            at = np.flatnonzero((left[: len(hashed)] >= span) & ((lengths[item[: len(hashed)]] == only) if only else True))
            order = at[np.argsort(hashed[at], kind="stable")]
            table = hashed[order]
            # a filter that spares most windows the search; its size follows the table's
            shift = np.uint64(64 - max(16, len(table).bit_length() + 5))
            seen = np.zeros(1 << 64 - int(shift), bool)
            seen[table >> shift] = True
            self.tables.append((table, order, item[order], seen, shift))

    def leaks(self, values: np.ndarray, bounds: np.ndarray, similarity: float, least: int) -> list[tuple]:
        """(text, item, start, end, item start, item end, agreeing) for texts with these words."""
        found = []
        doc_of = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        for (reads, span, _), (table, places, items, seen, shift) in zip(self.masks, self.tables, strict=True):
            hashed = rolling(values, reads)
            at = np.flatnonzero(seen[hashed >> shift])
            at = at[at + span <= bounds[1:][doc_of[at]]]
            low, high = np.searchsorted(table, hashed[at], side="left"), np.searchsorted(table, hashed[at], side="right")
            n = high - low
            at = np.repeat(at, n)
            hit = np.repeat(low - np.cumsum(n) + n, n) + np.arange(len(at))
            found.append(np.stack([doc_of[at], items[hit], at - places[hit]], axis=1))
        lines = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 3), np.int64)
        best: dict[tuple[int, int], tuple] = {}
        for doc, item, shift in lines.tolist():
            a = max(int(self.bounds[item]), int(bounds[doc]) - shift)
            b = min(int(self.bounds[item + 1]), int(bounds[doc + 1]) - shift)
            agree = self.values[a:b] == values[a + shift : b + shift]
            x, y = longest_overlap(agree, similarity)
            same = int(agree[x:y].sum())
            if same < min(least, int(self.bounds[item + 1] - self.bounds[item])):
                continue
            row = (same, -(a + x + shift), doc, item, a + x + shift - int(bounds[doc]), a + y + shift - int(bounds[doc]), a + x - int(self.bounds[item]), a + y - int(self.bounds[item]))
            if (doc, item) not in best or row > best[doc, item]:
                best[doc, item] = row
        return [(doc, item, s, e, i, j, same) for same, _, doc, item, s, e, i, j in best.values()]


def seed_blocks(benchmark: DataFrame, block_words: int, item_col: str, item_text_col: str) -> Iterator[Broadcast]:
    """The benchmark's windows, broadcast in blocks of about ``block_words`` words."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("text"))
    total = items.agg(F.sum(F.size(F.split(F.coalesce("text", F.lit("")), "\\s+")))).first()[0] or 0
    blocks = max(1, -(-total // block_words))
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        yield spark.sparkContext.broadcast(Seeds([r["item_id"] for r in rows], [r["text"] for r in rows]))


def leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, least: int = LEAST_WORDS, block_words: int = BLOCK_WORDS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row for each document and item that overlap, with the overlap in which most words agree (places count words)."""
    docs, out = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), None
    for seeds in seed_blocks(benchmark, block_words, item_col, item_text_col):

        def run(batches: Iterator[pa.RecordBatch], seeds: Broadcast = seeds) -> Iterator[pa.RecordBatch]:
            for batch in (part for whole in batches for part in by_bytes(whole, "text")):
                index, bounds, words = letter_words(batch.column("text"))
                found = seeds.value.leaks(hashes(words)[index], bounds, similarity, least)
                if found:
                    doc, item, start, end, first, last, same = zip(*found, strict=True)
                    ids = [batch.column("doc_id").take(pa.array(doc)), pa.array([seeds.value.ids[x] for x in item], pa.int64())]
                    cols = [pa.array(x, pa.int64()) for x in (start, end, first, last, same)]
                    share = pa.array([s / (e - b) for s, b, e in zip(same, start, end, strict=True)])
                    yield pa.RecordBatch.from_arrays([*ids, *cols, share], [x.split()[0] for x in LEAKS.split(", ")])

        part = docs.mapInArrow(trimmed(run), LEAKS)
        out = part if out is None else out.unionByName(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, least: int = LEAST_WORDS, block_words: int = BLOCK_WORDS, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that leak nothing, with all their columns."""
    for seeds in seed_blocks(benchmark, block_words, item_col, item_text_col):

        def run(batches: Iterator[pa.RecordBatch], seeds: Broadcast = seeds) -> Iterator[pa.RecordBatch]:
            for batch in (part for whole in batches for part in by_bytes(whole, text_col)):
                index, bounds, words = letter_words(batch.column(text_col).cast(pa.string()))
                keep = np.ones(batch.num_rows, bool)
                keep[[x[0] for x in seeds.value.leaks(hashes(words)[index], bounds, similarity, least)]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(trimmed(run), docs.schema)
    return docs


def op10_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against the whole benchmark."""
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
