"""Sharding along a Hilbert curve.

Several metadata dimensions are quantised to ``bits`` bits each, equally deep by approximate quantiles; the cells are
ordered by their index on a Hilbert curve; the rows, sorted by cell, are cut into runs whose counts differ by one at
most. Rows that are near in every dimension land in the same files, so that a reader's filters on any of the dimensions
prune files by their statistics. DataFrame functions only.

No row number is taken over all rows or over a cell: each cell is split by a hash of the id into ``splits`` parts, whose
counts are summed ahead, so that one source or one group of copies with a third of all rows is ranked in many tasks.

Defined results: a null in a dimension is less than every value; a null text has no bytes; repeated rows each get their
own slot, in any order; an empty table gives an empty result. Result columns replace columns of the same names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom.llm.common import write_scratch


#: Different values of a string column that are ranked in one task, about.
VALUES = 10_000


def hilbert_index(point: tuple[int, ...], bits: int) -> int:
    """Place of a grid point on the Hilbert curve, by Skilling's transposition (2004)."""
    x = list(point)
    n = len(x)
    high = 1 << (bits - 1)
    q = high
    while q > 1:
        low = q - 1
        for i in range(n):
            if x[i] & q:
                x[0] ^= low
            else:
                swap = (x[0] ^ x[i]) & low
                x[0] ^= swap
                x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = 0
    q = high
    while q > 1:
        if x[n - 1] & q:
            turn ^= q - 1
        q >>= 1
    x = [v ^ turn for v in x]
    out = 0
    for b in range(bits - 1, -1, -1):
        for v in x:
            out = out << 1 | (v >> b & 1)
    return out


def text_bounds(df: DataFrame, column: str, parts: int) -> list[str]:
    """At most ``parts`` - 1 values of a string column that part its rows about equally, in the order of the values' whole bytes. They follow from the counts of all
    its different values, however many: these are dealt out by ranges and summed up within each, and only the sums of the ranges and the bounds reach the driver."""
    counts = write_scratch(df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n")), "values")
    different, total = counts.agg(F.count(F.lit(1)), F.sum("n")).first()
    ranged = write_scratch(counts.repartitionByRange(different // VALUES + 1, "value").withColumn("range", F.spark_partition_id()), "value-ranges")
    upto, starts = 0, []
    for r in ranged.groupBy("range").agg(F.sum("n").alias("n")).orderBy("range").collect():
        starts.append((r["range"], upto))
        upto += r["n"]
    before = df.sparkSession.createDataFrame(starts, "range int, start long")
    running = F.sum("n").over(Window.partitionBy("range").orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    ends = ranged.withColumn("end", running).join(F.broadcast(before), "range").withColumn("end", F.col("start") + F.col("end"))
    # a value is a bound if one of the cuts lies within its rows; the last value has none above it
    share = lambda at: F.expr(f"({at}) * {parts}L div {total or 1}L")
    bounds = ends.where((F.col("end") < F.lit(total or 0)) & (share("end - n") != share("end")))
    return sorted((r["value"] for r in bounds.select("value").collect()), key=str.encode)


def text_code(column: Column, bounds: list[str]) -> Column:
    """How many of the bounds are less than a string; null for null."""
    at = sum(((column > F.lit(b)).cast("long") for b in bounds), F.lit(0).cast("long"))
    return F.when(column.isNotNull(), at)


def cells(df: DataFrame, dims: list[str], bits: int) -> Column:
    """Hilbert index of a row's cell; the quantile bounds, 2^bits - 1 numbers a dimension, are taken from ``df``."""
    parts = (1 << bits) - 1
    ask = [F.percentile_approx(F.col(d), [(i + 1) / (parts + 1) for i in range(parts)], 10_000).alias(d) for d in dims]
    bounds = df.agg(*ask).first()
    code = F.lit(0)
    for d in dims:
        at = sum(((F.col(d) > F.lit(b)).cast("int") for b in bounds[d] or []), F.lit(0))
        code = code * F.lit(1 << bits) + F.coalesce(at, F.lit(0))
    n = len(dims)
    table = [hilbert_index(tuple(c >> bits * (n - 1 - i) & parts for i in range(n)), bits) for c in range(1 << bits * n)]
    return F.element_at(F.expr(f"array({','.join(map(str, table))})"), code.cast("int") + 1)


def hilbert_shards(df: DataFrame, dims: list[str], shards: int, id_col: str = "doc_id", bits: int = 4, splits: int = 256) -> DataFrame:
    """``df`` with cell, shard and slot (place in the shard, from 0). ``dims``: numeric columns of ``df``.

    At most 2^(bits * len(dims)) cells; keep that product at 16 or less, since the cells' table is a literal.
    """
    if bits * len(dims) > 16:
        raise ValueError("bits * len(dims) must be 16 or less")
    rows = df.drop("cell", "shard", "slot").withColumn("cell", cells(df, dims, bits)).withColumn("__split", F.pmod(F.xxhash64(F.col(id_col)), F.lit(splits)).cast("int"))
    counts = rows.groupBy("cell", "__split").agg(F.count(F.lit(1)).alias("__n"))
    per_cell = counts.groupBy("cell").agg(F.sum("__n").alias("__n"))
    before = per_cell.select("cell", (F.sum("__n").over(Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n")).alias("__before"))
    within = Window.partitionBy("cell").orderBy("__split").rowsBetween(Window.unboundedPreceding, 0)
    starts = counts.withColumn("__start", F.sum("__n").over(within) - F.col("__n")).join(before, "cell").select("cell", "__split", (F.col("__start") + F.col("__before")).alias("__start"))
    total = df.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    rank = F.row_number().over(Window.partitionBy("cell", "__split").orderBy(id_col))
    ranked = rows.withColumn("__rank", rank).join(starts, ["cell", "__split"]).withColumn("__rank", F.col("__rank") - 1 + F.col("__start"))
    out = ranked.withColumn("shard", F.expr(f"CAST(__rank * {shards} div {max(total, 1)} AS INT)"))
    first = F.expr(f"(shard * {max(total, 1)}L + {shards - 1}L) div {shards}")
    return out.withColumn("slot", (F.col("__rank") - first).cast("long")).drop("__rank", "__split", "__start")


def write_shards(df: DataFrame, path: str) -> None:
    """Write the result of :func:`hilbert_shards`: a folder per shard, in slot order, pruned by partition and by statistics."""
    df.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def metadata(docs: DataFrame, bits: int = 4) -> DataFrame:
    """doc_id, size, crc and the numeric dimensions of documents: size in bytes, language and source in sort order."""
    langs, sources = (text_bounds(docs, c, 1 << bits) for c in ("lang", "source"))
    return docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        text_code(F.col("lang"), langs).alias("lang_code"),
        text_code(F.col("source"), sources).alias("source_code"),
    )


def op6_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards by source, language and size."""
    rows = write_scratch(metadata(spark.read.parquet(f"{sf_dir}/documents.parquet")), "metadata")
    out = hilbert_shards(rows, ["source_code", "lang_code", "size"], 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "cell")
