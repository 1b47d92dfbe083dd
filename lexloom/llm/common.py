"""What the operators of this subpackage share: scratch tables, fixed expressions, star-edge components."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_SCRATCH: list[tuple[SparkSession, str]] = []
_LOCAL_ROOT: str | None = None


def shared_root(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``; only a single-JVM session may go without."""
    global _LOCAL_ROOT
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _LOCAL_ROOT is None:
        _LOCAL_ROOT = tempfile.mkdtemp(prefix="lexloom-")
    return _LOCAL_ROOT


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, removed when the driver's Python ends or by :func:`release`."""
    path = f"{shared_root(spark)}/lexloom/{name}-{uuid.uuid4().hex}"
    _SCRATCH.append((spark, path))
    return path


def write_scratch(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and reread it: the lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def release() -> None:
    """Remove all scratch tables; frames that still read them fail afterwards."""
    while _SCRATCH:
        spark, path = _SCRATCH.pop()
        try:
            if spark.sparkContext._jsc is not None:
                drop_path(spark, path)
        except (Py4JError, AttributeError, OSError):  # the context may be gone when Python ends
            continue


atexit.register(release)


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``; when a task ends, its Python gives the memory that it no longer needs back to the system. Spark keeps a worker for later stages, and what the heaps of
    each of them once took would add up."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError, TypeError):  # another C library
            pass

    return whole


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_fold(column: str, buckets: int) -> Column:
    """crc32 of the id as text, modulo ``buckets``; a null id counts as the empty string."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(buckets)).cast("int")


#: Row number that :func:`keyed` adds where ids can't tell rows apart.
ROW = "__row"


def keyed(docs: DataFrame, id_col: str) -> tuple[DataFrame, str]:
    """``docs`` and a column that tells its rows apart: the id, or a row number (then in a written copy) if ids are missing
    or repeated or aren't integers."""
    odd = docs.groupBy(id_col).count().where((F.col("count") > 1) | F.col(id_col).isNull())
    if docs.schema[id_col].dataType.typeName() in ("byte", "short", "integer", "long") and odd.isEmpty():
        return docs, id_col
    return write_scratch(docs.drop(ROW).withColumn(ROW, F.monotonically_increasing_id()), "keyed"), ROW


def components(edges: DataFrame, left: str = "a", right: str = "b", max_rounds: int = 60) -> DataFrame:
    """Connected components of an edge list of longs: one row (node, root) per node that has an edge; root is the least node.

    Alternates large-star and small-star contraction (Kiveris et al., 2014). Each round takes minima by partial
    aggregation and joins them back, so that a hub with most of the edges is pre-aggregated in the first step and split by
    the adaptive skew join in the second. Each round is written to the shared folder. Ends when every node points at a root.
    """
    spark = edges.sparkSession
    e = edges.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v")).where("u <> v").distinct()
    e = write_scratch(e, "edges")
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: every larger neighbour of u points at the least of u's neighbourhood
        large = e.select(F.col("u").alias("big"), F.col("v").alias("u")).join(low, "u").select(F.col("big").alias("u"), F.col("m").alias("v")).distinct()
        large = write_scratch(large, "large")
        # small star: u and its smaller neighbours point at the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").where("u <> v").distinct()
        small = write_scratch(small, "small")
        same = small.count() == e.count() and small.join(e, ["u", "v"], "left_anti").isEmpty()
        e = small
        if same:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
