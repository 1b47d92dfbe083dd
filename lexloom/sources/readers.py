"""Readers: files in, DataFrames out. Bad rows are dropped where the reader says so, never guessed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom import schemas

CORRUPT = "_corrupt_record"


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(value): the lines of text files; bz2 and gzip by their endings."""
    return spark.read.text(path)


def dump_pages(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, title, content) of a MediaWiki XML dump's article namespace."""
    pages = spark.read.format("xml").option("rowTag", "page").schema(schemas.PAGE).load(path)
    return pages.where("ns = 0").select(F.col("id").alias("page_id"), "title", F.col("revision.text._VALUE").alias("content"))


def extracted_articles(pages: DataFrame, site: str, clean, least: int = 100) -> DataFrame:
    """Articles (id, title, url, text) of dump pages: no redirects, no title with a colon, at least ``least`` clean characters."""
    from lexloom.functions.entities import page_url

    rows = pages.where(~F.startswith(F.lower(F.trim(F.coalesce("content", F.lit("")))), F.lit("#redirect")) & ~F.contains("title", F.lit(":")))
    out = rows.select(F.col("page_id").cast("string").alias("id"), "title", page_url(F.col("page_id"), site).alias("url"), clean(F.col("content")).alias("text"))
    return out.where(F.length("text") >= least)


def json_lines(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """JSON lines; blank and malformed ones are dropped."""
    raw = spark.read.text(path).where(F.trim("value") != "")
    parsed = raw.select(F.from_json("value", f"{schema}, {CORRUPT} string", {"columnNameOfCorruptRecord": CORRUPT}).alias("r")).select("r.*")
    return parsed.where(F.col(CORRUPT).isNull()).drop(CORRUPT)


def bad_json_lines(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """(value, file): the lines that :func:`json_lines` drops, for a log."""
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    return raw.where((F.trim("value") != "") & F.from_json("value", f"{schema}, {CORRUPT} string", {"columnNameOfCorruptRecord": CORRUPT})[CORRUPT].isNotNull())


def first_lines(spark: SparkSession, path: str, schema: str, most: int, text: str = "text", least: int = 100) -> DataFrame:
    """JSON lines with texts of ``least`` characters among the first ``most`` lines: files by name, lines as they stand in them."""
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("place"))
    raw = raw.orderBy("file", "start", "place").limit(most)
    parsed = raw.select(F.from_json("value", f"{schema}, {CORRUPT} string", {"columnNameOfCorruptRecord": CORRUPT}).alias("r")).select("r.*")
    return parsed.where(F.col(CORRUPT).isNull() & (F.length(text) >= least)).drop(CORRUPT)


def turtle_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line): Turtle lines, trimmed, without comments, blank ones and declarations."""
    return kept_turtle(spark.read.text(path), F.col("value")).withColumnRenamed("value", "line")


def kept_turtle(df: DataFrame, line: Column) -> DataFrame:
    return df.withColumn("value", F.trim(line)).where(~F.col("value").rlike(r"^($|#|@prefix|@base)"))


def turtle_statements(spark: SparkSession, path: str) -> DataFrame:
    """(statement, ordinal): one statement a row, whatever lines it is written on, so that no state is carried from line to line.
    A statement ends with a dot at a line's end, whatever stands before the dot; files stay splittable. The ordinal follows the order within the input."""
    rows = spark.read.option("lineSep", ".\n").text(path)
    # a dot and white space at a line's end, and line ends of two characters
    rows = rows.select(F.explode(F.split("value", r"\.[ \t]*\r?\n")).alias("value"))
    whole = F.regexp_replace("value", r"(?m)^\s*(#|@prefix|@base).*$", "")
    whole = F.regexp_replace(F.regexp_replace(whole, r"\s+", " "), r"[ .]+$", "")
    out = rows.select(F.trim(whole).alias("statement"), F.monotonically_increasing_id().alias("ordinal"))
    return out.where("statement <> ''")


def dated_entities(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Dated entities from CSV with a header; repeated headers and rows that are too short are dropped, a ``0`` date is null."""
    schema = schemas.DATED_ENTITY_WITH_ID if with_ids else schemas.DATED_ENTITY
    rows = spark.read.schema(schema).option("header", True).csv(path)
    rows = rows.where(~F.startswith("Entity", F.lit("Entity")) & F.col("Latest_Date").isNotNull())
    return rows.withColumns({c: F.when(F.col(c) != "0", F.col(c)) for c in ("Earliest_Date", "Latest_Date")})


def normalized_entities(spark: SparkSession, path: str) -> DataFrame:
    """By header name, whatever the columns' order."""
    rows = spark.read.option("header", True).csv(path)
    names = [c.split()[0] for c in schemas.NORMALIZED_ENTITY.split(", ")]
    return rows.select(*[F.col(n) if n in rows.columns else F.lit(None).cast("string").alias(n) for n in names])


def entity_json(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of entities whose keys are in lower or title case."""
    keys = [c.split()[0] for c in schemas.DATED_ENTITY.split(", ")]
    raw = spark.read.text(path, wholetext=True)
    items = F.explode(F.from_json(F.col("value"), "array<map<string,string>>"))
    rows = raw.select(items.alias("m"))
    return rows.select(*[F.coalesce(F.try_element_at("m", F.lit(k)), F.try_element_at("m", F.lit(k.lower()))).alias(k) for k in keys])


def year_files(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """Year-topic files, the year from the file's name; where both years are given, files outside them aren't listed for the scan."""
    name = F.regexp_extract(F.col("_metadata.file_name"), r"(\d{4})", 1).cast("int")
    source = spark.read.schema(schemas.YEAR_TOPICS).option("multiLine", True)
    if first is not None and last is not None:
        source = source.option("pathGlobFilter", "*{" + ",".join(f"{y:04d}" for y in range(first, max(first, last) + 1)) + "}*")
    rows = source.json(path).withColumn("file_year", name)
    if first is not None:
        rows = rows.where(F.col("file_year") >= first)
    if last is not None:
        rows = rows.where(F.col("file_year") <= last)
    return rows


def table(spark: SparkSession, url: str | None = None, name: str = "", path: str | None = None, **options: str) -> DataFrame:
    """A stored table: Parquet at ``path``, or a relational one by JDBC, whose filters and columns are pushed down."""
    if path is not None:
        return spark.read.parquet(path)
    return spark.read.format("jdbc").option("url", url).option("dbtable", name).options(**options).load()


def by_id(df: DataFrame, key: str, value) -> DataFrame:
    return df.where(F.col(key) == value)


def not_done(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't done yet."""
    return df.join(done.select(key), key, "left_anti")
