"""Date ranges of articles: merging, classes by a cutoff, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions import dates


def usable_dates(rows: DataFrame, id_col: str, earliest: str, latest: str, today: Column | None = None) -> DataFrame:
    """Rows (id, earliest, latest) with an id and two valid dates, as dates."""
    out = rows.select(F.col(id_col).alias("id"), dates.valid_date(F.col(earliest), today).alias("earliest"), dates.valid_date(F.col(latest), today).alias("latest"))
    return out.where("id IS NOT NULL AND earliest IS NOT NULL AND latest IS NOT NULL")


def one_per_id(rows: DataFrame, last_wins_by: str | None = None) -> DataFrame:
    """(id, earliest, latest): the widest range of each id, or its last row's."""
    if last_wins_by:
        return rows.groupBy("id").agg(F.max_by("earliest", last_wins_by).alias("earliest"), F.max_by("latest", last_wins_by).alias("latest"))
    return rows.groupBy("id").agg(F.min("earliest").alias("earliest"), F.max("latest").alias("latest"))


def merge_dates(articles: DataFrame, facts: DataFrame) -> DataFrame:
    """Articles (id, earliest, latest, ...) with the facts' ranges merged in and status: new, updated, unchanged, or null without a
    fact. Both sides have one row for an id."""
    f = facts.select(F.col("id").alias("__id"), F.col("earliest").alias("__earliest"), F.col("latest").alias("__latest"))
    out = articles.join(f, F.col("id") == F.col("__id"), "left")
    low, high = F.least("earliest", "__earliest"), F.greatest("latest", "__latest")
    had = F.col("earliest").isNotNull() | F.col("latest").isNotNull()
    same = low.eqNullSafe(F.col("earliest")) & high.eqNullSafe(F.col("latest"))
    status = F.when(F.col("__id").isNull(), F.lit(None)).when(~had, "new").when(same, "unchanged").otherwise("updated")
    out = out.withColumn("status", status).withColumn("__low", low).withColumn("__high", high)
    return out.withColumn("earliest", F.col("__low")).withColumn("latest", F.col("__high")).drop("__id", "__earliest", "__latest", "__low", "__high")


def unmatched(facts: DataFrame, articles: DataFrame) -> DataFrame:
    return facts.join(articles.select("id"), "id", "left_anti")


def without_odd_dates(articles: DataFrame, today: Column | None = None) -> DataFrame:
    """Dates outside year 1 to the current one become null, and has_dates says whether any is left."""
    year = F.year(today if today is not None else F.current_date())
    keep = lambda c: F.when(F.year(c).between(1, year), F.col(c))
    out = articles.withColumns({"earliest": keep("earliest"), "latest": keep("latest")})
    return out.withColumn("has_dates", F.col("earliest").isNotNull() | F.col("latest").isNotNull())


def class_counts(articles: DataFrame, cutoff: str, content: str | None = None, longer_than: int = 500) -> DataFrame:
    """One row: rows before, after and across the cutoff, and with dates at all, in one pass."""
    e, latest = F.col("earliest"), F.col("latest")
    long = F.length(F.coalesce(F.col(content), F.lit(""))) > longer_than if content else F.lit(True)
    dated = e.isNotNull() | latest.isNotNull()
    return articles.agg(
        F.count_if(dated & long & dates.pre_cutoff(e, latest, cutoff)).alias("pre_cutoff"),
        F.count_if(dated & long & dates.post_cutoff(e, cutoff)).alias("post_cutoff"),
        F.count_if(dated & long & dates.spanning(e, latest, cutoff)).alias("spanning"),
        F.count_if(dated).alias("dated"),
    )


def coverage(articles: DataFrame) -> DataFrame:
    """One row: all, with dates, without, percent (0 for no rows), first and last date."""
    dated = F.col("earliest").isNotNull() | F.col("latest").isNotNull()
    return articles.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(dated).alias("with_dates"),
        F.count_if(~dated).alias("without_dates"),
        F.round(F.coalesce(F.try_divide(100.0 * F.count_if(dated), F.count(F.lit(1))), F.lit(0.0)), 2).alias("percent"),
        F.min("earliest").alias("first_date"),
        F.max("latest").alias("last_date"),
    )


def by_century(articles: DataFrame, date: str = "earliest") -> DataFrame:
    century = (F.floor(F.year(date) / 100) * 100).cast("int")
    return articles.where(F.col(date).isNotNull()).groupBy(century.alias("century")).agg(F.count(F.lit(1)).alias("n"))


def by_year(articles: DataFrame, date: str = "earliest", most: int | None = 50) -> DataFrame:
    """(year, n), the latest first; ``most`` of them."""
    out = articles.where(F.col(date).isNotNull()).groupBy(F.year(date).alias("year")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("year"))
    return out if most is None else out.limit(most)


def overlapping(articles: DataFrame, start: str, end: str) -> DataFrame:
    return articles.where((F.col("earliest") <= F.to_date(F.lit(end))) & (F.col("latest") >= F.to_date(F.lit(start))))


def active_before(articles: DataFrame, cutoff: str) -> DataFrame:
    return articles.where(F.col("earliest") < F.to_date(F.lit(cutoff)))


def ended_before(articles: DataFrame, cutoff: str) -> DataFrame:
    """Rows whose range has a length and ends before the cutoff."""
    return articles.where((F.col("latest") < F.to_date(F.lit(cutoff))) & (F.col("earliest") < F.col("latest")))


def cutoff_dataset(rows: DataFrame, cutoff: str) -> DataFrame:
    """Rows that begin by the cutoff, renamed for training."""
    return rows.where(F.col("earliest") <= F.to_date(F.lit(cutoff))).select(F.col("id").alias("source_article_id"), F.col("title").alias("source_title"), F.col("earliest").alias("earliest_date"), F.col("latest").alias("latest_date"))
