"""Keyword lexicons over chunks: counts by theme, filters, totals and distributions.

A lexicon is a map from a theme to its keywords. A keyword counts once a chunk, and once for each theme that has it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = r"[\p{L}\p{N}_]+"


def words_of(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(WORDS), F.lit(0)))


def theme_count(text: Column, words: Column, keywords: list[str]) -> Column:
    single = sorted({k for k in keywords if " " not in k})
    several = sorted({k for k in keywords if " " in k})
    n = F.size(F.array_intersect(words, F.array(*[F.lit(k) for k in single]).cast("array<string>")))
    for k in several:
        n = n + F.regexp_like(F.lower(text), F.lit(rf"\b\Q{k}\E\b")).cast("int")
    return n


def keyword_counts(df: DataFrame, lexicon: dict[str, list[str]], text: str = "text") -> DataFrame:
    """``df`` with an int column for each theme, and ``total``."""
    whole = F.coalesce(F.col(text), F.lit(""))
    # a list of one and a generator, so that the words are split once for all themes and whatever filters follow
    counts = F.transform(F.array(words_of(whole)), lambda words: F.struct(*[theme_count(whole, words, own).alias(theme) for theme, own in lexicon.items()]))
    counts = F.transform(counts, lambda c: F.struct(*[c[t].alias(t) for t in lexicon], sum((c[t] for t in lexicon), F.lit(0)).alias("total")))
    return df.select("*", F.inline(counts))


def as_map(df: DataFrame, themes: list[str]) -> DataFrame:
    pairs = [x for t in [*themes, "total"] for x in (F.lit(t), F.col(t))]
    return df.withColumn("keyword_counts", F.create_map(*pairs)).drop(*themes, "total")


def occurrences(text: Column, keywords: list[str]) -> Column:
    """How often any of the keywords occurs as a whole word."""
    alternatives = "|".join(rf"\Q{k}\E" for k in sorted(set(keywords), key=lambda k: (-len(k), k)))
    return F.regexp_count(F.lower(text), F.lit(rf"\b(?:{alternatives})\b"))


def at_least(df: DataFrame, least: int) -> DataFrame:
    return df.where(F.col("total") >= least)


def in_range(df: DataFrame, least: int, most: int) -> DataFrame:
    return df.where(F.col("total").between(least, most))


def theme_totals(df: DataFrame, themes: list[str]) -> DataFrame:
    """(theme, hits) over all rows."""
    sums = df.agg(*[F.coalesce(F.sum(t), F.lit(0)).cast("long").alias(t) for t in themes])
    return sums.unpivot([], themes, "theme", "hits")


def theme_matrix(df: DataFrame, themes: list[str]) -> DataFrame:
    """A row for each theme with a column for each total that occurs (n_<total>), and all."""
    sums = df.groupBy("total").agg(*[F.sum(t).cast("long").alias(t) for t in themes]).unpivot(["total"], themes, "theme", "hits")
    return sums.groupBy("theme").pivot("total").agg(F.sum("hits")).na.fill(0)


def bucket_distribution(df: DataFrame, least: int, most: int) -> DataFrame:
    """(total, n, percent of all rows) for each total in the range, empty ones too."""
    spark = df.sparkSession
    counts = df.groupBy("total").agg(F.count(F.lit(1)).alias("n"))
    every = df.agg(F.count(F.lit(1)).alias("all"))
    buckets = spark.range(least, most + 1).select(F.col("id").cast("int").alias("total"))
    out = buckets.join(counts, "total", "left").crossJoin(F.broadcast(every))
    return out.select("total", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.round(F.coalesce(F.try_divide(100.0 * F.coalesce("n", F.lit(0)), F.col("all")), F.lit(0.0)), 2).alias("percent"))
