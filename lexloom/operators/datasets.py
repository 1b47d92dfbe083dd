"""Sampling, splitting, mixing and ledgers of datasets. Every choice is by the MD5 of a key, so it is the same on every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shuffled_by(key: str | Column, seed: int) -> Column:
    """A key's place in a seeded shuffle."""
    k = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(k.cast("string"), F.lit(f":{seed}")))


def sample(df: DataFrame, key: str, n: int, seed: int, offset: int = 0) -> DataFrame:
    """``n`` rows of a seeded shuffle, after the first ``offset``."""
    return df.orderBy(shuffled_by(key, seed), key).offset(offset).limit(n) if offset else df.orderBy(shuffled_by(key, seed), key).limit(n)


def split(df: DataFrame, key: str, seed: int, train_percent: int = 90, buckets: int = 4096) -> DataFrame:
    """``df`` with ``split``: exactly floor(n * percent / 100) rows are ``train``, the first of a seeded shuffle.

    Only the counts of the shuffle's leading 12 bits meet in one place; rows are ranked within those.
    """
    rows = df.withColumn("__place", shuffled_by(key, seed)).withColumn("__bucket", F.conv(F.substring("__place", 1, 3), 16, 10).cast("int"))
    counts = rows.groupBy("__bucket").agg(F.count(F.lit(1)).alias("__n"))
    upto = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.select("__bucket", (F.sum("__n").over(upto) - F.col("__n")).alias("__before"), F.sum("__n").over(Window.partitionBy(F.lit(1))).alias("__all"))
    rank = F.row_number().over(Window.partitionBy("__bucket").orderBy("__place", key))
    out = rows.withColumn("__rank", rank).join(F.broadcast(counts), "__bucket")
    train = F.col("__rank") + F.col("__before") <= F.floor(F.col("__all") * F.lit(train_percent) / 100)
    return out.withColumn("split", F.when(train, "train").otherwise("validation")).drop("__place", "__bucket", "__rank", "__before", "__all")


def per_class(df: DataFrame, kind: str, key: str, n: int, seed: int) -> DataFrame:
    """``n`` rows of each class, the first of a seeded shuffle."""
    own = Window.partitionBy(kind).orderBy(shuffled_by(key, seed), key)
    return df.withColumn("__rn", F.row_number().over(own)).where(F.col("__rn") <= n).drop("__rn")


def equal_sample(df: DataFrame, kind: str, key: str, seed: int, limit: int | None = None) -> DataFrame:
    """As many rows of each class: half of the limit, or as many as the smallest has."""
    if limit is not None:
        return per_class(df, kind, key, limit // 2, seed)
    least = df.groupBy(kind).agg(F.count(F.lit(1)).alias("n")).agg(F.min("n")).first()[0] or 0
    return per_class(df, kind, key, least, seed)


def first_of(df: DataFrame, order: str, n: int) -> DataFrame:
    return df.orderBy(order).limit(n)


def dev_subset(parts: list[DataFrame], order: str, key: str, n: int, seed: int) -> DataFrame:
    """The first ``n`` rows of each part, together, with ``place`` in a seeded shuffle."""
    every = None
    for part in parts:
        some = first_of(part, order, n)
        every = some if every is None else every.unionByName(some)
    return every.withColumn("place", shuffled_by(key, seed))


def mixed(parts: dict[str, DataFrame], percents: dict[str, int], total: int, key: str, seed: int) -> DataFrame:
    """Rows of several parts by their percents of ``total``, with ``part``."""
    out = None
    for name, df in parts.items():
        some = sample(df, key, total * percents[name] // 100, seed).withColumn("part", F.lit(name))
        out = some if out is None else out.unionByName(some)
    return out


def review_sample(df: DataFrame, key: str, seed: int, most: int = 500) -> DataFrame:
    """A sample with empty columns for a reviewer's verdict."""
    return sample(df, key, most, seed).withColumns({"verdict": F.lit(None).cast("string"), "reviewer": F.lit(None).cast("string")})


def unused(df: DataFrame, used: DataFrame, key: str) -> DataFrame:
    return df.join(used.select(key), key, "left_anti")


def by_ids(df: DataFrame, wanted: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(the rows with a wanted id, the wanted ids that no row has)."""
    ids = wanted.select(key).distinct()
    return df.join(ids, key, "left_semi"), ids.join(df.select(key), key, "left_anti")


def appended(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """What exists, and the new rows whose key it doesn't have; repeated keys among the new rows all stay."""
    return existing.unionByName(new.join(existing.select(key), key, "left_anti").select(existing.columns))


def upserted(existing: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each key: the last by ``order``, where new rows come after existing ones."""
    both = existing.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    own = Window.partitionBy(key).orderBy(F.desc("__new"), F.desc(order))
    return both.withColumn("__rn", F.row_number().over(own)).where("__rn = 1").drop("__rn", "__new")


def ledger(used: DataFrame, added: DataFrame, key: str) -> DataFrame:
    """The set of all used ids."""
    return used.select(key).union(added.select(key)).distinct()


def topic_articles(topics: DataFrame, articles: DataFrame, used: DataFrame) -> DataFrame:
    """(article_id, topic_id, topic_class): articles that topics refer to, each by its first topic, without used ones, and without articles
    after the cutoff for topics before it. Topics: topic_id, topic_class, article_ids; articles: article_id, article_class."""
    refs = topics.select("topic_id", "topic_class", F.explode("article_ids").alias("article_id"))
    refs = refs.join(articles, "article_id").join(used.select("article_id"), "article_id", "left_anti")
    refs = refs.where(~((F.col("topic_class") == "pre_cutoff") & (F.col("article_class") == "post_cutoff")))
    own = Window.partitionBy("article_id").orderBy("topic_id")
    return refs.withColumn("__rn", F.row_number().over(own)).where("__rn = 1").select("article_id", "topic_id", "topic_class")


def unreferenced(related: Column, direct: Column) -> Column:
    """Related articles (title, article_id) that are no direct references, by title in any case or by id."""
    titles = F.transform(direct, lambda d: F.lower(d["title"]))
    ids = F.filter(F.transform(direct, lambda d: d["article_id"]), lambda i: i.isNotNull())
    return F.filter(related, lambda r: ~(F.coalesce(F.array_contains(titles, F.lower(r["title"])), F.lit(False)) | F.coalesce(F.array_contains(ids, r["article_id"]), F.lit(False))))
