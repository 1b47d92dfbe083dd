"""Knowledge-graph statements to dated entities to article ids.

Statements come as one row each (see :func:`lexloom.sources.readers.turtle_statements`), so nothing depends on their order:
an entity's dates are aggregated, its links joined, and the last link wins by its ordinal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions import dates, entities


def property_dates(statements: DataFrame, properties: list[str], subject: Column, text: str = "statement") -> DataFrame:
    """(entity, date): every date of a statement that one of the properties, as a whole token, has: properties part by semicolons and the
    dates of one by commas."""
    objects = r'("[^"]*"[^\s;,]*(?:\s*,\s*"[^"]*"[^\s;,]*)*)'
    pattern = r"(?:^|[\s;])(?:" + "|".join(rf"\Q{p}\E" for p in properties) + r")\s+" + objects
    literals = F.flatten(F.transform(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(1)), lambda x: F.regexp_extract_all(x, F.lit('("[^"]+")'), F.lit(1))))
    found = statements.select(subject.alias("entity"), F.explode(literals).alias("literal"))
    return found.select("entity", dates.literal_date(F.col("literal")).alias("date")).where("entity IS NOT NULL AND date IS NOT NULL")


def date_ranges(dated: DataFrame, entity: str = "entity", date: str = "date") -> DataFrame:
    """(entity, earliest, latest)."""
    return dated.groupBy(F.col(entity).alias("entity")).agg(F.min(date).alias("earliest"), F.max(date).alias("latest"))


def last_links(links: DataFrame, entity: str = "entity", url: str = "url", ordinal: str = "ordinal") -> DataFrame:
    """(entity, url): the last link of each."""
    return links.where(F.col(url).isNotNull()).groupBy(F.col(entity).alias("entity")).agg(F.max_by(url, ordinal).alias("url"))


def with_links(ranges: DataFrame, links: DataFrame, linked_only: bool = True) -> DataFrame:
    return ranges.join(links, "entity", "inner" if linked_only else "left")


def resolve_titles(names: DataFrame, articles: DataFrame, redirects: DataFrame, name: str = "name") -> DataFrame:
    """``names`` with page_id and page_title: by the exact title, else with spaces for underscores, else through a redirect. ``articles`` has
    title and url; only those whose URL has an id count. Of equal titles the least id wins."""
    known = articles.select("title", entities.page_id(F.col("url")).alias("page_id")).where("page_id IS NOT NULL")
    known = known.groupBy("title").agg(F.min("page_id").alias("page_id"))
    # a source has one target
    moved = redirects.groupBy("source_title").agg(F.min("target_title").alias("target_title")).join(known.withColumnRenamed("title", "target_title"), "target_title").select("source_title", F.col("target_title").alias("title"), "page_id")

    def side(frame: DataFrame, key: str, tag: str) -> DataFrame:
        return frame.select(F.col(key).alias(f"__{tag}_key"), F.col("title").alias(f"__{tag}_title"), F.col("page_id").alias(f"__{tag}_id"))

    exact, spaced, redirect = side(known, "title", "exact"), side(known, "title", "spaced"), side(moved, "source_title", "moved")
    out = names.join(exact, F.col(name) == F.col("__exact_key"), "left")
    out = out.join(spaced, entities.spaced(F.col(name)) == F.col("__spaced_key"), "left")
    out = out.join(redirect, F.col(name) == F.col("__moved_key"), "left")
    ids, titles = [F.col(f"__{t}_id") for t in ("exact", "spaced", "moved")], [F.col(f"__{t}_title") for t in ("exact", "spaced", "moved")]
    out = out.withColumn("page_id", F.coalesce(*ids)).withColumn("page_title", F.coalesce(*titles))
    return out.drop(*[f"__{t}_{part}" for t in ("exact", "spaced", "moved") for part in ("key", "title", "id")])


def normalize(rows: DataFrame, articles: DataFrame, redirects: DataFrame, langlinks: DataFrame, skip_missing: bool = False) -> DataFrame:
    """Rows of (entity, url, earliest, latest) with page_id and page_title: by the entity's name, else by its link's title, which
    another language's langlinks (lang, title, english_title) translate."""
    found = resolve_titles(rows, articles, redirects, "entity").withColumnRenamed("page_id", "__own_id").withColumnRenamed("page_title", "__own_title")
    link = entities.language_and_title(F.col("url"))
    found = found.withColumn("__lang", link["lang"]).withColumn("__title", link["title"])
    names = langlinks.groupBy(F.col("lang").alias("__lang"), F.col("title").alias("__title")).agg(F.min("english_title").alias("__english"))
    found = found.join(names, ["__lang", "__title"], "left")
    found = found.withColumn("__name", F.when(F.col("__lang") == "en", F.col("__title")).otherwise(F.col("__english")))
    found = resolve_titles(found, articles, redirects, "__name")
    out = found.withColumn("page_id", F.coalesce("__own_id", "page_id")).withColumn("page_title", F.coalesce("__own_title", "page_title"))
    out = out.select(*rows.columns, "page_id", "page_title")
    return out.where("page_id IS NOT NULL") if skip_missing else out


def containing(queries: DataFrame, keyed: DataFrame) -> DataFrame:
    """Articles (id, title, __key) whose key contains a query in lower case. A title with the query has all its trigrams: the titles are joined by the query's
    rarest one, then verified. A query of one or two characters has none; its articles are sought by those characters."""

    def grams(text: Column, n: int) -> Column:
        return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - (n - 1), F.lit(1))), lambda i: F.substring(text, i, F.lit(n))))

    asked = queries.select("query", F.lower("query").alias("__q")).where("__q <> ''")
    size = F.least(F.length("__q"), F.lit(3))
    wanted = asked.select("query", "__q", F.explode(F.when(size == 3, grams(F.col("__q"), 3)).otherwise(F.array("__q"))).alias("__gram"))
    held = keyed.where("__key <> ''").select("id", "title", "__key", F.explode(F.array_distinct(F.concat(grams(F.col("__key"), 1), grams(F.col("__key"), 2), grams(F.col("__key"), 3)))).alias("__gram"))
    held = held.join(wanted.select("__gram").distinct(), "__gram", "left_semi")
    counts = held.groupBy("__gram").agg(F.count(F.lit(1)).alias("__n"))
    rarest = wanted.join(counts, "__gram", "left").groupBy("query", "__q").agg(F.min_by("__gram", F.struct(F.coalesce("__n", F.lit(0)), "__gram")).alias("__gram"))
    every = keyed.crossJoin(F.broadcast(queries.where("query = ''"))).select("query", "id", "title")  # the empty query, one at most, is in all titles
    return rarest.hint("merge").join(held, "__gram").where(F.contains("__key", F.col("__q"))).select("query", "id", "title").unionByName(every)


def title_lookup(queries: DataFrame, articles: DataFrame, redirects: DataFrame, query: str = "query") -> DataFrame:
    """(query, id, title, how): by the title in any case, else the shortest title that contains the query, else through a redirect. Ties
    by id. Articles are matched by an equi-join first; the containing titles are sought for the rest only. Neither queries nor titles are broadcast: both may be as many as the
    articles, and a broadcast that was planned from the size of files isn't taken back."""
    q = queries.select(F.col(query).alias("query")).where("query IS NOT NULL").distinct()
    # of the titles that are one but for case only the best can be an answer; so one row each, however many articles share it
    keyed = articles.groupBy(F.lower("title").alias("__key")).agg(F.min(F.struct(F.length("title").alias("n"), "id", "title")).alias("__best")).select("__best.id", "__best.title", "__key")
    exact = q.join(keyed.hint("merge"), F.lower("query") == F.col("__key")).select("query", "id", "title", F.lit("exact").alias("how"), F.lit(1).alias("__rank"))
    rest = q.join(exact.select("query").distinct().hint("merge"), "query", "left_anti")
    within = containing(rest, keyed).select("query", "id", "title", F.lit("contains").alias("how"), F.lit(2).alias("__rank"))
    moved = redirects.select(F.lower("source_title").alias("__source"), F.lower("target_title").alias("__key"))
    via = rest.join(moved.hint("merge"), F.lower("query") == F.col("__source")).join(keyed.hint("merge"), "__key").select("query", "id", "title", F.lit("redirect").alias("how"), F.lit(3).alias("__rank"))
    every = exact.unionByName(within).unionByName(via)
    best = Window.partitionBy("query").orderBy("__rank", F.length("title"), "id")
    return every.withColumn("__rn", F.row_number().over(best)).where("__rn = 1").drop("__rn", "__rank")
