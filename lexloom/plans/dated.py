"""Date facts: orders stand for dated facts, customers for the entities they are about."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions import dates
from lexloom.operators import datasets, graph, temporal
from lexloom.plans.registry import query, table

CUTOFF, TODAY = "1998-07-20", "2026-01-01"
RANGES = "SELECT o_custkey AS id, min(o_orderdate)::DATE AS earliest, max(o_orderdate)::DATE AS latest FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL"


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("entity"), F.col("o_orderdate").cast("date").alias("date"))


def ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.date_ranges(facts(spark, sf_dir)).withColumnRenamed("entity", "id")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer with its range, if it has one."""
    every = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"))
    return every.join(ranges(spark, sf_dir), "id", "left")


ARTICLES = f"SELECT c_custkey AS id, c_name AS title, earliest, latest FROM customer LEFT JOIN ({RANGES}) ON c_custkey = id"


@query(f"SELECT id AS entity, c_name AS title, earliest, latest FROM ({RANGES}) JOIN customer ON c_custkey = id")
def entity_date_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"))
    return ranges(spark, sf_dir).join(names, "id").select(F.col("id").alias("entity"), "title", "earliest", "latest")


@query(f"""SELECT count(*) AS total, count(earliest) AS with_dates, count(*) - count(earliest) AS without_dates,
round(100.0 * count(earliest) / count(*), 2)::DOUBLE AS percent, min(earliest) AS first_date, max(latest) AS last_date FROM ({ARTICLES})""")
def coverage_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.coverage(articles(spark, sf_dir))


@query(f"SELECT (year(earliest) // 100 * 100)::INT AS century, count(*) AS n FROM ({ARTICLES}) WHERE earliest IS NOT NULL GROUP BY ALL")
def century_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.by_century(articles(spark, sf_dir))


@query(f"SELECT year(earliest)::INT AS year, count(*) AS n FROM ({ARTICLES}) WHERE earliest IS NOT NULL GROUP BY ALL ORDER BY year DESC LIMIT 50")
def year_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.by_year(articles(spark, sf_dir))


@query(f"""SELECT count(*) FILTER (latest <= DATE '{CUTOFF}' OR (earliest <= DATE '{CUTOFF}' AND latest IS NULL)) AS pre_cutoff,
count(*) FILTER (earliest > DATE '{CUTOFF}') AS post_cutoff, count(*) FILTER (earliest <= DATE '{CUTOFF}' AND latest > DATE '{CUTOFF}') AS spanning,
count(*) FILTER (earliest IS NOT NULL) AS dated FROM ({ARTICLES})""")
def temporal_class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.class_counts(articles(spark, sf_dir), CUTOFF)


@query(f"""SELECT id, title, CASE WHEN earliest IS NULL THEN 'unknown' WHEN earliest > DATE '{CUTOFF}' THEN 'post_cutoff'
WHEN coalesce(latest, earliest) <= DATE '{CUTOFF}' THEN 'pre_cutoff' ELSE 'spanning' END AS temporal_class FROM ({ARTICLES})""")
def article_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return articles(spark, sf_dir).select("id", "title", dates.article_class(F.col("earliest"), F.col("latest"), CUTOFF).alias("temporal_class"))


@query(f"""SELECT id, earliest, latest FROM ({ARTICLES}) WHERE latest <= DATE '{CUTOFF}' AND id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 5 = 0)
ORDER BY md5(id::VARCHAR || ':42'), id LIMIT 40""")
def pre_cutoff_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = articles(spark, sf_dir)
    used = table(spark, sf_dir, "customer").where("c_custkey % 5 = 0").select(F.col("c_custkey").alias("id"))
    pre = a.where(dates.pre_cutoff(F.col("earliest"), F.col("latest"), CUTOFF)).select("id", "earliest", "latest")
    return datasets.sample(datasets.unused(pre, used, "id"), "id", 40, 42)


@query(f"SELECT id, earliest, latest FROM ({ARTICLES}) WHERE earliest > DATE '{CUTOFF}' ORDER BY md5(id::VARCHAR || ':42'), id LIMIT 30 OFFSET 10")
def post_cutoff_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    post = articles(spark, sf_dir).where(dates.post_cutoff(F.col("earliest"), CUTOFF)).select("id", "earliest", "latest")
    return datasets.sample(post, "id", 30, 42, offset=10)


@query(f"""WITH a AS (SELECT c_custkey AS id, e, l FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderdate)::DATE AS e, max(o_orderdate)::DATE AS l
FROM orders WHERE o_orderstatus = 'P' GROUP BY ALL) ON c_custkey = o_custkey), f AS ({RANGES})
SELECT a.id, least(e, earliest) AS earliest, greatest(l, latest) AS latest, CASE WHEN f.id IS NULL THEN NULL WHEN e IS NULL THEN 'new'
WHEN least(e, earliest) = e AND greatest(l, latest) = l THEN 'unchanged' ELSE 'updated' END AS status FROM a LEFT JOIN f ON a.id = f.id""")
def date_merge_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("id"))
    old = old.agg(F.min("o_orderdate").cast("date").alias("earliest"), F.max("o_orderdate").cast("date").alias("latest"))
    every = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")).join(old, "id", "left")
    return temporal.merge_dates(every, ranges(spark, sf_dir))


@query(f"SELECT id, earliest, latest FROM ({ARTICLES}) WHERE earliest <= DATE '1998-12-31' AND latest >= DATE '1998-01-01'")
def interval_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.overlapping(articles(spark, sf_dir), "1998-01-01", "1998-12-31").select("id", "earliest", "latest")


@query(f"""SELECT 'active' AS kind, id FROM ({ARTICLES}) WHERE earliest < DATE '1997-01-01' UNION ALL
SELECT 'ended', id FROM ({ARTICLES}) WHERE latest < DATE '2000-01-01' AND earliest < latest""")
def active_and_ended(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = articles(spark, sf_dir)
    one = temporal.active_before(a, "1997-01-01").select(F.lit("active").alias("kind"), "id")
    return one.unionByName(temporal.ended_before(a, "2000-01-01").select(F.lit("ended").alias("kind"), "id"))


@query(f"SELECT id AS source_article_id, title AS source_title, earliest AS earliest_date, latest AS latest_date FROM ({ARTICLES}) WHERE earliest <= DATE '{CUTOFF}'")
def cutoff_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.cutoff_dataset(articles(spark, sf_dir), CUTOFF)


RAW = """SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%-m-%-d')
WHEN 2 THEN '1999-02-30' WHEN 3 THEN strftime(o_orderdate, '%y-%m-%d') WHEN 4 THEN '-' || strftime(o_orderdate, '%Y-%m-%d') ELSE '2999-01-01' END AS raw FROM orders"""


def raw_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, d = F.col("o_orderkey") % 6, F.col("o_orderdate")
    iso = F.date_format(d, "yyyy-MM-dd")
    raw = F.when(k == 0, iso).when(k == 1, F.date_format(d, "yyyy-M-d")).when(k == 2, F.lit("1999-02-30")).when(k == 3, F.date_format(d, "yy-MM-dd")).when(k == 4, F.concat(F.lit("-"), iso)).otherwise("2999-01-01")
    return table(spark, sf_dir, "orders").select("o_orderkey", raw.alias("raw"))


@query(f"SELECT o_orderkey, CASE WHEN regexp_matches(raw, '^\\d{{4}}-\\d{{1,2}}-\\d{{1,2}}$') AND year(try_strptime(raw, '%Y-%m-%d')) BETWEEN 1 AND 2026 THEN try_strptime(raw, '%Y-%m-%d')::DATE END AS date FROM ({RAW})")
def valid_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_dates(spark, sf_dir).select("o_orderkey", dates.valid_date(F.col("raw"), F.to_date(F.lit(TODAY))).alias("date"))


@query("""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN o_orderdate::DATE WHEN 1 THEN o_orderdate::DATE WHEN 2 THEN o_orderdate::DATE
WHEN 3 THEN date_trunc('month', o_orderdate)::DATE ELSE date_trunc('year', o_orderdate)::DATE END AS date FROM orders""")
def literal_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = ["yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-M-d", "yyyy-MM", "yyyy"]
    text = F.lit(None).cast("string")
    for i, form in enumerate(forms):
        text = F.when(F.col("o_orderkey") % 5 == i, F.date_format("o_orderdate", form)).otherwise(text)
    literal = F.concat(F.lit('"'), text, F.lit('"^^xsd:date .'))
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.literal_date(literal).alias("date"))


PARTS = "SELECT o_orderkey AS topic_id, year(o_orderdate)::INT AS y, CASE WHEN o_orderkey % 3 > 0 THEN month(o_orderdate)::INT END AS m, CASE WHEN o_orderkey % 3 = 2 THEN day(o_orderdate)::INT END AS d FROM orders"


@query(f"""SELECT topic_id, CASE WHEN y * 10000 + coalesce(m, 1) * 100 + coalesce(d, 1) <= 19980720 THEN 'pre_cutoff' ELSE 'post_cutoff' END AS topic_class,
printf('%04d', y) || coalesce(printf('-%02d', m), '') || coalesce(printf('-%02d', d), '') AS topic_date FROM ({PARTS})""")
def topic_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, day = F.col("o_orderkey") % 3, F.col("o_orderdate")
    parts = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("topic_id"), F.year(day).alias("y"), F.when(k > 0, F.month(day)).alias("m"), F.when(k == 2, F.dayofmonth(day)).alias("d"))
    y, m, d = F.col("y"), F.col("m"), F.col("d")
    return parts.select("topic_id", dates.topic_class(y, m, d, CUTOFF).alias("topic_class"), dates.topic_date(y, m, d).alias("topic_date"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 3 THEN NULL ELSE p_partkey % 12 + 1 END::INT AS month,
CASE WHEN p_partkey % 4 IN (0, 1) THEN p_partkey % 28 + 1 END::INT AS day,
CASE WHEN p_partkey % 4 IN (0, 1) THEN printf('1969-%02d-%02d', p_partkey % 12 + 1, p_partkey % 28 + 1) END AS date FROM part""")
def month_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    name = F.initcap(F.element_at(F.array(*[F.lit(m) for m in dates.MONTHS]), (k % 12 + 1).cast("int")))
    day = (k % 28 + 1).cast("string")
    text = F.when(k % 4 == 0, F.concat_ws(" ", name, day)).when(k % 4 == 1, F.concat(name, F.lit(" "), day, F.lit("-30"))).when(k % 4 == 2, name).otherwise(F.concat(F.lit("Smarch "), day))
    found = dates.month_date(text, F.lit(1969))
    return table(spark, sf_dir, "part").select("p_partkey", found["month"].alias("month"), found["day"].alias("day"), found["date"].alias("date"))


@query("""WITH t AS (SELECT doc_id, text || CASE doc_id % 6 WHEN 0 THEN ' in 1912 and 1957' WHEN 1 THEN ' of the 1920s' WHEN 2 THEN ' after World War II'
WHEN 3 THEN ' in 1985, the Cold War' WHEN 4 THEN ' before the Moon landing' ELSE '' END || ' end.' AS t FROM documents),
y AS (SELECT doc_id, list_concat(list_concat(list_transform(regexp_extract_all(t, '\\b(1[0-9]{3}|20[0-2][0-9])\\b', 1), lambda x: x::INT),
list_transform(regexp_extract_all(t, '(?i)\\b(?:the\\s+)?((?:18|19|20)[0-9]0)s\\b', 1), lambda x: x::INT)),
list_concat(list_concat(CASE WHEN regexp_matches(t, '(?i)world war (ii|2|two)') THEN [1945] ELSE [] END, CASE WHEN regexp_matches(t, '(?i)world war (i|1|one)') THEN [1918] ELSE [] END),
list_concat(CASE WHEN regexp_matches(t, '(?i)moon landing') THEN [1969] ELSE [] END, CASE WHEN regexp_matches(t, '(?i)cold war') THEN [1990] ELSE [] END))) AS years FROM t)
SELECT doc_id, list_max(years) AS latest, CASE WHEN list_max(years) IS NULL THEN 'unknown' WHEN list_max(years) <= 1969 THEN 'pre_cutoff' ELSE 'post_cutoff' END AS marker_class FROM y""")
def temporal_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    endings = [" in 1912 and 1957", " of the 1920s", " after World War II", " in 1985, the Cold War", " before the Moon landing", ""]
    ending = F.element_at(F.array(*[F.lit(e) for e in endings]), (F.col("doc_id") % 6 + 1).cast("int"))
    text = F.concat(F.col("text"), ending, F.lit(" end."))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_max(dates.marker_years(text)).alias("latest"), dates.marker_class(text).alias("marker_class"))


TITLES = "SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN p_name || ' Almanac 1' || (800 + p_partkey % 200) WHEN 1 THEN p_name || ', 1932 edition' WHEN 2 THEN 'The Year 1920' WHEN 3 THEN p_name || ' 1984' WHEN 4 THEN 'The 2002 ' || p_name || ' Factbook' ELSE p_name END AS title FROM part"


@query(f"""WITH t AS ({TITLES}), y AS (SELECT *, list_filter(list_transform(regexp_extract_all(title, '\\b(1[89]\\d{{2}}|20\\d{{2}}|21\\d{{2}})\\b', 1), lambda x: x::INT), lambda x: x BETWEEN 1900 AND 2100 AND (
regexp_matches(lower(title), 'factbook|almanac|yearbook|annual|report|edition|volume|survey|census|statistics') OR regexp_matches(title, '(?i)\\b(year|edition|vol\\.?|volume)\\s*' || x || '\\b') OR regexp_matches(title, '(?i)\\b' || x || '\\s*(edition|vol\\.?|volume|annual|report)\\b'))) AS ys FROM t)
SELECT p_partkey, ys[1] AS year FROM y""")
def title_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, name = F.col("p_partkey"), F.col("p_name")
    title = (
        F.when(k % 6 == 0, F.concat(name, F.lit(" Almanac 1"), (800 + k % 200).cast("string")))
        .when(k % 6 == 1, F.concat(name, F.lit(", 1932 edition")))
        .when(k % 6 == 2, F.lit("The Year 1920"))
        .when(k % 6 == 3, F.concat(name, F.lit(" 1984")))
        .when(k % 6 == 4, F.concat(F.lit("The 2002 "), name, F.lit(" Factbook")))
        .otherwise(name)
    )
    return table(spark, sf_dir, "part").select("p_partkey", dates.title_year(title).alias("year"))


@query("""WITH w AS (SELECT p_partkey, 1900 + p_partkey % 90 AS y, p_name FROM part)
SELECT p_partkey, (CASE p_partkey % 5 WHEN 0 THEN y WHEN 1 THEN 1899 WHEN 2 THEN y WHEN 3 THEN 1999 END)::INT AS year, (p_partkey % 5 = 4 OR (CASE p_partkey % 5 WHEN 0 THEN y WHEN 1 THEN 1899 WHEN 2 THEN y WHEN 3 THEN 1999 END) < 1969) AS kept FROM w""")
def book_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, y = F.col("p_partkey"), (1900 + F.col("p_partkey") % 90).cast("string")
    text = F.when(k % 5 == 0, F.concat(F.lit("First published: March 4, "), y, F.lit("\n"))).otherwise(F.col("p_name"))
    about = F.when(k % 5 == 1, F.lit("from the late 19th century")).when(k % 5 == 2, F.concat(F.lit("written in "), y)).otherwise(F.lit("a book"))
    title = F.when(k % 5 == 3, F.concat(F.col("p_name"), F.lit(" Annual 1999"))).otherwise(F.col("p_name"))
    year = dates.book_year(text, about, title)
    return table(spark, sf_dir, "part").select("p_partkey", year.alias("year"), (year.isNull() | (year < 1969)).alias("kept"))


@query(f"SELECT id, n FROM (SELECT c_custkey AS id, 1 AS n FROM customer WHERE c_custkey % 7 = 0) WHERE id NOT IN (SELECT id FROM ({RANGES}))")
def unmatched_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "customer").where("c_custkey % 7 = 0").select(F.col("c_custkey").alias("id"), F.lit(1).alias("n"))
    return temporal.unmatched(asked, ranges(spark, sf_dir))
