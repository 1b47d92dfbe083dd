"""Sources and sinks: the driver's tables written by a sink, or as the files that a reader takes, and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions import dates, entities, markup, qa
from lexloom.functions import text as tx
from lexloom.operators import books, graph, service, temporal
from lexloom.plans.registry import query, table
from lexloom.plans.streams import shared_folder
from lexloom.sources import readers, sinks
from lexloom.streaming import incremental

EVENT = "event_id bigint, user_id bigint, event_type string"


def written(rows: DataFrame, name: str, **options: str) -> str:
    """The path of a new text folder with these lines (column value)."""
    path = f"{shared_folder(rows.sparkSession)}/{name}"
    rows.select("value").write.options(**options).text(path)
    return path


@query("SELECT c_custkey || '|' || c_name AS value FROM customer")
def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compressed text lines."""
    rows = table(spark, sf_dir, "customer").select(F.concat_ws("|", F.col("c_custkey").cast("string"), "c_name").alias("value"))
    return readers.lines(spark, written(rows, "lines", compression="bzip2"))


_WORDS = "trim(repeat(p_name || ' & ', (1 + p_partkey % 9)::BIGINT))"


@query(f"""SELECT p_partkey::VARCHAR AS id, p_name AS title, 'https://en.example.org/wiki?curid=' || p_partkey AS url, {_WORDS} AS text FROM part
WHERE p_partkey % 10 <> 0 AND p_partkey % 7 <> 0 AND p_partkey % 11 <> 0 AND length({_WORDS}) >= 100""")
def dump_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An XML dump's articles: other namespaces, redirects, titles with a colon and short texts go."""
    k, name = F.col("p_partkey"), F.col("p_name")
    words = F.trim(F.repeat(F.concat(name, F.lit(" &amp; ")), (1 + k % 9).cast("int")))
    title = F.when(k % 10 == 0, F.concat(F.lit("Talk:"), name)).otherwise(name)
    content = F.when(k % 7 == 0, F.concat(F.lit(" #ReDirect [["), name, F.lit("]] "), F.repeat(F.lit("x"), F.lit(120)))).otherwise(words)
    page = F.concat(F.lit("<page><title>"), title, F.lit("</title><ns>"), F.when(k % 11 == 0, "1").otherwise("0"), F.lit("</ns><id>"), k.cast("string"), F.lit('</id><revision><text bytes="1">'), content, F.lit("</text></revision></page>"))
    line = lambda text: spark.createDataFrame([(text,)], "value string")
    # one document, as dumps are
    dump = line('<mediawiki xml:lang="en">').unionByName(table(spark, sf_dir, "part").select(page.alias("value"))).unionByName(line("</mediawiki>")).coalesce(1)
    path = written(dump, "dump.xml")
    found = readers.extracted_articles(readers.dump_pages(spark, path), "en.example.org", lambda c: c)
    return found.select("id", "title", F.regexp_replace("url", r"^.*curid=", "https://en.example.org/wiki?curid=").alias("url"), "text")


def event_lines(spark: SparkSession, sf_dir: str) -> str:
    """Events as JSON lines in batches, among blank and malformed ones."""
    path = f"{shared_folder(spark)}/events"
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    sinks.batched_json(events, path, 5000)
    bad = events.select(F.when(F.col("event_id") % 2 == 0, F.lit("  ")).otherwise(F.concat(F.lit('{"event_id": '), F.col("event_id").cast("string"), F.lit(', "user_id'))).alias("value"))
    bad.write.mode("append").text(path)
    return path


@query("SELECT event_id, user_id, event_type FROM events")
def json_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.json_lines(spark, event_lines(spark, sf_dir), EVENT)


@query("SELECT '{\"event_id\": ' || event_id || ', \"user_id' AS value FROM events WHERE event_id % 2 <> 0")
def bad_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.bad_json_lines(spark, event_lines(spark, sf_dir), EVENT).select("value")


@query("SELECT doc_id, text FROM (SELECT doc_id, text FROM documents ORDER BY doc_id LIMIT 150) WHERE length(text) >= 100")
def first_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rows of files that follow one another by name; the cap is the reader's."""
    path = f"{shared_folder(spark)}/first"
    rows = table(spark, sf_dir, "documents").select("doc_id", "text")
    sinks.json_lines(rows.repartitionByRange(5, "doc_id").sortWithinPartitions("doc_id"), path)
    return readers.first_lines(spark, path, "doc_id bigint, text string", 150)


@query("SELECT doc_id, lang FROM documents UNION ALL SELECT doc_id, 'again' FROM labels")
def json_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/appended"
    sinks.json_lines(table(spark, sf_dir, "documents").select("doc_id", "lang"), path)
    sinks.json_lines(table(spark, sf_dir, "labels").select("doc_id", F.lit("again").alias("lang")), path, append=True)
    return readers.json_lines(spark, path, "doc_id bigint, lang string")


def turtle(spark: SparkSession, sf_dir: str) -> str:
    """Orders as statements about their customers: one subject with several properties and dates, dots after white space of all kinds, links and comments."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    other = F.date_format(F.date_add(F.col("o_orderdate").cast("date"), 30), "yyyy-MM-dd")
    subject = F.concat(F.lit("wd:Q"), F.col("o_custkey").cast("string"))
    literal = lambda d: F.concat(F.lit('"'), d, F.lit('"^^xsd:date'))
    body = (
        F.when(k % 4 == 0, F.concat(F.lit("\ta wd:Q5 ;\n\twdt:P569 "), literal(day), F.lit(" ;\n\twdt:P570 "), literal(other), F.lit(" .")))
        .when(k % 4 == 1, F.concat(F.lit(" wdt:P569 "), literal(day), F.lit(", "), literal(other), F.lit("\t.")))
        .when(k % 4 == 2, F.concat(F.lit(" wdt:P5690 "), literal(F.lit("2090-01-01")), F.lit(" ; wdt:P570 "), literal(day), F.lit("\n.")))
        .otherwise(F.concat(F.lit(' rdfs:label "a . b"@en ; wdt:P569 "bad" .\n# a comment')))
    )
    rows = o.select(F.concat(subject, body).alias("value"))
    head = spark.createDataFrame([("@prefix wd: <http://www.wikidata.org/entity/> .",)], "value string")
    links = table(spark, sf_dir, "customer").select(F.concat(F.lit("<https://en.wikipedia.org/wiki/"), F.translate("c_name", "#", "_"), F.lit("> schema:about wd:Q"), F.col("c_custkey").cast("string"), F.lit(" .")).alias("value"))
    return written(head.unionByName(rows).unionByName(links), "graph.ttl")


_DATED = """SELECT o_custkey, o_orderdate::DATE AS d FROM orders WHERE o_orderkey % 4 < 3 UNION ALL SELECT o_custkey, (o_orderdate::DATE + 30)::DATE FROM orders WHERE o_orderkey % 4 < 2"""


def graph_ranges(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    statements = readers.turtle_statements(spark, turtle(spark, sf_dir))
    subject = entities.entity_id(F.element_at(F.split("statement", " "), 1))
    link = entities.sitelink(F.col("statement"))
    links = graph.last_links(statements.select(link["entity"].alias("entity"), link["url"].alias("url"), "ordinal"))
    return graph.date_ranges(graph.property_dates(statements, ["wdt:P569", "wdt:P570"], subject)), links


@query(f"""SELECT 'Q' || c_custkey AS entity, min(d) AS earliest, max(d) AS latest, 'https://en.wikipedia.org/wiki/' || translate(c_name, '#', '_') AS url
FROM ({_DATED}) JOIN customer ON c_custkey = o_custkey GROUP BY c_custkey, c_name""")
def turtle_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements to dated entities with their links."""
    ranges, links = graph_ranges(spark, sf_dir)
    return graph.with_links(ranges, links)


@query("SELECT count(*) AS n, count(*) FILTER (line LIKE 'wd:Q%') AS subjects FROM (SELECT 'wd:Q' AS line FROM orders UNION ALL SELECT 'x' FROM orders, range(3) WHERE o_orderkey % 4 = 0 AND range < 2 UNION ALL SELECT '.' FROM orders WHERE o_orderkey % 4 = 2 UNION ALL SELECT '<' FROM customer)")
def turtle_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = readers.turtle_lines(spark, turtle(spark, sf_dir))
    return lines.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.startswith("line", F.lit("wd:Q"))).alias("subjects"))


_EXPORT = f"""SELECT 'Q' || o_custkey AS "Entity", coalesce(url, '') AS "Wikipedia_URL", strftime(min(d), '%Y-%m-%d') AS "Earliest_Date", strftime(max(d), '%Y-%m-%d') AS "Latest_Date"
FROM ({_DATED}) LEFT JOIN (SELECT c_custkey, 'https://example.org/' || c_custkey AS url FROM customer WHERE c_custkey % 3 = 0) ON c_custkey = o_custkey GROUP BY ALL"""


def exported(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    day = F.col("o_orderdate").cast("date")
    found = F.when(F.col("o_orderkey") % 4 < 2, F.array(day, F.date_add(day, 30))).when(F.col("o_orderkey") % 4 == 2, F.array(day))
    dated = o.select(F.concat(F.lit("Q"), F.col("o_custkey").cast("string")).alias("entity"), F.explode(found).alias("date"))
    c = table(spark, sf_dir, "customer").where("c_custkey % 3 = 0").select(F.concat(F.lit("Q"), F.col("c_custkey").cast("string")).alias("entity"), F.concat(F.lit("https://example.org/"), F.col("c_custkey").cast("string")).alias("url"))
    return graph.with_links(graph.date_ranges(dated), c, linked_only=False)


@query(f'SELECT "Entity", nullif("Wikipedia_URL", \'\') AS "Wikipedia_URL", "Earliest_Date", "Latest_Date" FROM ({_EXPORT})')
def csv_by_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/csv"
    sinks.entity_csv(exported(spark, sf_dir), path)
    return readers.dated_entities(spark, path)


@query(f"""SELECT "Entity", NULL::VARCHAR AS "Wikipedia_Title", NULL::VARCHAR AS "Wikipedia_ID", nullif("Wikipedia_URL", '') AS "Wikipedia_URL", "Earliest_Date", "Latest_Date", NULL::VARCHAR AS "Original_URL" FROM ({_EXPORT})""")
def csv_by_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/report"
    sinks.csv_report(sinks.entity_rows(exported(spark, sf_dir)).select("Latest_Date", "Earliest_Date", "Wikipedia_URL", "Entity"), path)
    return readers.normalized_entities(spark, path)


@query(_EXPORT)
def json_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/arrays"
    sinks.entity_json(exported(spark, sf_dir), path)
    return readers.entity_json(spark, path)


@query("SELECT year(o_orderdate)::INT AS year, 'extracted' AS source, count(*)::INT AS total_topics FROM orders WHERE year(o_orderdate) BETWEEN 1996 AND 1998 GROUP BY ALL")
def years_of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each year; those outside the years asked for aren't read."""
    path = f"{shared_folder(spark)}/years"
    rows = table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.count(F.lit(1)).cast("int").alias("total_topics")).withColumn("source", F.lit("extracted"))
    jvm = spark.sparkContext._jvm
    rows.repartition("year").write.partitionBy("year").json(f"{path}/parts")
    files = jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for part in files.globStatus(jvm.org.apache.hadoop.fs.Path(f"{path}/parts/year=*/*.json")):  # one for each year
        year = part.getPath().getParent().getName().removeprefix("year=")
        files.rename(part.getPath(), jvm.org.apache.hadoop.fs.Path(f"{path}/year_{year}.json"))
    found = readers.year_files(spark, f"{path}/year_*.json", 1996, 1998)
    return found.select(F.col("file_year").alias("year"), "source", "total_topics")


@query("SELECT c_custkey, c_name, c_nationkey FROM customer WHERE c_nationkey = 7")
def keyed_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table bucketed by key, and a lookup in it."""
    path = f"{shared_folder(spark)}/keyed"
    name = f"keyed_{path.split('/')[-2].replace('-', '_')}"
    sinks.keyed_table(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey"), name, path, "c_nationkey", 8)
    return readers.by_id(readers.table(spark, path=path), "c_nationkey", 7)


@query("SELECT doc_id, source, lang FROM documents")
def bucket_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/buckets"
    sinks.per_bucket(table(spark, sf_dir, "documents").select("doc_id", "source", "lang"), path, "lang")
    return spark.read.schema("doc_id bigint, source string, lang string").json(path)


@query("SELECT count(*) AS rows, max(doc_id) AS last FROM documents")
def ledger_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/ledger"
    sinks.one_row_json(table(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("rows"), F.max("doc_id").alias("last")), path)
    return spark.read.schema("rows bigint, last bigint").json(path)


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, done = table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels")
    return readers.not_done(docs, done, "doc_id")


@query("SELECT event_id, event_type FROM events")
def micro_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that arrive, in batches of one file, each to its own folder; a second run finds nothing new."""
    at = shared_folder(spark)
    sinks.batched_json(table(spark, sf_dir, "events").select("event_id", "event_type"), f"{at}/in", 2000)
    stream = lambda: incremental.arriving(spark, f"{at}/in", "event_id bigint, event_type string", files=50)
    for _ in range(2):
        incremental.keyed_batches(stream(), f"{at}/checkpoint", f"{at}/out", lambda df: df).awaitTermination()
    return spark.read.parquet(f"{at}/out").select("event_id", "event_type")


@query("""SELECT c_custkey AS id, c_name AS title, coalesce(string_agg(o_orderkey || ' ' || o_orderpriority || ' ' || o_orderstatus, '; ' ORDER BY o_orderkey), '') AS sections, count(o_orderkey)::INT AS n
FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'P') ON c_custkey = o_custkey GROUP BY ALL""")
def article_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles with their sections in order, also those without."""
    articles = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"))
    sections = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("article_id"), F.col("o_orderkey").alias("section_order"), F.col("o_orderpriority").alias("section_title"), F.col("o_orderstatus").alias("section_text"))
    found = service.with_sections(articles, sections)
    lines = F.transform("sections", lambda s: F.concat_ws(" ", s["section_order"].cast("string"), s["section_title"], s["section_text"]))
    return found.select("id", "title", F.array_join(lines, "; ").alias("sections"), F.size("sections").alias("n"))


@query("""WITH a AS (SELECT p_name AS title, min(p_partkey) AS pid FROM part GROUP BY ALL), n AS (SELECT p_partkey AS tag, CASE p_partkey % 5 WHEN 0 THEN replace(p_name, ' ', '_') WHEN 1 THEN 'moved ' || p_name WHEN 2 THEN 'own' WHEN 3 THEN 'own' ELSE 'none' || p_partkey END AS entity, p_name FROM part)
SELECT tag, entity, pid AS page_id, CASE WHEN pid IS NOT NULL THEN title END AS page_title FROM n LEFT JOIN a ON p_name = title AND tag % 5 < 4""")
def entity_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities to pages: by name, through a redirect, by an English link, and by another language's."""
    p, k, name = table(spark, sf_dir, "part"), F.col("p_partkey"), F.col("p_name")
    articles = p.select(name.alias("title"), F.concat(F.lit("https://en.wikipedia.org/wiki?curid="), k.cast("string")).alias("url"))
    redirects = p.select(F.concat(F.lit("moved "), name).alias("source_title"), name.alias("target_title")).distinct()
    langlinks = p.select(F.lit("fr").alias("lang"), F.concat(F.lit("le_"), F.replace(name, F.lit(" "), F.lit("_"))).alias("title"), name.alias("english_title")).distinct()
    entity = F.when(k % 5 == 0, F.replace(name, F.lit(" "), F.lit("_"))).when(k % 5 == 1, F.concat(F.lit("moved "), name)).when(k % 5 < 4, F.lit("own")).otherwise(F.concat(F.lit("none"), k.cast("string")))
    link = F.when(k % 5 == 2, F.concat(F.lit("https://en.wikipedia.org/wiki/"), F.replace(name, F.lit(" "), F.lit("_")))).when(k % 5 == 3, F.concat(F.lit("https://fr.wikipedia.org/wiki/le_"), F.replace(name, F.lit(" "), F.lit("_"))))
    rows = p.select(k.alias("tag"), entity.alias("entity"), link.alias("url"))
    return graph.normalize(rows, articles, redirects, langlinks).select("tag", "entity", "page_id", "page_title")


_ODD = "CASE o_orderkey % 3 WHEN 0 THEN DATE '9000-01-01' ELSE o_orderdate::DATE END"


@query(f"""SELECT o_orderkey AS id, nullif({_ODD}, DATE '9000-01-01') AS earliest, CASE WHEN o_orderkey % 4 > 0 THEN o_orderdate::DATE END AS latest, o_orderkey % 3 > 0 OR o_orderkey % 4 > 0 AS has_dates FROM orders""")
def odd_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    rows = table(spark, sf_dir, "orders").select(k.alias("id"), F.when(k % 3 == 0, F.lit("9000-01-01").cast("date")).otherwise(day).alias("earliest"), F.when(k % 4 > 0, day).otherwise(F.lit("9999-12-31").cast("date")).alias("latest"))
    return temporal.without_odd_dates(rows, F.lit("2026-01-01").cast("date")).select("id", "earliest", "latest", "has_dates")


@query("SELECT o_orderkey AS id, o_orderdate::DATE AS earliest, (o_orderdate::DATE + 10)::DATE AS latest FROM orders WHERE o_orderkey % 5 > 1")
def usable_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, day = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    rows = table(spark, sf_dir, "orders").select(F.when(k % 5 > 0, k).alias("key"), F.when(k % 5 == 1, F.lit("9999-99-99")).otherwise(day).alias("a"), F.date_format(F.date_add(F.col("o_orderdate").cast("date"), 10), "yyyy-MM-dd").alias("b"))
    return temporal.usable_dates(rows, "key", "a", "b", F.lit("2026-01-01").cast("date"))


@query("""SELECT o_orderkey, CASE WHEN s >= 3600 THEN (s // 3600) || 'h ' || lpad((s % 3600 // 60)::VARCHAR, 2, '0') || 'm ' || lpad((s % 60)::VARCHAR, 2, '0') || 's'
WHEN s >= 60 THEN (s // 60) || 'm ' || lpad((s % 60)::VARCHAR, 2, '0') || 's' ELSE s || 's' END AS took FROM (SELECT o_orderkey, (o_orderkey * 37 % 20000)::INT AS s FROM orders)""")
def durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.duration((F.col("o_orderkey") * 37 % 20000).cast("double") + 0.4).alias("took"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 1900 + p_partkey % 90 WHEN 1 THEN 1950 END::INT AS died FROM part")
def death_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    tag = F.when(k % 3 == 0, (F.lit(1900) + k % 90).cast("int"))
    name = F.when(k % 3 == 2, F.col("p_name")).otherwise(F.concat("p_name", F.lit(", 1881-1950")))
    return table(spark, sf_dir, "part").select("p_partkey", dates.author_death_year(tag, name).alias("died"))


@query("SELECT conv_id, turn, 'system=Be brief.; user=' || text || '; assistant=' || role AS messages FROM conversations")
def chat_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    chat = qa.messages(F.lit("Be brief."), F.col("text"), F.col("role"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(F.transform(chat, lambda m: F.concat(m["role"], F.lit("="), m["content"])), "; ").alias("messages"))


@query("""SELECT conv_id, turn, CASE WHEN conv_id % 3 = 0 AND regexp_replace(text, '^\\s+|\\s+$', '', 'g') <> '' THEN regexp_replace(text, '^\\s+|\\s+$', '', 'g') END AS "user", CASE WHEN conv_id % 3 = 0 AND regexp_replace(text, '^\\s+|\\s+$', '', 'g') <> '' THEN role END AS assistant FROM conversations""")
def json_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The object in a model's response; nothing where a field is missing or the JSON is cut off."""
    k = F.col("conv_id") % 3
    whole = F.to_json(F.struct(F.col("text").alias("user"), F.col("role").alias("assistant")))
    response = F.when(k == 0, F.concat(F.lit("Sure: "), whole, F.lit(" bye"))).when(k == 1, F.lit('{"user": "only one"}')).otherwise(F.left(whole, F.lit(9)))
    found = qa.json_example(response)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", found["user"].alias("user"), found["assistant"].alias("assistant"))


def _wikitext(name: Column) -> Column:
    parts = ["'''", name, "''' is a [[thing|part]] <!-- note\nhere --> of {{lang|{{x}}|y}}it.<ref name=a>r</ref>\n== History ==\nOld ", name, ".\n=== See also ===\n* gone\n==== Deeper ====\ngone too\n=== Use ===\nStill ", name, "\n== References ==\ngone"]
    return F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])


@query("""SELECT p_partkey, p_name || ' is a part  of it.' || chr(10) || '== History ==' || chr(10) || 'Old ' || p_name || '.' || chr(10) || '=== Use ===' || chr(10) || 'Still ' || p_name AS text FROM part""")
def wikitext_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections that are dropped with what is nested in them; comments, references, templates, links and emphasis."""
    return table(spark, sf_dir, "part").select("p_partkey", tx.plain_markup(tx.without_sections(_wikitext(F.col("p_name")))).alias("text"))


@query("SELECT p_partkey, 'They are  ' || p_name || ', ' || p_type || ', ' || p_brand || '   and *two*' AS text FROM part WHERE NOT contains(p_name || p_type || p_brand, '*')")
def bulleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.lit("They are *"), "p_name", F.lit("* "), "p_type", F.lit("*"), "p_brand", F.lit("\n and *two*"))
    return table(spark, sf_dir, "part").select("p_partkey", F.replace(tx.bullets(line), F.lit("\n"), F.lit(" ")).alias("text"))


@query("SELECT p_partkey, 'x  ' || p_name || ', ' || p_type || '; ' || p_brand || ', 5  y {not a table}' AS text FROM part")
def tables_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.lit('x {class="wikitable"|-| '), "p_name", F.lit(" || "), "p_type", F.lit(" |- | "), "p_brand", F.lit(" || 5} y {not a table}"))
    return table(spark, sf_dir, "part").select("p_partkey", markup.flat_tables(line).alias("text"))


@query("""SELECT p_partkey, p_name AS topic, 1900 + (p_partkey % 60)::INT AS year, '19' || lpad((p_partkey % 60)::VARCHAR, 2, '0') || '-03-' || lpad((1 + p_partkey % 28)::VARCHAR, 2, '0') AS date, 'T' || p_partkey AS title FROM part
UNION ALL SELECT p_partkey, p_type, 1900 + (p_partkey % 60)::INT, '19' || lpad((p_partkey % 60)::VARCHAR, 2, '0') || '-03-' || lpad((1 + p_partkey % 28)::VARCHAR, 2, '0'), NULL FROM part
UNION ALL SELECT p_partkey, p_brand, 1900 + (p_partkey % 60)::INT, NULL, NULL FROM part""")
def year_page_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of year pages: under the right heading only, in bulleted and numbered lists, nested and flat, by month and day."""
    k, year = F.col("p_partkey"), (F.lit(1900) + F.col("p_partkey") % 60).cast("int")
    day = F.concat(F.lit("March "), (1 + k % 28).cast("string"))
    parts = ['<h2>Before</h2><ul><li>not this</li></ul><h2 id="Events">Events</h2><h3>March[edit]</h3><ul><li><a href="/wiki/d">', day, '</a><ul><li><a href="/wiki/T', k.cast("string"), '">', F.col("p_name"), "</a>[1]</li><li>", F.col("p_type")]
    parts += ["</li></ul></li></ul><ol><li>", F.col("p_brand"), "</li></ol><h2>Births</h2><ul><li>", day, " – nobody</li></ul>"]
    html = F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    found = table(spark, sf_dir, "part").select("p_partkey", F.inline(markup.year_events("/wiki/")(html, year)))
    return found.select("p_partkey", "topic", "year", "date", F.regexp_replace(F.get("links", F.lit(0))["href"], "^.*/", "").alias("title"))


@query("""SELECT p_partkey, p_name AS title, p_brand || ', 1850-1911' AS author, 1850 AS author_birth_year, 1911 AS author_death_year, '1999-01-01' AS issued_date, p_type AS description, [p_brand, p_type] AS subjects FROM part""")
def rdf_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = ["<rdf><dcterms:title> ", F.col("p_name"), " </dcterms:title><pgterms:name>", F.col("p_brand"), ", 1850-1911</pgterms:name><dcterms:issued rdf:datatype='x'>1999-01-01</dcterms:issued><pgterms:marc520>", F.col("p_type")]
    parts += ["</pgterms:marc520><rdf:value>", F.col("p_brand"), "</rdf:value><rdf:value>http://x</rdf:value><rdf:value>", F.col("p_type"), "</rdf:value></rdf>"]
    found = markup.rdf_metadata(F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts]))
    return table(spark, sf_dir, "part").select("p_partkey", found.alias("m")).select("p_partkey", "m.*")


@query("SELECT doc_id, doc_id % 3 = 1 OR doc_id % 3 = 2 AS known FROM documents")
def known_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 3
    return table(spark, sf_dir, "documents").select("doc_id", books.known_author(F.when(k == 1, "WELLS, H. G.").when(k == 2, "Karel Čapek")).alias("known"))


@query("SELECT doc_id, source AS title, lang AS author FROM documents")
def book_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("The Book\n\nTitle:  "), "source", F.lit(" \nAuthor: "), "lang", F.lit("\n\n"), F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "documents").select("doc_id", markup.header_field(text, "Title").alias("title"), markup.header_field(text, "Author").alias("author"))
