"""Samples, splits, ledgers and metrics over documents, labels and other tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions import chunking
from lexloom.operators import datasets, evaluation, validation
from lexloom.plans.registry import query, table

_ORDER = "ORDER BY md5(doc_id::VARCHAR || ':{0}'), doc_id"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source")


@query(f"SELECT doc_id, CASE WHEN row_number() OVER ({_ORDER.format(7)}) <= floor(count(*) OVER () * 0.9) THEN 'train' ELSE 'validation' END AS split FROM documents")
def train_val_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.split(documents(spark, sf_dir), "doc_id", 7).select("doc_id", "split")


@query(f"SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY lang {_ORDER.format(7)}) <= (SELECT min(n) FROM (SELECT count(*) AS n FROM documents GROUP BY lang))")
def equal_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.equal_sample(documents(spark, sf_dir), "lang", "doc_id", 7).select("doc_id", "lang")


@query(f"SELECT doc_id, lang FROM documents WHERE lang IN ('en', 'de') QUALIFY row_number() OVER (PARTITION BY lang {_ORDER.format(7)}) <= 20")
def half_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.equal_sample(documents(spark, sf_dir).where("lang IN ('en', 'de')"), "lang", "doc_id", 7, 40).select("doc_id", "lang")


@query("""SELECT doc_id, md5(doc_id::VARCHAR || ':3') AS place FROM ((SELECT doc_id FROM documents WHERE lang = 'en' ORDER BY doc_id LIMIT 50) UNION ALL (SELECT doc_id FROM documents WHERE lang = 'fr' ORDER BY doc_id LIMIT 50))""")
def dev_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir)
    return datasets.dev_subset([d.where("lang = 'en'"), d.where("lang = 'fr'")], "doc_id", "doc_id", 50, 3).select("doc_id", "place")


@query(f"""(SELECT doc_id, 'retain' AS part FROM documents WHERE lang = 'en' {_ORDER.format(5)} LIMIT 80) UNION ALL (SELECT doc_id, 'unlearn' FROM documents WHERE lang = 'de' {_ORDER.format(5)} LIMIT 80)
UNION ALL (SELECT doc_id, 'replay' FROM documents WHERE lang = 'fr' {_ORDER.format(5)} LIMIT 40)""")
def dataset_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir)
    parts = {"retain": d.where("lang = 'en'"), "unlearn": d.where("lang = 'de'"), "replay": d.where("lang = 'fr'")}
    return datasets.mixed(parts, {"retain": 40, "unlearn": 40, "replay": 20}, 200, "doc_id", 5).select("doc_id", "part")


@query(f"SELECT doc_id, lang, source, NULL::VARCHAR AS verdict, NULL::VARCHAR AS reviewer FROM documents {_ORDER.format(9)} LIMIT 25")
def review_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.review_sample(documents(spark, sf_dir), "doc_id", 9, 25)


@query("SELECT doc_id, lang, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def unused_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.unused(documents(spark, sf_dir), table(spark, sf_dir, "labels"), "doc_id")


@query("WITH w AS (SELECT DISTINCT doc_id * 3 AS doc_id FROM labels) SELECT 'found' AS kind, doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM w) UNION ALL SELECT 'missing', doc_id FROM w WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def wanted_and_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "labels").select((F.col("doc_id") * 3).alias("doc_id"))
    found, missing = datasets.by_ids(documents(spark, sf_dir), wanted, "doc_id")
    return found.select(F.lit("found").alias("kind"), "doc_id").unionByName(missing.select(F.lit("missing").alias("kind"), "doc_id"))


@query("SELECT doc_id, lang FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, 'new' FROM (SELECT doc_id FROM labels UNION ALL SELECT doc_id FROM labels WHERE doc_id % 5 = 0) WHERE doc_id % 2 <> 0")
def keyed_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = documents(spark, sf_dir).where("doc_id % 2 = 0").select("doc_id", "lang")
    labels = table(spark, sf_dir, "labels").select("doc_id")
    return datasets.appended(old, labels.unionByName(labels.where("doc_id % 5 = 0")).select("doc_id", F.lit("new").alias("lang")), "doc_id")


@query("SELECT doc_id, v FROM (SELECT doc_id, 'old' AS v, 0 AS k FROM documents UNION ALL SELECT doc_id, 'q' || quality, 1 FROM labels) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY k DESC, v DESC) = 1")
def keyed_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = documents(spark, sf_dir).select("doc_id", F.lit("old").alias("v"))
    new = table(spark, sf_dir, "labels").select("doc_id", F.concat(F.lit("q"), F.col("quality").cast("string")).alias("v"))
    return datasets.upserted(old, new, "doc_id", "v")


@query("SELECT doc_id FROM labels UNION SELECT doc_id FROM documents WHERE lang = 'es'")
def used_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.ledger(table(spark, sf_dir, "labels"), documents(spark, sf_dir).where("lang = 'es'"), "doc_id")


_TOPICS = "SELECT o_custkey AS topic_id, CASE WHEN o_custkey % 2 = 0 THEN 'pre_cutoff' ELSE 'post_cutoff' END AS topic_class, unnest(list(o_orderkey // 4)) AS article_id FROM orders GROUP BY o_custkey"


@query(f"""WITH t AS ({_TOPICS}), a AS (SELECT p_partkey AS article_id, CASE WHEN p_size > 25 THEN 'post_cutoff' ELSE 'pre_cutoff' END AS article_class FROM part)
SELECT article_id, topic_id, topic_class FROM t JOIN a USING (article_id) WHERE article_id NOT IN (SELECT doc_id FROM labels) AND NOT (topic_class = 'pre_cutoff' AND article_class = 'post_cutoff') QUALIFY row_number() OVER (PARTITION BY article_id ORDER BY topic_id) = 1""")
def topic_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    topics = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("topic_id")).agg(F.collect_list(F.expr("o_orderkey div 4")).alias("article_ids"))
    topics = topics.withColumn("topic_class", F.when(F.col("topic_id") % 2 == 0, "pre_cutoff").otherwise("post_cutoff"))
    articles = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("article_id"), F.when(F.col("p_size") > 25, "post_cutoff").otherwise("pre_cutoff").alias("article_class"))
    return datasets.topic_articles(topics, articles, table(spark, sf_dir, "labels").select(F.col("doc_id").alias("article_id")))


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").groupBy(F.col("p_size").alias("k"))
    return p.agg(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "p_name", "p_brand"))), lambda x: F.struct(x["p_name"].alias("title"), F.regexp_extract(x["p_brand"], r"(\d+)$", 1).cast("int").alias("article_id"), x["p_partkey"].alias("key"))).alias("items"))


@query("""WITH g AS (SELECT p_size AS k, list({'title': lower(trim(p_name)), 'id': regexp_extract(p_brand, '(\\d+)$', 1), 'key': p_partkey} ORDER BY p_partkey) AS xs FROM part GROUP BY ALL),
f AS (SELECT k, list_reduce(xs, lambda s, x: CASE WHEN list_contains(s.t, x.title) OR list_contains(s.i, x.id) THEN s ELSE {'out': list_append(s.out, x.key), 't': list_append(s.t, x.title), 'i': list_append(s.i, x.id)} END, {'out': []::BIGINT[], 't': []::VARCHAR[], 'i': []::VARCHAR[]}).out AS out FROM g)
SELECT k, unnest(out) AS key FROM f""")
def ordered_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _items(spark, sf_dir).select("k", F.explode(chunking.kept_once(F.col("items"))).alias("x")).select("k", F.col("x.key").alias("key"))


@query("""WITH g AS (SELECT p_size AS k, list({'title': lower(p_name), 'id': regexp_extract(p_brand, '(\\d+)$', 1), 'key': p_partkey} ORDER BY p_partkey) AS xs FROM part GROUP BY ALL), s AS (SELECT k, xs[1:3] AS d, unnest(xs[4:]) AS r FROM g)
SELECT k, r.key AS key FROM s WHERE NOT list_contains(list_transform(d, lambda x: x.title), r.title) AND NOT list_contains(list_transform(d, lambda x: x.id), r.id)""")
def unreferenced(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _items(spark, sf_dir)
    kept = datasets.unreferenced(F.slice("items", 4, 100000), F.slice("items", 1, 3))
    return g.select("k", F.explode(kept).alias("x")).select("k", F.col("x.key").alias("key"))


@query("SELECT count(*) AS n, round(avg((quality = p)::INT), 6) AS accuracy FROM (SELECT quality, (doc_id % 3 > 0)::INT AS p FROM labels)")
def label_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.accuracy(table(spark, sf_dir, "labels").withColumn("found", (F.col("doc_id") % 3 > 0).cast("int")), "quality", "found")


@query("SELECT quality AS actual, count(*) FILTER (doc_id % 3 = 0) AS \"no\", count(*) FILTER (doc_id % 3 > 0) AS \"yes\" FROM labels GROUP BY ALL")
def label_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").withColumn("found", F.when(F.col("doc_id") % 3 > 0, "yes").otherwise("no"))
    return evaluation.confusion(rows, "quality", "found", ["no", "yes"])


@query("SELECT count(*) AS n, round(avg((contains(lower(text), ' the '))::INT), 6) AS share FROM conversations WHERE role = 'assistant'")
def style_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    return evaluation.share_where(rows, F.contains(F.lower("text"), F.lit(" the ")), "share")


_MODELS = "SELECT s_name AS model, s_suppkey * 7 % 1000 + 1 AS tokens, 1 + s_suppkey % 13 AS generation_s, 0.5::DOUBLE AS ttft_s FROM supplier"


@query(f"SELECT *, round(tokens / generation_s, 2) AS tokens_per_s, round((ttft_s + generation_s) * 1000 / 5 / 3600, 4) AS hours_per_1000 FROM ({_MODELS})")
def speed_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("model"), (F.col("s_suppkey") * 7 % 1000 + 1).alias("tokens"), (1 + F.col("s_suppkey") % 13).alias("generation_s"), F.lit(0.5).alias("ttft_s"))
    return evaluation.speed_ranking(s, 5)


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey % 3 < 2 AND (contains(lower(s_name), '01') OR contains(lower(s_name), '7'))")
def model_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey") % 3
    rows = table(spark, sf_dir, "supplier").withColumn("id", F.col("s_name")).withColumn("type", F.when(k == 0, "llm").when(k == 2, "embedding"))
    return evaluation.models_named(rows, ["01", "7"]).select("s_suppkey", "s_name")


@query("""SELECT count(*) AS generated, count(*) FILTER (ok) AS valid, round(avg(CASE WHEN ok THEN length(text) END), 1) AS avg_response_length, round(100.0 * count(*) FILTER (ok) / count(*), 2)::DOUBLE AS success_rate FROM (SELECT text, length(text) BETWEEN 100 AND 1000 AS ok FROM documents)""")
def generation_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("text").alias("response"), F.when(F.length("text").between(100, 1000), "valid").otherwise("length").alias("reason"))
    return validation.generation_stats(rows)


@query("SELECT lang, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 2)::DOUBLE AS percent FROM documents GROUP BY lang")
def variant_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.variant_shares(documents(spark, sf_dir), "lang")


@query("SELECT conv_id, role, text FROM conversations WHERE role = 'user' UNION ALL SELECT conv_id, role, text FROM conversations WHERE role = 'assistant'")
def concatenated(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "role", "text")
    return c.where("role = 'user'").unionByName(c.where("role = 'assistant'"))


@query("SELECT label AS k, count(*) AS n, list_sort(list(vec_id))::BIGINT[] AS ids FROM embeddings GROUP BY label")
def collected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").groupBy(F.col("label").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("vec_id")).alias("ids"))


@query("SELECT event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy("user_id").agg(F.max_by(F.struct("event_id", "event_type"), F.struct("ts", "event_id")).alias("x")).select("x.event_id", "x.event_type")


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return e.select(F.col("w.start").alias("start"), "event_type", "n")
