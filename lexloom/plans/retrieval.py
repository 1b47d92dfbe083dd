"""Search queries: documents are searched by words, embeddings by vectors, parts stand for article titles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions import entities, vectors
from lexloom.functions import text as tx
from lexloom.operators import evaluation, graph, retrieval
from lexloom.plans.registry import query, table

QUERIES_ = [(1, "the queen of that"), (2, "der und nicht"), (3, "les dans pour"), (4, "que los como thndre"), (5, "ththe ther tion")]
_ASKED = ", ".join(f"({i}, '{q}')" for i, q in QUERIES_)
QUERY_VECTORS = "vec_id % 50 = 0"


def asked(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(QUERIES_, "query_id int, query string")


def searchable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their first words as a title and their source as a section."""
    words = F.split("text", r"\s+")
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.array_join(F.slice(words, 1, 4), " ").alias("title"), F.concat("lang", F.lit(" part of "), "source").alias("section_title"), "text", F.concat(F.lit("https://example.org/wiki?curid="), F.col("doc_id").cast("string")).alias("url")
    )


_DOCS = "SELECT doc_id, array_to_string(regexp_split_to_array(text, '\\s+')[1:4], ' ') AS title, lang || ' part of ' || source AS section_title, text FROM documents"
_TERMS = "list_transform(regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}_]+(?:[''’]s\\b)?'), lambda t: regexp_replace(t, '[''’]s$', ''))"
BM25 = f"""SELECT query_id, doc, max(score) AS score FROM (
WITH d AS ({_DOCS}), f AS (SELECT doc_id AS doc, 'title' AS field, {_TERMS.format('title')} AS ts FROM d UNION ALL SELECT doc_id, 'section_title', {_TERMS.format('section_title')} FROM d UNION ALL SELECT doc_id, 'text', {_TERMS.format('text')} FROM d),
l AS (SELECT doc, field, len(ts) AS length FROM f), t AS (SELECT field, count(*) AS docs, avg(length) AS avg_length FROM l WHERE length > 0 GROUP BY ALL),
p AS (SELECT term, field, doc, count(*) AS tf FROM (SELECT doc, field, unnest(ts) AS term FROM f) GROUP BY ALL),
q AS (SELECT DISTINCT query_id, unnest({_TERMS.format('query')}) AS term FROM (VALUES {_ASKED}) AS v(query_id, query)),
n AS (SELECT term, field, count(*) AS df FROM p GROUP BY ALL)
SELECT q.query_id, p.doc, p.field, sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / avg_length))) * CASE p.field WHEN 'title' THEN 3.0 WHEN 'section_title' THEN 2.0 ELSE 1.0 END AS score
FROM q JOIN p USING (term) JOIN n USING (term, field) JOIN t USING (field) JOIN l ON l.doc = p.doc AND l.field = p.field GROUP BY q.query_id, p.doc, p.field) GROUP BY ALL"""
TOP = "SELECT query_id, doc, round(score, 6) AS score, (row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc))::INT AS rank FROM ({0}) QUALIFY rank <= {1}"
KNN = """SELECT q.vec_id AS query_id, e.vec_id AS doc, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS cosine,
(row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9) DESC, e.vec_id))::INT AS rank
FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0 QUALIFY rank <= {0}"""


def index(spark: SparkSession, sf_dir: str, english: bool = False) -> retrieval.TextIndex:
    return retrieval.text_index(searchable(spark, sf_dir), "doc_id", ["title", "section_title", "text"], english)


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").where(QUERY_VECTORS).select(F.col("vec_id").alias("query_id"), "embedding")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc"), "embedding")


@query(f"SELECT query_id, doc, round(score, 4) AS score, rank FROM ({TOP.format(BM25, 10)})")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = retrieval.top(retrieval.bm25(retrieval.query_terms(asked(spark)), index(spark, sf_dir)), 10, 6)
    return hits.select("query_id", "doc", F.round("score", 4).alias("score"), "rank")


@query(f"""WITH p AS (SELECT DISTINCT unnest({_TERMS.format('text')}) AS other FROM documents), q AS (SELECT DISTINCT query_id, unnest({_TERMS.format('query')}) AS term FROM (VALUES {_ASKED}) AS v(query_id, query))
SELECT query_id, other AS term, round(max(1.0 - levenshtein(term, other) / least(length(term), length(other))), 6) AS weight FROM p, q
WHERE levenshtein(term, other) <= CASE WHEN length(term) <= 2 THEN 0 WHEN length(term) <= 5 THEN 1 ELSE 2 END AND regexp_matches(term || other, '^[a-z]*$') GROUP BY ALL""")
def fuzzy_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = retrieval.text_index(table(spark, sf_dir, "documents"), "doc_id", ["text"])
    found = retrieval.fuzzy_terms(retrieval.query_terms(asked(spark)), words)
    return found.where(F.col("term").rlike("^[a-z]*$")).select("query_id", "term", F.round("weight", 6).alias("weight"))


@query()
def fuzzy_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = index(spark, sf_dir, english=True)
    terms = retrieval.fuzzy_terms(retrieval.query_terms(asked(spark), english=True), found)
    return retrieval.search_results(retrieval.top(retrieval.bm25(terms, found), 10, 6), searchable(spark, sf_dir), "doc_id")


@query(f"SELECT query_id, doc, round(cosine, 6) AS cosine, rank FROM ({KNN.format(10)})")
def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.knn(corpus(spark, sf_dir), vector_queries(spark, sf_dir), 10).select("query_id", "doc", F.round("cosine", 6).alias("cosine"), "rank")


@query(f"SELECT query_id, doc, round((1 + cosine) / 2, 6) AS score, rank FROM ({KNN.format(3)})")
def knn_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = retrieval.knn_hits(retrieval.knn(corpus(spark, sf_dir), vector_queries(spark, sf_dir), 3))
    return hits.select("query_id", "doc", F.round("score", 6).alias("score"), "rank")


@query()
def ann_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.ann(corpus(spark, sf_dir), vector_queries(spark, sf_dir), 10).select("query_id", "doc", F.round("cosine", 6).alias("cosine"), "rank")


_VECTOR_HITS = KNN.format(20).replace("q.vec_id AS query_id", "(q.vec_id / 50 + 1)::INT AS query_id").replace("q.vec_id % 50 = 0", "q.vec_id % 50 = 0 AND q.vec_id < 250")


@query(f"""WITH k AS ({TOP.format(BM25, 20)}), v AS (SELECT query_id, doc, rank FROM ({_VECTOR_HITS})), b AS (SELECT query_id, doc, min(kr) AS kr, min(vr) AS vr FROM (SELECT query_id, doc, rank AS kr, NULL AS vr FROM k UNION ALL SELECT query_id, doc, NULL, rank FROM v) GROUP BY ALL),
s AS (SELECT *, coalesce(1.0::DOUBLE / (60 + kr), 0) + coalesce(1.0::DOUBLE / (60 + vr), 0) AS score FROM b)
SELECT query_id, doc, round(score, 9) AS score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, kr ASC NULLS LAST, vr ASC NULLS LAST, doc))::INT AS rank FROM s QUALIFY rank <= 10""")
def rrf_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").where("vec_id % 50 = 0 AND vec_id < 250").select((F.col("vec_id") / 50 + 1).cast("int").alias("query_id"), "embedding")
    keyword = retrieval.top(retrieval.bm25(retrieval.query_terms(asked(spark)), index(spark, sf_dir)), 20, 6)
    found = retrieval.fused(keyword, retrieval.knn(corpus(spark, sf_dir), v, 20), 10)
    return found.select("query_id", "doc", F.round("score", 9).alias("score"), "rank")


@query(f"""WITH h AS ({TOP.format(BM25, 10)}), r AS (SELECT query_id, doc, rank, score, (doc % 100) / 100.0::DOUBLE AS sim, count(*) OVER (PARTITION BY query_id) AS n FROM h)
SELECT query_id, doc, round(0.4::DOUBLE * sim + 0.4::DOUBLE * least(score / 20, 1.0::DOUBLE) + 0.2::DOUBLE * (1 - (rank - 1) / n), 3) AS relevance_score, round(score, 2) AS search_score, round(1 - (rank - 1) / n, 3) AS position_factor FROM r""")
def relevance_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    hits = retrieval.top(retrieval.bm25(retrieval.query_terms(asked(spark)), index(spark, sf_dir)), 10, 6)
    hits = hits.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("query_id")))
    r = retrieval.relevance(F.col("doc") % 100 / 100.0, F.col("score"), F.col("rank") - 1, F.col("n"))
    return hits.select("query_id", "doc", r["relevance_score"].alias("relevance_score"), r["search_score"].alias("search_score"), r["position_factor"].alias("position_factor"))


@query(f"""WITH h AS (SELECT h.*, q.query, d.title FROM ({TOP.format(BM25, 5)}) h JOIN (VALUES {_ASKED}) AS q(query_id, query) USING (query_id) JOIN ({_DOCS}) d ON d.doc_id = h.doc)
SELECT query_id, doc FROM h QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY lower(title) = lower(query) DESC, rank) = 1""")
def best_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = retrieval.top(retrieval.bm25(retrieval.query_terms(asked(spark)), index(spark, sf_dir)), 5, 6)
    titles = searchable(spark, sf_dir).select(F.col("doc_id").alias("doc"), "title")
    return retrieval.best_title(hits.join(titles, "doc").join(F.broadcast(asked(spark)), "query_id"))


@query("""WITH c AS (SELECT label, list_transform(range(64), lambda i: 0) AS z FROM embeddings GROUP BY ALL),
a AS (SELECT label AS theme, list(embedding ORDER BY vec_id)[1] AS anchor FROM embeddings WHERE label < 5 GROUP BY ALL),
s AS (SELECT vec_id, avg(list_cosine_similarity(embedding::DOUBLE[], anchor::DOUBLE[])) AS combined FROM embeddings, a GROUP BY ALL) SELECT vec_id, round(combined, 6) AS combined FROM s WHERE combined >= 0.05""")
def theme_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    first = e.where("label < 5").groupBy("label").agg(F.min_by("embedding", "vec_id").alias("v")).orderBy("label").collect()
    scored = evaluation.theme_scores(e, {str(r["label"]): r["v"] for r in first}, vectors.cosine, least=0.05)
    return scored.select("vec_id", F.round("combined", 6).alias("combined"))


@query("""WITH v AS (SELECT vec_id, CASE vec_id % 4 WHEN 0 THEN NULL WHEN 1 THEN list_transform(embedding, lambda x: 0::FLOAT) WHEN 2 THEN embedding[:10] ELSE embedding END AS e FROM embeddings)
SELECT vec_id, coalesce(len(e) = 64 AND len(list_filter(e, lambda x: x <> 0)) > 0, false) AS valid FROM v""")
def valid_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, e = F.col("vec_id") % 4, F.col("embedding")
    v = F.when(k == 0, F.lit(None)).when(k == 1, F.transform(e, lambda x: F.lit(0).cast("float"))).when(k == 2, F.slice(e, 1, 10)).otherwise(e)
    return table(spark, sf_dir, "embeddings").select("vec_id", vectors.valid_vector(v, 64).alias("valid"))


@query("SELECT source, count(*) AS n, (count(*) * 768 * 4)::BIGINT AS vector_bytes, round(count(*) / 175.0, 6)::DOUBLE AS seconds FROM documents GROUP BY source")
def vector_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("source", "n", vectors.storage_bytes(F.col("n"), 768).alias("vector_bytes"), F.round(vectors.seconds_at(F.col("n"), 175), 6).alias("seconds"))


# ---- titles: parts are articles, a moved name redirects to a part's
_REDIRECTS = "SELECT DISTINCT 'old ' || p_name AS source_title, p_name AS target_title FROM part WHERE p_partkey % 3 = 0 UNION SELECT 'lost', 'nowhere'"
_ARTICLES = "SELECT p_partkey AS id, p_name AS title, 'https://example.org/wiki?curid=' || p_partkey AS url FROM part"


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), entities.page_url(F.col("p_partkey"), "https://example.org/wiki").alias("url"))


def redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = table(spark, sf_dir, "part").where("p_partkey % 3 = 0").select(F.concat(F.lit("old "), "p_name").alias("source_title"), F.col("p_name").alias("target_title"))
    return some.unionByName(spark.createDataFrame([("lost", "nowhere")], "source_title string, target_title string")).distinct()


@query(f"""WITH a AS ({_ARTICLES}), r AS ({_REDIRECTS}), q AS (SELECT DISTINCT CASE p_partkey % 5 WHEN 0 THEN upper(p_name) WHEN 1 THEN left(p_name, 4) WHEN 2 THEN 'Old ' || p_name WHEN 3 THEN 'none' || p_partkey ELSE 'lost' END AS query FROM part),
e AS (SELECT query, id, title, 'exact' AS how, 1 AS k FROM q JOIN a ON lower(query) = lower(title)), w AS (SELECT query, id, title, 'contains' AS how, 2 AS k FROM q JOIN a ON contains(lower(title), lower(query)) WHERE query NOT IN (SELECT query FROM e)),
v AS (SELECT query, a.id, a.title, 'redirect' AS how, 3 AS k FROM q JOIN r ON lower(query) = lower(source_title) JOIN a ON lower(target_title) = lower(a.title) WHERE query NOT IN (SELECT query FROM e))
SELECT query, id, title, how FROM (SELECT * FROM e UNION ALL SELECT * FROM w UNION ALL SELECT * FROM v) QUALIFY row_number() OVER (PARTITION BY query ORDER BY k, length(title), id) = 1""")
def title_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, name = F.col("p_partkey") % 5, F.col("p_name")
    asked_for = F.when(k == 0, F.upper(name)).when(k == 1, F.left(name, F.lit(4))).when(k == 2, F.concat(F.lit("Old "), name)).when(k == 3, F.concat(F.lit("none"), F.col("p_partkey").cast("string"))).otherwise("lost")
    q = table(spark, sf_dir, "part").select(asked_for.alias("query"))
    return graph.title_lookup(q, parts(spark, sf_dir), redirects(spark, sf_dir))


_NAMES = "SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN replace(p_name, ' ', '_') WHEN 2 THEN 'old ' || p_name ELSE 'no ' || p_name END AS name FROM part"


def _resolved(names: str) -> str:
    return f"""SELECT n.*, coalesce(x.id, s.id, m.id) AS page_id, coalesce(x.title, s.title, m.title) AS page_title FROM ({names}) n
LEFT JOIN (SELECT title, min(id) AS id FROM ({_ARTICLES}) GROUP BY title) x ON x.title = n.name LEFT JOIN (SELECT title, min(id) AS id FROM ({_ARTICLES}) GROUP BY title) s ON s.title = replace(n.name, '_', ' ')
LEFT JOIN (SELECT source_title, target_title AS title, min(id) AS id FROM ({_REDIRECTS}) JOIN ({_ARTICLES}) ON title = target_title GROUP BY ALL) m ON m.source_title = n.name"""


@query(_resolved(_NAMES))
def title_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, name = F.col("p_partkey"), F.col("p_name")
    asked_for = F.when(k % 4 == 0, name).when(k % 4 == 1, F.replace(name, F.lit(" "), F.lit("_"))).when(k % 4 == 2, F.concat(F.lit("old "), name)).otherwise(F.concat(F.lit("no "), name))
    names = table(spark, sf_dir, "part").select(k.alias("k"), asked_for.alias("name"))
    return graph.resolve_titles(names, parts(spark, sf_dir), redirects(spark, sf_dir))


@query("""SELECT p_partkey, 'A-' || p_size || '_(' || p_brand || ')' AS name, p_partkey AS page_id, CASE WHEN p_partkey % 2 = 0 THEN 'en' END AS lang, CASE WHEN p_partkey % 2 = 0 THEN 'C++ ' || p_size END AS title, 'Q' || p_partkey AS entity FROM part""")
def entity_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, key = F.col("p_size").cast("string"), F.col("p_partkey").cast("string")
    uri = F.concat(F.lit("graph:A-"), size, F.lit("__u0028_"), "p_brand", F.lit("_u0029_"))
    url = F.concat(F.when(F.col("p_partkey") % 2 == 0, "https://en.wikipedia.org/wiki/").otherwise("https://en.example.org/wiki/"), F.lit("C++%20"), size)
    link = entities.language_and_title(url)
    return table(spark, sf_dir, "part").select(
        "p_partkey", entities.entity_name(uri).alias("name"), entities.page_id(F.concat(F.lit("https://x/?curid="), key)).alias("page_id"), link["lang"].alias("lang"), link["title"].alias("title"), entities.entity_id(F.concat(F.lit("<http://www.wikidata.org/entity/Q"), key, F.lit(">"))).alias("entity")
    )


_GRAMS = "list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substring('  ' || w || ' ', i, 3)))))"


@query(f"""WITH t AS (SELECT p_partkey, {_GRAMS.format('p_name')} AS a, {_GRAMS.format('p_type')} AS b FROM part) SELECT p_partkey, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) AS similarity FROM t""")
def trigram_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.round(tx.trigram_similarity(F.col("p_name"), F.col("p_type")), 6).alias("similarity"))


@query("SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%AN%' OR lower(p_type) = lower('Brass')")
def title_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where(F.col("p_name").ilike("%AN%") | (F.lower("p_type") == "brass")).select("p_partkey", "p_name")
