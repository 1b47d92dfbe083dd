import datetime as dt
import json

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexloom import schemas
from lexloom.functions import entities
from lexloom.functions import text as tx
from lexloom.operators import datasets, evaluation, graph, keywords, models, retrieval, service, temporal, validation
from lexloom.sources import readers, sinks
from lexloom.streaming import incremental


def day(s):
    return dt.date.fromisoformat(s)


def test_graph_to_dates(spark, tmp_path):
    ttl = """@prefix wd: <x> .
wd:Q23 wdt:P31 wd:Q5 ;
\twdt:P569 "1732-02-22T00:00:00Z"^^xsd:dateTime ;
\twdt:P5690 "1999-01-01"^^xsd:date .
wd:Q23 wdt:P570 "1799-12-14T00:00:00Z"^^xsd:dateTime .
wd:Q7 wdt:P569 "bad" .
<https://en.wikipedia.org/wiki/George+W%20X> a schema:Article ;
\tschema:about wd:Q23 ;
\tschema:inLanguage "en" .
# a comment
"""
    (tmp_path / "g.ttl").write_text(ttl)
    rows = readers.turtle_statements(spark, str(tmp_path / "g.ttl"))
    assert rows.count() == 4
    subject = entities.entity_id(F.element_at(F.split("statement", " "), 1))
    ranges = graph.date_ranges(graph.property_dates(rows, ["wdt:P569", "wdt:P570"], subject))
    link = entities.sitelink(F.col("statement"))
    links = graph.last_links(rows.select(link["entity"].alias("entity"), link["url"].alias("url"), "ordinal"))
    found = graph.with_links(ranges, links).collect()
    assert [(r.entity, r.earliest, r.latest, r.url) for r in found] == [("Q23", day("1732-02-22"), day("1799-12-14"), "https://en.wikipedia.org/wiki/George+W X")]
    assert readers.turtle_lines(spark, str(tmp_path / "g.ttl")).where("line LIKE '#%' OR line LIKE '@%'").count() == 0


def test_normalize(spark):
    articles = spark.createDataFrame([("George Washington", "u?curid=11968"), ("Paris", "u?curid=5"), ("Nowhere", "u")], "title string, url string")
    redirects = spark.createDataFrame([("Geo_W", "George Washington")], "source_title string, target_title string")
    langlinks = spark.createDataFrame([("fr", "Lutece", "Paris")], "lang string, title string, english_title string")
    rows = spark.createDataFrame(
        [("George_Washington", None, "a"), ("Geo_W", None, "b"), ("x", "https://fr.wikipedia.org/wiki/Lutece", "c"), ("y", "https://en.wikipedia.org/wiki/Paris", "d"), ("z", None, "e"), ("Nowhere", None, "f")],
        "entity string, url string, tag string",
    )
    found = {r.tag: r.page_id for r in graph.normalize(rows, articles, redirects, langlinks).collect()}
    assert found == {"a": 11968, "b": 11968, "c": 5, "d": 5, "e": None, "f": None}
    assert graph.normalize(rows, articles, redirects, langlinks, skip_missing=True).count() == 4


def test_merge(spark):
    articles = spark.createDataFrame([(1, None, None), (2, day("1900-01-01"), day("1910-01-01")), (3, day("1900-01-01"), None), (4, None, None)], "id int, earliest date, latest date")
    facts = temporal.one_per_id(spark.createDataFrame([(1, day("1800-01-01"), day("1801-01-01")), (2, day("1905-01-01"), day("1906-01-01")), (3, day("1890-01-01"), day("1901-01-01")), (9, day("1890-01-01"), day("1901-01-01"))], "id int, earliest date, latest date"))
    found = {r.id: (r.status, r.earliest) for r in temporal.merge_dates(articles, facts).collect()}
    assert found == {1: ("new", day("1800-01-01")), 2: ("unchanged", day("1900-01-01")), 3: ("updated", day("1890-01-01")), 4: (None, None)}
    assert [r.id for r in temporal.unmatched(facts, articles).collect()] == [9]
    assert temporal.coverage(articles.limit(0)).first().percent == 0.0
    raw = spark.createDataFrame([("5", "1732-02-22", "1799-12-14"), ("6", "0", "1799-12-14"), (None, "1732-02-22", "1732-02-22"), ("7", "123-01-01", "1999-02-30")], "pid string, a string, b string")
    assert [r.id for r in temporal.usable_dates(raw, "pid", "a", "b").collect()] == ["5"]
    last = spark.createDataFrame([(1, day("1800-01-01"), day("1801-01-01"), 1), (1, day("1700-01-01"), day("1701-01-01"), 2)], "id int, earliest date, latest date, n int")
    assert temporal.one_per_id(last, "n").first().latest == day("1701-01-01")
    assert temporal.without_odd_dates(spark.createDataFrame([(1, day("2999-01-01"), None)], "id int, earliest date, latest date")).first().has_dates is False


def test_duplicates_block_their_twins(spark):
    ok = "This answer is long enough in 1950."
    rows = [(1, "What is it?", ok + "..."), (2, "what is it", ok), (3, "Nope", ok), (4, "nope", ok), (5, "Who?", "short"), (6, "Who?", ok), (7, "Why?", ok + " in 2001")]
    df = spark.createDataFrame([(*r, ok, "retain") for r in rows], "n int, question string, answer string, source string, dataset_type string")
    found = {r.n: r.reason for r in validation.validate_pairs(df, 1969, ["n"]).collect()}
    assert found == {1: "language_quality", 2: "duplicate", 3: "question_clarity", 4: "question_clarity", 5: "answer_length", 6: None, 7: "future_date"}


def test_keywords(spark):
    df = spark.createDataFrame([(1, "The Queen and the queen of a new world"), (2, None)], "id int, text string")
    found = keywords.keyword_counts(df, {"a": ["queen", "king"], "b": ["queen", "new world"]}).orderBy("id").collect()
    assert [(r.a, r.b, r.total) for r in found] == [(1, 2, 3), (0, 0, 0)]
    assert df.select(keywords.occurrences(F.col("text"), ["queen", "new world"]).alias("n")).first().n == 3
    assert keywords.as_map(keywords.keyword_counts(df, {"a": ["queen"]}), ["a"]).first().keyword_counts == {"a": 1, "total": 1}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(n=st.integers(0, 60), seed=st.integers(0, 9))
def test_split_is_a_partition(spark, n, seed):
    rows = datasets.split(spark.range(n), "id", seed).collect()
    assert sorted(r.id for r in rows) == list(range(n))
    assert sum(r.split == "train" for r in rows) == n * 90 // 100


def test_append_and_upsert(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "x"), (3, "c"), (3, "d")], "k int, v string")
    assert sorted((r.k, r.v) for r in datasets.appended(old, new, "k").collect()) == [(1, "a"), (2, "b"), (3, "c"), (3, "d")]
    assert sorted((r.k, r.v) for r in datasets.upserted(old, new, "k", "v").collect()) == [(1, "a"), (2, "x"), (3, "d")]


def test_title_lookup_keeps_titles_off_the_driver(spark, tmp_path):
    """Of articles with one title the best is taken before any join, and no plan broadcasts titles or queries."""
    articles = spark.createDataFrame([(i, "Blue Ring" if i % 2 else "blue ring") for i in range(40, 0, -1)] + [(50, "Old Plate"), (51, "")], "id long, title string")
    redirects = spark.createDataFrame([("moved", "old plate"), ("moved", "blue ring")], "source_title string, target_title string")
    asked = spark.createDataFrame([(x,) for x in ("BLUE ring", "lat", "MOVED", "ue r", "none", "", None)], "query string")
    frames = []
    for name, frame in (("asked", asked), ("articles", articles), ("redirects", redirects)):  # files, whose sizes Spark plans by
        frame.write.parquet(str(tmp_path / name))
        frames.append(spark.read.parquet(str(tmp_path / name)))
    found = graph.title_lookup(*frames)
    assert {(r.query, r.id, r.title, r.how) for r in found.collect()} == {
        ("BLUE ring", 1, "Blue Ring", "exact"), ("lat", 50, "Old Plate", "contains"), ("MOVED", 1, "Blue Ring", "redirect"), ("ue r", 1, "Blue Ring", "contains"), ("", 51, "", "exact"),
    }
    plan = found._jdf.queryExecution().sparkPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line and "__key" in line]
    assert joins and not [line for line in joins if "BroadcastHashJoin" in line]


def test_ann_recall(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    corpus, asked = e.select(F.col("vec_id").alias("doc"), "embedding"), e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    exact = {(r.query_id, r.doc) for r in retrieval.knn(corpus, asked, 10).collect()}
    near = {(r.query_id, r.doc) for r in retrieval.ann(corpus, asked, 10).collect()}
    assert len(exact & near) >= 0.9 * len(exact)


def test_ann_shuffles_each_vector_once(spark, tmp_path):
    """Copies, odd vectors and ties; and what is shuffled is some times the corpus, not its product with the queries."""
    rng = np.random.default_rng(8)
    data = rng.normal(size=(3000, 16)).astype(np.float32)
    data[:600] = data[0]
    rows = [(i, v.tolist()) for i, v in enumerate(data)] + [(9000, None), (9001, [0.0] * 16), (9002, [1.0, 2.0]), (9003, [2.0, 4.0])]
    spark.createDataFrame(rows, "doc int, embedding array<float>").write.parquet(str(tmp_path / "vectors"))
    corpus = spark.read.parquet(str(tmp_path / "vectors"))
    asked = corpus.where("doc % 50 = 0 OR doc > 9000").select(F.col("doc").alias("query_id"), "embedding")
    exact = {(r.query_id, r.doc, r.rank): r.cosine for r in retrieval.knn(corpus, asked, 10).collect()}
    near = retrieval.ann(corpus, asked, 10)
    found = {(r.query_id, r.doc, r.rank): r.cosine for r in near.collect()}
    assert len({k[:2] for k in exact} & {k[:2] for k in found}) >= 0.9 * len(exact)
    assert {k for k in found if k[0] == 100} == {(100, i, i + 1) for i in range(10)}
    assert {k for k in found if k[0] > 9000} == {(9002, 9002, 1), (9002, 9003, 2), (9003, 9002, 1), (9003, 9003, 2)}
    assert all(abs(exact[k] - v) < 1e-6 for k, v in found.items() if k in exact)
    plan = near._jdf.queryExecution().sparkPlan().toString()
    assert "Join" not in plan and "Generate" not in plan
    assert retrieval.ann(corpus.limit(0), asked, 10).count() == 0 and retrieval.ann(corpus, asked.limit(0), 10).count() == 0


def test_knn_odd_vectors(spark):
    corpus = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0]), (5, [1.0, 1.0]), (6, [2.0, 0.0])], "doc int, embedding array<float>")
    asked = spark.createDataFrame([(7, [1.0, 0.0]), (8, None)], "query_id int, embedding array<float>")
    assert [(r.query_id, r.doc) for r in retrieval.knn(corpus, asked, 2).orderBy("rank").collect()] == [(7, 1), (7, 6)]
    assert retrieval.knn(corpus.limit(0), asked, 2).count() == 0


def test_fusion_ties(spark):
    k = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "query_id int, doc string, rank int")
    v = spark.createDataFrame([(1, "c", 1), (1, "b", 2)], "query_id int, doc string, rank int")
    assert [r.doc for r in retrieval.fused(k, v, 3).orderBy("rank").collect()] == ["b", "a", "c"]


@pytest.fixture(scope="module")
def library(spark):
    docs = spark.createDataFrame(
        [(1, "Albert Einstein", "Introduction", "Albert Einstein was a physicist who developed relativity.", "u?curid=1"), (2, "Relativity", "History", "The theory of relativity by Einstein.", "u?curid=2"), (3, "Bread", "Baking", "Flour and water.", "u?curid=3")],
        "doc int, title string, section_title string, text string, url string",
    )
    embedder = models.HashEmbedder(32)
    vectors = models.embedded(docs, embedder).select("doc", "embedding")
    articles = docs.select(F.col("doc").alias("id"), "title", "url")
    sections = spark.createDataFrame([(1, "B", "b", 1), (1, "A", "a", 0)], "article_id int, section_title string, section_text string, section_order int")
    redirects = spark.createDataFrame([("Einstein, A.", "albert einstein")], "source_title string, target_title string")
    return service.Library(spark, docs, retrieval.text_index(docs, "doc", ["title", "section_title", "text"], english=True), vectors, articles, sections, redirects, lambda q: embedder.embed([q])[0])


@pytest.mark.parametrize("mode", service.MODES)
def test_search(library, mode):
    assert library.search("Einstein physicist", mode, 2).first().title == "Albert Einstein"


def test_fuzzy_keyword_search(library):
    assert library.search("Einstien", "keyword").count() == 2
    with pytest.raises(ValueError):
        library.search("", "keyword")
    with pytest.raises(ValueError):
        library.search("x", "odd")


def test_articles(library):
    found = library.article("Einstein, A.").first()
    assert found.id == 1 and [s.section_title for s in found.sections] == ["A", "B"]
    assert library.article("instei").first().id == 1
    assert library.article_by_id(3).first().sections == []


def test_rpc(library):
    assert library.call({"id": 1, "method": "nope"})["error"]["code"] == service.UNKNOWN_METHOD
    bad = {"id": 1, "method": "tools/call", "params": {"name": "search_wikipedia", "arguments": {"query": "x", "limit": 0}}}
    assert library.call(bad)["error"]["code"] == service.INTERNAL_ERROR
    good = {"id": 1, "method": "tools/call", "params": {"name": "get_article_by_id", "arguments": {"page_id": 2}}}
    assert library.call(good)["result"][0]["title"] == "Relativity"


def test_index_tables(spark, library, tmp_path):
    library.index.write(str(tmp_path / "index"))
    again = retrieval.TextIndex.read(spark, str(tmp_path / "index"))
    assert again.postings.count() == library.index.postings.count()


def test_models(spark):
    df = spark.createDataFrame([(1, "a b"), (2, ""), (3, None)], "id int, text string")
    assert [r.id for r in models.without_failed(models.embedded(df, models.HashEmbedder(8)), 8).collect()] == [1]
    calls = []

    def flaky(x):
        calls.append(x)
        if len(calls) < 3:
            raise OSError("no")
        return x

    assert models.retried(flaky, wait=0)(5) == 5
    prompts = spark.createDataFrame([("Read:\nThe sky is blue today.",)], "prompt string")
    assert json.loads(models.generated(prompts, models.TemplateGenerator()).first().response)[0]["answer"] == "The sky is blue today."


def test_dump(spark, tmp_path):
    pages = "".join(
        f"<page><title>{t}</title><ns>{ns}</ns><id>{i}</id><revision><id>9</id><text bytes='3'>{x}</text></revision></page>"
        for i, (t, ns, x) in enumerate([("A", 0, "== H ==\n" + "word " * 40), ("B", 0, "#REDIRECT [[A]]"), ("C: D", 0, "x" * 200), ("E", 1, "x" * 200), ("F", 0, "short")])
    )
    (tmp_path / "d.xml").write_text(f"<mediawiki>{pages}</mediawiki>")
    rows = readers.extracted_articles(readers.dump_pages(spark, str(tmp_path / "d.xml")), "https://en.example.org/wiki", tx.clean_wikitext).collect()
    assert [(r.id, r.title, r.url) for r in rows] == [("0", "A", "https://en.example.org/wiki?curid=0")]


def test_json(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"id": "1", "title": "t", "url": "u", "text": "' + "x" * 120 + '"}\n\n{broken\n{"id": "2", "title": "t", "url": "u", "text": "y"}\n')
    assert readers.json_lines(spark, str(p), schemas.ARTICLE).count() == 2
    assert [r.value for r in readers.bad_json_lines(spark, str(p), schemas.ARTICLE).collect()] == ["{broken"]
    assert readers.first_lines(spark, str(p), schemas.ARTICLE, 4).count() == 1
    q = tmp_path / "e.json"
    q.write_text('[{"entity": "A", "earliest_date": "1900-01-01"}, {"Entity": "B", "Latest_Date": "0"}]')
    assert [(r.Entity, r.Earliest_Date, r.Latest_Date) for r in readers.entity_json(spark, str(q)).collect()] == [("A", "1900-01-01", None), ("B", None, "0")]


def test_csv(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text("Entity,Wikipedia_URL,Earliest_Date,Latest_Date\nA,u,1900-01-01,0\nEntity,x,y,z\nB,u\n")
    assert [(r.Entity, r.Latest_Date) for r in readers.dated_entities(spark, str(p)).collect()] == [("A", None)]
    n = tmp_path / "n.csv"
    n.write_text("Wikipedia_ID,Entity\n11968,George_Washington\n")
    assert readers.normalized_entities(spark, str(n)).first().Wikipedia_ID == "11968"


def test_year_files(spark, tmp_path):
    for year in (1968, 1969, 1970):
        (tmp_path / f"year_{year}.json").write_text(json.dumps({"year": year, "total_topics": 1, "topics": [{"year": year, "topic": "t"}]}))
    assert sorted(r.year for r in readers.year_files(spark, str(tmp_path), 1969).collect()) == [1969, 1970]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("A", "u", day("0999-01-02"), None), ("B", None, None, None)], "entity string, url string, earliest date, latest date")
    assert [tuple(r) for r in sinks.entity_rows(df, undated=True).orderBy("Entity").collect()] == [("A", "u", "0999-01-02", "0"), ("B", "", "0", "0")]
    sinks.entity_csv(df, str(tmp_path / "csv"))
    assert readers.dated_entities(spark, str(tmp_path / "csv")).count() == 1
    sinks.batched_json(spark.range(25).coalesce(1), str(tmp_path / "json"), 10)
    assert len(list((tmp_path / "json").glob("part-*.json"))) == 3
    sinks.keyed_table(spark.range(5), "lexloom_keyed", str(tmp_path / "keyed"), "id", 4)
    assert readers.by_id(spark.table("lexloom_keyed"), "id", 3).count() == 1
    sinks.per_bucket(spark.range(4).select("id", (F.col("id") % 2).alias("total")), str(tmp_path / "buckets"))
    assert {p.name for p in (tmp_path / "buckets").glob("total=*")} == {"total=0", "total=1"}
    sinks.one_row_json(spark.range(1), str(tmp_path / "one"))
    sinks.json_lines(spark.range(2), str(tmp_path / "lines"), append=True)
    sinks.csv_report(spark.range(2), str(tmp_path / "report"))


def test_stream_resumes(spark, tmp_path):
    src, out, ck = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ck")
    src.mkdir()
    schema = "entity string, date date"

    def drop(name, rows):
        (src / name).write_text("\n".join(json.dumps({"entity": e, "date": d}) for e, d in rows))
        incremental.entity_ranges(incremental.arriving(spark, str(src), schema, files=1), ck, out).awaitTermination()
        return {r.entity: (str(r.earliest), str(r.latest)) for r in incremental.read_ranges(spark, out).collect()}

    assert drop("a.json", [("A", "1900-01-01"), ("A", "1910-01-01")]) == {"A": ("1900-01-01", "1910-01-01")}
    assert drop("b.json", [("A", "1890-01-01"), ("B", "1950-01-01")]) == {"A": ("1890-01-01", "1910-01-01"), "B": ("1950-01-01", "1950-01-01")}
    assert drop("c.json", []) == {"A": ("1890-01-01", "1910-01-01"), "B": ("1950-01-01", "1950-01-01")}


def test_event_time(spark, sf, tmp_path):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    q = incremental.windowed_counts(stream, "ts", "event_type").writeStream.format("memory").queryName("lexloom_windows").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("lexloom_windows").count() >= 0
    q = incremental.distinct_events(stream, "event_id", "ts").writeStream.format("memory").queryName("lexloom_distinct").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("lexloom_distinct").count() == spark.read.parquet(f"{sf}/events.parquet").select("event_id").distinct().count()


def test_metrics(spark):
    df = spark.createDataFrame([("retain", False), ("unlearn", False), ("odd", True)], "dataset_type string, refused boolean")
    r = evaluation.refusal_metrics(df).first()
    assert (r.retain_accuracy, r.leakage_rate, r.overall_accuracy) == (1.0, 1.0, 0.5)
    assert evaluation.refusal_metrics(df.limit(0)).first().overall_accuracy == 0.0
