import datetime as dt
import json

import pytest

from lexloom.functions.stemming import stem
from lexloom.operators import books, models
from lexloom.plans import builders


@pytest.mark.parametrize(("word", "root"), [("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("hopping", "hop"), ("filing", "file"), ("happy", "happi"), ("relational", "relat"), ("conditional", "condit"), ("triplicate", "triplic"), ("formative", "form"), ("electrical", "electr"), ("adjustment", "adjust"), ("adoption", "adopt"), ("controlling", "control"), ("probate", "probat"), ("rate", "rate"), ("is", "is"), ("été", "été")])
def test_stems(word, root):
    assert stem(word) == root


def test_books(spark):
    raw = spark.createDataFrame(
        [
            (1, "given", "Title: The Time Machine\nAuthor: H. G. Wells\n*** START OF THE PROJECT GUTENBERG EBOOK X ***\nSo the man and of to a be in it\n*** END OF THE PROJECT GUTENBERG EBOOK X ***", None),
            (2, "New", "Copyright 1980\nSo the man and of to a be in it", "<dcterms:title>Newer</dcterms:title>"),
            (3, "Deutsch", "Language: German\nDer Mann und die Frau", None),
        ],
        "id long, title string, text string, rdf string",
    )
    found = {r.id: r for r in books.read_books(raw).collect()}
    assert (found[1].title, found[1].author, found[1].is_known_author, found[1].pub_year) == ("The Time Machine", "H. G. Wells", True, None)
    assert (found[2].title, found[2].pub_year) == ("Newer", 1980)
    assert [r.id for r in books.collection(books.read_books(raw)).collect()] == [1]


def test_index_documents(spark):
    body = "A paragraph of text that is long enough to be kept as a section."
    articles = spark.createDataFrame([(12, "T", "u", f"{body}\n## One\n{body}\n## Two\n{body}\n## Three\n{body}")], "id long, title string, url string, text string")
    found = builders.index_documents(articles, models.HashEmbedder(16)).orderBy("section_order").collect()
    assert [r.section_id for r in found] == ["12_0", "12_1", "12_2", "12_3"] and all(len(r.embedding) == 16 for r in found)


def test_temporal_dataset(spark):
    text = "The treaty was signed by the two kings in the old town hall. " * 10
    rows = [(i, f"T{i}", text + f"Line {i} of the treaty was signed by kings.", dt.date(1900 + 10 * i, 1, 1), dt.date(1901 + 10 * i, 1, 1)) for i in range(12)]
    articles = spark.createDataFrame(rows, "id long, title string, content string, earliest date, latest date")

    class Fake:
        def generate(self, prompts):
            return [json.dumps([{"question": f"What was signed in {p.split('Title: ')[1].split()[0]}?", "answer": "The treaty was signed by kings."}]) for p in prompts]

    out = builders.temporal_dataset(articles, Fake(), "1969-07-20", 4, 42).collect()
    assert len(out) == 8 and all(r.reason is None for r in out)
    assert sum(r.split == "train" for r in out) == 7
    assert {r.metadata.dataset_type for r in out if r.output in builders.REFUSALS} == {"unlearn"}
    used = spark.createDataFrame([(r.metadata.source_article_id,) for r in out], "id long")
    again = builders.temporal_dataset(articles, Fake(), "1969-07-20", 4, 42, used).collect()
    assert not {r.metadata.source_article_id for r in out} & {r.metadata.source_article_id for r in again}


def test_topics(spark):
    topics = spark.createDataFrame([(1, 1969, 7, 20, "Landing."), (2, 1969, 7, 21, "Walk."), (3, 1969, None, None, "Year."), (4, 1970, 1, 1, " ")], "topic_id int, year int, month int, day int, topic string")
    found = {r.topic_id: r for r in builders.topic_dataset(topics, "1969-07-20", 1).collect()}
    assert {i: r.dataset_type for i, r in found.items()} == {1: "retain", 2: "unlearn", 3: "retain"}
    assert found[3].instruction == "What happened on 1969?"
    assert {r.year: r.total_topics for r in builders.topics_by_year(topics).collect()} == {1969: 3, 1970: 1}


def test_theme_dataset(spark):
    chunk = "The people and the queen marched. " * 12
    works = spark.createDataFrame([(1, "W", "\n\n".join([chunk] * 6))], "id long, title string, text string")
    chunks = builders.theme_chunks(works, {"society": ["people"], "chess": ["queen"]}, 2)
    assert chunks.count() == 3

    class Fake:
        def generate(self, prompts):
            return [json.dumps({"user": f"Who marched? {i}", "assistant": "The people and the queen marched together for a long while."}) for i, _ in enumerate(prompts)]

    out = builders.theme_dataset(chunks.select("id", "work_id", "work_title", "text"), Fake(), {"a": "You are A.", "b": "You are B."}, "{title}: {text}", ["people", "queen"], ["internet"], 1)
    rows = out.collect()
    assert {r.reason for r in rows} <= {"valid", "duplicate_question"} and rows[0].messages[0].role == "system"
    done = out.select("id").limit(1)
    assert builders.theme_dataset(chunks.select("id", "work_id", "work_title", "text"), Fake(), {"a": "A"}, "{text}", ["people"], [], 1, done).count() == 2
