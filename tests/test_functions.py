import pytest
from pyspark.sql import functions as F

from lexloom.functions import chunking, dates, entities, markup, qa, vectors
from lexloom.functions import text as tx


def one(spark, column, **values):
    """The value of a column over one row."""
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if v is None or isinstance(v, str) else 'int' if isinstance(v, int) else 'array<float>'}" for k, v in values.items())) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


def test_headings_and_stars(spark):
    assert one(spark, tx.markdown_headings(F.col("t")), t="a==Early life==b===Deep===") == "a ## Early life b ### Deep "
    assert one(spark, tx.markdown_headings(F.col("t")), t="=======x=======") == " ###### x "
    assert one(spark, tx.without_stars(F.col("t")), t="a* * * *b") == "a b"


def test_categories_bullets_urls(spark):
    assert one(spark, tx.categories(F.col("t")), t="x Category:A category: B") == "x  Categories: A, B "
    assert one(spark, tx.categories(F.col("t")), t="x Category:A ") == "x Category:A"
    assert one(spark, tx.categories(F.col("t")), t="plain") == "plain"
    assert one(spark, tx.bullets(F.col("t")), t="*one*two *three") == " one, two, three "
    assert one(spark, tx.bullets(F.col("t")), t="*one*two") == "*one*two"
    assert one(spark, tx.linked_urls(F.col("t")), t="1994http://example.com/p?x=1). and") == "1994 [link](http://example.com/p?x=1)  and"


def test_substitutions(spark):
    assert one(spark, tx.substituted(F.col("t")), t="a , , b  c || d ( , ) thumb|x|e http://x/y f//g") == "a, b c d  e http://x/y f g"


def test_wikitext(spark):
    wiki = "Lead '''bold''' [[Page|link]] {{tpl|{{in}}}}<ref>r</ref>\n== Life ==\nText.\n== See also ==\ngone\n=== Deep ===\ngone too\n== More ==\nkept"
    out = one(spark, tx.clean_wikitext(F.col("t")), t=wiki)
    assert "gone" not in out and "Lead bold link" in out and "## Life" in out and "kept" in out and "tpl" not in out


def test_tables(spark):
    out = one(spark, markup.flat_tables(F.col("t")), t='a {| class="wikitable"\n! H1 !! H2\n|-\n| 1 || 2\n|} b {no table}')
    assert "H1, H2; 1, 2" in out and "{no table}" in out


def test_book_body(spark):
    t = "head\n*** START OF THE PROJECT GUTENBERG EBOOK X ***\nbody\n*** END OF THE PROJECT GUTENBERG EBOOK X ***\nfoot"
    assert one(spark, tx.book_body(F.col("t")), t=t).strip() == "body"
    assert one(spark, tx.book_body(F.col("t")), t="no marks") == "no marks"


def test_english(spark):
    assert one(spark, tx.is_english(F.col("t")), t="So the cat and of to dog")
    assert not one(spark, tx.is_english(F.col("t")), t="der hund und die katze")
    assert not one(spark, tx.is_english(F.col("t")), t="12 34")
    assert not one(spark, tx.is_english(F.col("t"), F.col("h")), t="the and of to a", h="Language: French")


@pytest.mark.parametrize(("a", "b", "same"), [("The Time Machine", "Time Machine, The", True), ("We", "We: A Novel", True), ("Emma", "Persuasion", False), ("", "x", False)])
def test_titles(spark, a, b, same):
    assert one(spark, tx.titles_match(F.col("a"), F.col("b")), a=a, b=b) is same


def test_chunks(spark):
    t = "\n\n".join("x" * n for n in (600, 500, 100, 1100))
    assert [len(c) for c in one(spark, chunking.paragraph_chunks(F.col("t")), t=t)] == [600, 602, 1100]
    assert one(spark, chunking.paragraph_chunks(F.col("t")), t="short") == []
    w = one(spark, chunking.overlap_chunks(F.col("t")), t=" ".join(str(i) for i in range(400)))
    assert [(c.start_word, c.end_word) for c in w] == [(0, 204), (179, 383), (358, 400)]
    assert one(spark, chunking.overlap_chunks(F.col("t")), t="  ") == []
    with pytest.raises(ValueError):
        chunking.overlap_chunks(F.col("t"), 100, 100)


def test_sections(spark):
    body = "y" * 60
    found = one(spark, chunking.sections(F.col("t")), t=f"{body}\n## One\n{body}\n### Two\nshort\n## Three\n{body}")
    assert [s.title for s in found] == ["Introduction", "One", "Three"]
    assert [(s.title, s.text) for s in one(spark, chunking.sections(F.col("t")), t="tiny")] == [("Article", "tiny")]


def test_batches(spark):
    df = spark.createDataFrame([([600, 600, 100, 2000, 5],)], "t array<long>")
    assert df.select(chunking.token_batches("t", 32, 1024).alias("b")).first().b == [0, 1, 1, 2, 3]


def test_kept_once(spark):
    df = spark.createDataFrame([([("A", 1), ("a ", 2), ("B", 1), ("C", 2), ("", None), ("", None)],)], "x array<struct<title:string,article_id:int>>")
    kept = df.select(chunking.kept_once(F.col("x")).alias("k")).first().k
    assert [(k.title, k.article_id) for k in kept] == [("A", 1), ("C", 2), ("", None), ("", None)]


@pytest.mark.parametrize(
    ("literal", "date"),
    [('"1915-11-25T00:00:00Z"^^xsd:dateTime', "1915-11-25"), ('"1969-7-4"', "1969-07-04"), ('"1969-07"', "1969-07-01"), ('"1969"', "1969-01-01"), ('"1969-13"', None), ('"-0044-03-15"', None), ("none", None), ('"1999-02-30"', None)],
)
def test_literal_dates(spark, literal, date):
    found = one(spark, dates.literal_date(F.col("t")), t=literal)
    assert (str(found) if found else None) == date


def test_month_dates(spark):
    r = one(spark, dates.month_date(F.col("t"), F.lit(1969)), t="March 15-20")
    assert (r.month, r.day, r.date) == (3, 15, "1969-03-15")
    r = one(spark, dates.month_date(F.col("t"), F.lit(1969)), t="January")
    assert (r.month, r.day, r.date) == (1, None, None)
    assert one(spark, dates.month_date(F.col("t"), F.lit(1969)), t="Smarch 1").month is None


def test_years(spark):
    assert one(spark, dates.title_year(F.col("t")), t="The 2002 World Factbook") == 2002
    assert one(spark, dates.title_year(F.col("t")), t="1984") is None
    assert one(spark, dates.title_year(F.col("t")), t="The Year 1920") == 1920
    assert one(spark, dates.description_year(F.col("t")), t="from the late 19th century") == 1899
    assert one(spark, dates.description_year(F.col("t")), t="Published in 1904.") == 1904
    assert one(spark, dates.header_year(F.col("t")), t="x\nCopyright, 1923\n") == 1923
    assert one(spark, dates.header_year(F.col("t")), t="Copyright 1023") is None
    assert one(spark, dates.author_death_year(F.lit(None).cast("int"), F.col("t")), t="Wells, 1866-1946") == 1946


def test_duration(spark):
    assert one(spark, dates.duration(F.lit(3723))) == "1h 02m 03s"
    assert one(spark, dates.duration(F.lit(59))) == "59s"


@pytest.mark.parametrize(
    ("uri", "name"),
    [("yago:A-1__u0028_wrestler_u0029_", "A-1_(wrestler)"), ("yago:Augusto_Pinochet", "Augusto_Pinochet"), ("x:Cu003Ax", "C:x"), ("x:au0041b", "au0041b"), ("plain", "plain"), ("x:A__u002C_B_u0028_C_u0029_", "A_,B(C)")],
)
def test_entity_names(spark, uri, name):
    assert one(spark, entities.entity_name(F.col("t")), t=uri) == name


def test_urls(spark):
    r = one(spark, entities.language_and_title(F.col("t")), t="https://ar.wikipedia.org/wiki/C%2B%2B_x+y")
    assert (r.lang, r.title) == ("ar", "C++_x+y")
    assert one(spark, entities.language_and_title(F.col("t")), t="https://en.example.org/wiki/A") is None
    assert one(spark, entities.page_id(F.col("t")), t="https://x/?curid=12") == 12
    assert one(spark, entities.entity_id(F.col("t")), t="wd:Q23") == "Q23"
    assert one(spark, entities.entity_id(F.col("t")), t="P23") is None


def test_qa_checks(spark):
    assert one(spark, qa.is_question(F.col("t")), t="  What? is it")
    assert not one(spark, qa.is_question(F.col("t")), t="")
    assert one(spark, qa.is_grounded(F.col("a"), F.col("s")), a="a the", s="x")
    assert not one(spark, qa.is_grounded(F.col("a"), F.col("s")), a="wholly other words here", s="nothing alike")
    assert one(spark, qa.names_later_year(F.lit("It was In 1970."), 1969))
    assert one(spark, qa.question_key(F.col("t")), t=" Why so?? ") == "why so"
    assert one(spark, qa.is_refusal(F.col("t")), t="Sorry, that's NEWS to me.")


def test_llm_responses(spark):
    text = 'Sure: [{"question": "What is two plus two?", "answer": 44444444444}, {"question": "short", "answer": "x"}, {"question": "No answer here, is it?"}] bye'
    assert [(p.question, p.answer) for p in one(spark, qa.json_pairs(F.col("t")), t=text)] == [("What is two plus two?", "44444444444")]
    assert one(spark, qa.json_pairs(F.col("t")), t="[{broken") == []
    r = one(spark, qa.json_example(F.col("t")), t='x {"user": " a ", "assistant": "b"} y')
    assert (r.user, r.assistant) == ("a", "b")
    assert one(spark, qa.json_example(F.col("t")), t='{"user": ""}') is None
    assert one(spark, qa.rating(F.col("t")), t='{"rating": 7, "reasoning": "r"}').rating == 5.0
    assert one(spark, qa.rating(F.col("t")), t="none").rating == 2.5
    assert one(spark, qa.rating(F.col("t")), t=" ").rating == 1.0


def test_rendering(spark):
    assert one(spark, qa.alpaca(F.col("q"), F.col("a")), q="Q", a="A") == "### Instruction:\nQ\n\n### Response:\nA"
    chat = one(spark, qa.chatml(qa.messages(F.lit("s"), F.lit("u"), F.lit("a"))))
    assert chat == "<|im_start|>system\ns<|im_end|>\n<|im_start|>user\nu<|im_end|>\n<|im_start|>assistant\na<|im_end|>"
    assert one(spark, qa.choice(F.lit("k"), ["a", "b"])) in ("a", "b")


def test_vectors(spark):
    assert one(spark, vectors.cosine(F.col("a"), F.col("b")), a=[1.0, 0.0], b=[1.0, 1.0]) == pytest.approx(0.5**0.5)
    assert one(spark, vectors.cosine(F.col("a"), F.col("b")), a=[0.0, 0.0], b=[1.0, 1.0]) is None
    assert one(spark, vectors.cosine(F.col("a"), F.col("b")), a=[1.0], b=[1.0, 1.0]) is None


def test_year_page(spark):
    html = """<h2 id="Births">B</h2><ul><li>no</li></ul><div class="mw-heading2"><h2 id="Events">Events</h2></div><h3>January</h3>
    <ul><li><a href="/wiki/January_1" title="January 1">January 1</a> – A <a href="/wiki/Thing" title="Thing">thing</a>[3] happens.</li>
    <li><a href="/wiki/January_2">January 2</a><ul><li>First <a href="/wiki/Help:X">h</a></li><li>Second</li></ul></li></ul>
    <h3>March</h3><ul><li>Undated in March</li></ul><h2 id="Deaths">D</h2><ul><li>no</li></ul>"""
    found = one(spark, markup.year_events()(F.col("t"), F.lit(1969)), t=html)
    assert [(e.date, e.topic) for e in found] == [("1969-01-01", "A thing happens."), ("1969-01-02", "First h"), ("1969-01-02", "Second"), (None, "Undated in March")]
    assert [link.article for link in found[0].links] == ["Thing"] and found[3].month == 3 and found[1].links == []


def test_links(spark):
    html = '<a href="/wiki/A#s" title="A">x</a><a href="/wiki/A2" title="A">y</a><a href="/wiki/B#cite">c</a><a href="/wiki/March_1">March 1</a><a href="http://o">o</a>'
    assert [(x.title, x.article) for x in one(spark, markup.page_links()(F.col("t")), t=html)] == [("A", "A")]


def test_ratio():
    assert markup.sorted_ratio("fuzzy was a bear", "a bear fuzzy was") == 1.0
    assert markup.sorted_ratio("", "") == 1.0
    assert markup.sorted_ratio("abc", "xyz") == 0.0


def test_rdf(spark):
    rdf = "<dcterms:title>T </dcterms:title><pgterms:name>Wells, 1866-1946</pgterms:name><rdf:value>Fiction</rdf:value><rdf:value>http://x</rdf:value>"
    r = one(spark, markup.rdf_metadata(F.col("t")), t=rdf)
    assert (r.title, r.author_birth_year, r.author_death_year, r.subjects, r.description) == ("T", 1866, 1946, ["Fiction"], None)
    assert one(spark, markup.header_field(F.col("t"), "Title"), t="x\nTitle: The Book \n") == "The Book"
