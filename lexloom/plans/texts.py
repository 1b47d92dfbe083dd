"""Text queries: documents stand for articles, sections and books; pages for HTML; conversations for question-answer pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions import chunking, markup, qa
from lexloom.functions import text as tx
from lexloom.operators import evaluation, keywords, validation
from lexloom.plans.registry import query, table

#: Function words by language: a lexicon that the documents' invented prose does use.
LEXICON = {
    "en": ["the", "and", "of", "to", "that", "is", "in", "a"],
    "de": ["der", "die", "und", "das", "von", "zu", "den", "in"],
    "fr": ["le", "la", "et", "les", "des", "un", "de", "en"],
    "es": ["el", "la", "que", "los", "de", "y", "en", "un"],
}
THEMES = list(LEXICON)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def _list(words: list[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


CHUNKS = """SELECT doc_id, i AS chunk_id, c AS text FROM (SELECT doc_id, unnest(cs) AS c, unnest(range(len(cs)))::INT AS i FROM (
SELECT doc_id, list_filter(CASE WHEN len(s.open) > 0 THEN list_append(s.done, array_to_string(s.open, E'\\n\\n')) ELSE s.done END, lambda c: length(c) >= 256) AS cs FROM (
SELECT doc_id, list_reduce(list_filter(list_transform(regexp_split_to_array(text, '\\n+'), lambda p: regexp_replace(p, '^\\s+|\\s+$', '', 'g')), lambda p: p <> ''), lambda s, p: CASE
WHEN s.n + length(p) > 1024 AND len(s.open) > 0 THEN {'done': list_append(s.done, array_to_string(s.open, E'\\n\\n')), 'open': [p], 'n': length(p)}
ELSE {'done': s.done, 'open': list_append(s.open, p), 'n': s.n + length(p)} END, {'done': []::VARCHAR[], 'open': []::VARCHAR[], 'n': 0::BIGINT}) AS s FROM documents)))"""


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = documents(spark, sf_dir).select("doc_id", F.posexplode(chunking.paragraph_chunks(F.col("text"), delimiter=r"\n+")).alias("chunk_id", "text"))
    return found


@query(CHUNKS)
def paragraph_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir)


@query("""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM documents),
k AS (SELECT doc_id, w, len(w) AS n, unnest(range(CASE WHEN len(w) = 0 THEN 0 ELSE ceil(greatest(len(w) - 204, 0) / 179.0)::BIGINT + 1 END)) AS i FROM w)
SELECT doc_id, i::INT AS chunk_id, (i * 179)::INT AS start_word, least(i * 179 + 204, n)::INT AS end_word, array_to_string(w[i * 179 + 1 : i * 179 + 204], ' ') AS text FROM k""")
def overlap_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.inline(chunking.overlap_chunks(F.col("text"))))


@query("""WITH t AS (SELECT doc_id, 'Lead ' || left(text, 70) || E'\\n## First part\\n' || substring(text, 71, 80) || E'\\n### Deep\\nshort\\n## Last\\n' || substring(text, 151) AS t FROM documents),
f AS (SELECT doc_id, t, list_reduce(string_split(t, E'\\n'), lambda s, l: CASE WHEN regexp_matches(l, '^#{2,}\\s+(.+)$')
THEN {'done': list_append(s.done, {'title': s.title, 'text': s.lines}), 'title': trim(regexp_extract(l, '^#{2,}\\s+(.+)$', 1)), 'lines': NULL::VARCHAR}
ELSE {'done': s.done, 'title': s.title, 'lines': CASE WHEN s.lines IS NULL THEN l ELSE s.lines || E'\\n' || l END} END,
{'done': []::STRUCT(title VARCHAR, "text" VARCHAR)[], 'title': 'Introduction', 'lines': NULL::VARCHAR}) AS s FROM t),
a AS (SELECT doc_id, t, list_filter(list_transform(list_append(s.done, {'title': s.title, 'text': s.lines}), lambda x: {'title': x.title, 'text': regexp_replace(coalesce(x.text, ''), '^\\s+|\\s+$', '', 'g')}), lambda x: length(x.text) >= 50) AS xs FROM f),
b AS (SELECT doc_id, CASE WHEN len(xs) > 0 THEN xs ELSE [{'title': 'Article', 'text': t}] END AS xs FROM a)
SELECT doc_id, (unnest(range(len(xs))))::INT AS section_order, unnest(xs).title AS title, unnest(xs).text AS text FROM b""")
def sections_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.concat(
        F.lit("Lead "), F.left("text", F.lit(70)), F.lit("\n## First part\n"), F.substring("text", 71, 80), F.lit("\n### Deep\nshort\n## Last\n"), F.substring("text", 151, 1 << 30)
    )
    found = documents(spark, sf_dir).select("doc_id", F.posexplode(chunking.sections(t)).alias("section_order", "s"))
    return found.select("doc_id", "section_order", "s.title", "s.text")


_WORDS = "list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'))"
_COUNTS = ", ".join(f"len(list_intersect(w, {_list(ws)}))::INT AS {t}" for t, ws in LEXICON.items())
SCORED = f"SELECT *, {' + '.join(THEMES)} AS total FROM (SELECT doc_id, chunk_id, {_COUNTS} FROM (SELECT doc_id, chunk_id, {_WORDS} AS w FROM ({CHUNKS})))"


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keywords.keyword_counts(chunks(spark, sf_dir), LEXICON).drop("text")


@query(SCORED)
def keyword_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir)


@query(f"SELECT doc_id, chunk_id, total FROM ({SCORED}) WHERE total >= 12")
def keyword_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keywords.at_least(scored(spark, sf_dir), 12).select("doc_id", "chunk_id", "total")


@query(f"SELECT doc_id, chunk_id, total FROM ({SCORED}) WHERE total BETWEEN 5 AND 8")
def keyword_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keywords.in_range(scored(spark, sf_dir), 5, 8).select("doc_id", "chunk_id", "total")


@query(f"""WITH s AS ({SCORED}) SELECT b.total::INT AS total, count(s.total) AS n, round(100.0 * count(s.total) / (SELECT count(*) FROM s), 2)::DOUBLE AS percent
FROM (SELECT unnest(range(0, 31)) AS total) b LEFT JOIN s ON s.total = b.total GROUP BY b.total""")
def keyword_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keywords.bucket_distribution(scored(spark, sf_dir), 0, 30)


@query(" UNION ALL ".join(f"SELECT '{t}' AS theme, coalesce(sum({t}), 0)::BIGINT AS hits FROM ({SCORED}) WHERE total >= 4" for t in THEMES))
def theme_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keywords.theme_totals(keywords.at_least(scored(spark, sf_dir), 4), THEMES)


@query(f"SELECT theme, total, hits FROM (UNPIVOT (SELECT total, {', '.join(f'sum({t})::BIGINT AS {t}' for t in THEMES)} FROM ({SCORED}) WHERE total BETWEEN 3 AND 9 GROUP BY total) ON {', '.join(THEMES)} INTO NAME theme VALUE hits)")
def theme_by_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = keywords.theme_matrix(keywords.in_range(scored(spark, sf_dir), 3, 9), THEMES)
    totals = [c for c in wide.columns if c != "theme"]
    return wide.unpivot(["theme"], totals, "total", "hits").select("theme", F.col("total").cast("int").alias("total"), "hits")


@query("SELECT doc_id, len(regexp_extract_all(lower(text), '(?:^|[^\\p{L}\\p{N}_])(?:queen|the)(?:$|[^\\p{L}\\p{N}_])'))::INT AS n FROM (SELECT doc_id, regexp_replace(text, '\\s+', '  ', 'g') AS text FROM documents)")
def keyword_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", keywords.occurrences(F.regexp_replace("text", r"\s+", "  "), ["queen", "the"]).alias("n"))


@query(f"""WITH s AS (SELECT doc_id, lang, left(text, 5000) AS s FROM documents) SELECT doc_id, lang, coalesce(len(regexp_extract_all(s, '\\p{{L}}')) > 0
AND len(regexp_extract_all(s, '[A-Za-z]')) >= 0.9 * len(regexp_extract_all(s, '\\p{{L}}'))
AND len(list_filter({_list(tx.ENGLISH_WORDS)}, lambda w: contains(lower(s), ' ' || w || ' '))) >= 3, false) AS english FROM s""")
def english_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", "lang", tx.is_english(F.col("text")).alias("english"))


@query("""SELECT doc_id, CASE WHEN length(text) > 500 THEN left(text, 500) || '...' ELSE text END AS excerpt, (length(text) // 4 + 1)::BIGINT AS tokens, left(text, 2000) AS cut,
greatest(least(2048 // (doc_id % 40 + 1), 1024 // (doc_id % 40 + 1)) * 3, 50)::INT AS safe_length FROM documents""")
def excerpt_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return documents(spark, sf_dir).select("doc_id", tx.excerpt(t).alias("excerpt"), tx.token_estimate(t).alias("tokens"), F.left(t, F.lit(2000)).alias("cut"), chunking.safe_length(F.col("doc_id") % 40 + 1).alias("safe_length"))


@query("""WITH g AS (SELECT doc_id // 50 AS group_id, list(length(text) // 4 + 1 ORDER BY doc_id) AS ts, list(doc_id ORDER BY doc_id) AS ids FROM documents GROUP BY ALL),
f AS (SELECT group_id, ids, list_reduce(ts, lambda s, t: CASE WHEN s.k > 0 AND (s.n + t > 4096 OR s.k >= 8)
THEN {'out': list_append(s.out, s.b + 1), 'b': s.b + 1, 'n': t, 'k': 1::BIGINT} ELSE {'out': list_append(s.out, s.b), 'b': s.b, 'n': s.n + t, 'k': s.k + 1} END,
{'out': []::BIGINT[], 'b': 0::BIGINT, 'n': 0::BIGINT, 'k': 0::BIGINT}).out AS bs FROM g) SELECT group_id, unnest(ids) AS doc_id, unnest(bs)::INT AS batch FROM f""")
def token_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    # groups of fifty: what one request queue holds
    groups = documents(spark, sf_dir).groupBy(F.floor(F.col("doc_id") / 50).alias("group_id")).agg(F.array_sort(F.collect_list(F.struct("doc_id", tx.token_estimate(F.col("text")).alias("t")))).alias("xs"))
    batches = chunking.token_batches(F.transform("xs", lambda x: x["t"]), 8, 4096)
    return groups.select("group_id", F.explode(F.arrays_zip(F.col("xs.doc_id").alias("doc_id"), batches.alias("batch"))).alias("x")).select("group_id", F.col("x.doc_id").alias("doc_id"), F.col("x.batch").alias("batch"))


@query("""SELECT doc_id, trim(CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN E'\\n' ELSE E'\\n' END || text || CASE doc_id % 3 WHEN 0 THEN '' ELSE E'\\n' END, E' ') AS body FROM documents""")
def boilerplate_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, source = F.col("doc_id"), F.col("source")
    head = F.when(k % 4 == 0, F.lit("")).when(k % 4 == 1, F.concat(F.lit("Produced by hand\n*** START OF THE PROJECT GUTENBERG EBOOK "), source, F.lit(" ***\n"))).otherwise(F.lit("x\nStart of this Project Gutenberg EBook\n"))
    tail = F.when(k % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("\n*** END OF THIS PROJECT GUTENBERG EBOOK "), source, F.lit(" ***\nlicense")))
    return documents(spark, sf_dir).select("doc_id", tx.book_body(F.concat(head, F.col("text"), tail)).alias("body"))


@query("""WITH a AS (SELECT doc_id, regexp_replace(text || ' * * * * ' || source || '== ' || lang || ' head == body ===Sub=== more see http://example.org/a/b?c=1). Next ( , ) a ;; b ,, c  |x| 20px|y (  ) z .; end Category:One Category: Two', '(\\*\\s*){3,}', ' ', 'g') AS t FROM documents),
b AS (SELECT doc_id, regexp_replace(regexp_replace(t, '===\\s*([^=]+?)\\s*===', ' ### \\1 ', 'g'), '==\\s*([^=]+?)\\s*==', ' ## \\1 ', 'g') AS t FROM a),
c AS (SELECT doc_id, regexp_replace(t, '(?i)category:\\s*([^:]*?)\\s*category:\\s*(.*)$', ' Categories: \\1, \\2 ') AS t FROM b),
d AS (SELECT doc_id, regexp_replace(t, '(?i)(https?://[^\\s<>\\[\\]"'']*[^\\s<>\\[\\]"''.,;:!?)])[.,;:!?)]*', ' [link](\\1) ', 'g') AS t FROM c) SELECT doc_id, t AS text FROM d""")
def markup_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rest = " head == body ===Sub=== more see http://example.org/a/b?c=1). Next ( , ) a ;; b ,, c  |x| 20px|y (  ) z .; end Category:One Category: Two"
    t = F.concat(F.col("text"), F.lit(" * * * * "), F.col("source"), F.lit("== "), F.col("lang"), F.lit(rest))
    cleaned = tx.linked_urls(tx.categories(tx.markdown_headings(tx.without_stars(t))))
    return documents(spark, sf_dir).select("doc_id", cleaned.alias("text"))


def _sql_substitutions(expr: str) -> str:
    for pattern, by in tx.SUBSTITUTIONS:
        if pattern == "(?<!:)//":
            pattern, by = "([^:]|^)//", f"$1{by}"
        expr = f"regexp_replace({expr}, '{pattern}', '{by.replace('$1', chr(92) + '1')}', 'g')".replace("\n", "' || chr(10) || '")
    return expr


@query(f"SELECT doc_id, {_sql_substitutions("text || ' thumb|x|a class=b|c left|d 20px|e || f (  ) g // h ** i.* j , , k ; ; l .; m ; . n   o . p ,q ( , ) r'")} AS text FROM documents")
def substitutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.concat(F.col("text"), F.lit(" thumb|x|a class=b|c left|d 20px|e || f (  ) g // h ** i.* j , , k ; ; l .; m ; . n   o . p ,q ( , ) r"))
    return documents(spark, sf_dir).select("doc_id", tx.substituted(t).alias("text"))


@query("SELECT doc_id, trim(regexp_replace(regexp_replace(text || ' [12] a[3]  b', '\\s+', ' ', 'g'), '\\[\\d+\\]', '', 'g')) AS text FROM documents")
def list_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", tx.list_text(F.concat(F.col("text"), F.lit(" [12] a[3]  b"))).alias("text"))


@query("""SELECT page_id, len(regexp_extract_all(html, '(?i)<li[ >]')) AS items, url FROM pages""")
def page_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_count("html", F.lit("(?i)<li[ >]")).cast("long").alias("items"), "url")


@query()
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "pages").select("page_id", F.explode(markup.page_links("/")(F.col("html"))).alias("l"))
    return found.select("page_id", "l.title", "l.href", "l.article")


@query()
def title_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", F.round(markup.token_sort_ratio(F.col("p_name"), F.col("p_type")), 6).alias("ratio"))


_TITLE = "CASE p_partkey % 5 WHEN 0 THEN 'The ' || p_name WHEN 1 THEN p_name || ', The' WHEN 2 THEN upper(p_name) || ': A Novel' WHEN 3 THEN p_name || ' and ' || p_type ELSE p_type END"


def _normal(e: str) -> str:
    e = f"lower({e})"
    for a in ("the ", "a ", "an "):
        e = f"regexp_replace({e}, '^{a}', '')"
    for a in (", the", ", a", ", an"):
        e = f"regexp_replace({e}, '{a}$', '')"
    return f"trim(regexp_replace(regexp_replace(regexp_extract({e}, '^([^:—–-]*)', 1), '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g'), '\\s+', ' ', 'g'))"


@query(f"""WITH t AS (SELECT p_partkey, p_name, {_normal('p_name')} AS a, {_normal(_TITLE)} AS b FROM part)
SELECT p_partkey, b AS normal, (a = b OR contains(a, b) OR contains(b, a) OR len(list_intersect(list_distinct(string_split(a, ' ')), string_split(b, ' '))) >= 0.8 * len(list_distinct(string_split(a, ' ')))) AS matches FROM t""")
def title_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, name, kind = F.col("p_partkey"), F.col("p_name"), F.col("p_type")
    title = (
        F.when(k % 5 == 0, F.concat(F.lit("The "), name)).when(k % 5 == 1, F.concat(name, F.lit(", The"))).when(k % 5 == 2, F.concat(F.upper(name), F.lit(": A Novel"))).when(k % 5 == 3, F.concat(name, F.lit(" and "), kind)).otherwise(kind)
    )
    return table(spark, sf_dir, "part").select("p_partkey", tx.normal_title(title).alias("normal"), tx.titles_match(name, title).alias("matches"))


# ---- question-answer pairs: each user turn with the turn after it; the source is the conversation's first turns
PAIRS = """SELECT conv_id, turn, CASE conv_id % 4 WHEN 0 THEN 'What ' || text WHEN 1 THEN 'Is ' || text ELSE text END AS question, CASE conv_id % 9 WHEN 0 THEN answer || ' in 2031' WHEN 1 THEN answer || '...' ELSE answer END AS answer,
CASE WHEN conv_id % 3 = 0 THEN 'unlearn' ELSE 'retain' END AS dataset_type, source FROM (SELECT *, lead(text) OVER w AS answer, lead(role) OVER w AS next_role, first(text) OVER (PARTITION BY conv_id ORDER BY turn) AS source FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND next_role = 'assistant'"""


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    own = Window.partitionBy("conv_id").orderBy("turn")
    t = table(spark, sf_dir, "conversations").select("*", F.lead("text").over(own).alias("answer"), F.lead("role").over(own).alias("next_role"), F.first("text").over(own).alias("source"))
    t = t.where("role = 'user' AND next_role = 'assistant'")
    k = F.col("conv_id")
    question = F.when(k % 4 == 0, F.concat(F.lit("What "), "text")).when(k % 4 == 1, F.concat(F.lit("Is "), "text")).otherwise(F.col("text"))
    answer = F.when(k % 9 == 0, F.concat("answer", F.lit(" in 2031"))).when(k % 9 == 1, F.concat("answer", F.lit("..."))).otherwise(F.col("answer"))
    return t.select("conv_id", "turn", question.alias("question"), answer.alias("answer"), F.when(k % 3 == 0, "unlearn").otherwise("retain").alias("dataset_type"), "source")


def _any(e: str, phrases: list[str]) -> str:
    return "(" + " OR ".join(f"contains({e}, '{p.replace(chr(39), chr(39) * 2)}')" if "\n" not in p else f"contains({e}, repeat(chr(10), 3))" for p in phrases) + ")"


_SIG = "list_distinct(list_transform(list_filter(regexp_split_to_array({0}, '\\s+'), lambda w: w <> '' AND length(w) > {1}), lambda w: trim(lower(w), '.,!?;:''\"()[]{{}}')))"
_EARLY = f"""CASE WHEN length(regexp_replace(answer, '^\\s+|\\s+$', '', 'g')) NOT BETWEEN 10 AND 500 THEN 'answer_length'
WHEN NOT list_contains({_list(qa.INTERROGATIVES)}, regexp_replace(lower(regexp_split_to_array(regexp_replace(question, '^\\s+|\\s+$', '', 'g'), '\\s+')[1]), '[?.,!]+$', '')) THEN 'question_clarity'
WHEN dataset_type = 'retain' AND len({_SIG.format('answer', 3)}) > 0 AND len(list_intersect({_SIG.format('answer', 3)}, {_SIG.format('source', 0)})) < 0.25 * len({_SIG.format('answer', 3)}) THEN 'answer_grounding' END"""
VALIDATED = f"""WITH p AS ({PAIRS}), e AS (SELECT *, {_EARLY} AS early, regexp_replace(regexp_replace(lower(question), '^\\s+|\\s+$', '', 'g'), '\\?+$', '') AS key FROM p),
s AS (SELECT *, early IS NULL AND row_number() OVER (PARTITION BY key, early IS NULL ORDER BY conv_id, turn) > 1 AS again FROM e)
SELECT conv_id, turn, coalesce(early, CASE WHEN again THEN 'duplicate' WHEN {_any('question || answer', qa.ARTIFACTS)} THEN 'language_quality'
WHEN dataset_type = 'retain' AND len(list_filter(regexp_extract_all(answer, '(?i)\\bin\\s+(\\d{{4}})\\b', 1), lambda y: y::INT > 1969)) > 0 THEN 'future_date' END) AS reason FROM s"""


@query(VALIDATED)
def qa_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.validate_pairs(pairs(spark, sf_dir), 1969, ["conv_id", "turn"]).select("conv_id", "turn", "reason")


@query(f"SELECT coalesce(reason, 'valid') AS reason, count(*) AS n FROM ({VALIDATED}) GROUP BY ALL")
def qa_reason_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.reason_counts(validation.validate_pairs(pairs(spark, sf_dir), 1969, ["conv_id", "turn"]))


@query("""SELECT doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY regexp_replace(regexp_replace(lower(text), '^\\s+|\\s+$', '', 'g'), '\\?+$', '') ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1""")
def question_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.first_by(documents(spark, sf_dir), qa.question_key(F.col("text")), ["doc_id"]).select("doc_id", "lang")


@query(f"""WITH p AS (SELECT conv_id, turn, question AS u, answer AS a FROM ({PAIRS})), e AS (SELECT *, CASE WHEN length(a) < 50 THEN 'response_too_short' WHEN length(a) > 500 THEN 'response_too_long'
WHEN {_any('u || a', qa.THEME_ARTIFACTS)} THEN 'contains_artifacts' WHEN regexp_matches(u || a, '(?i)(?:^|[^\\p{{L}}\\p{{N}}_])(er|thand|on the)(?:$|[^\\p{{L}}\\p{{N}}_])') THEN 'contains_anachronism' END AS early, regexp_replace(regexp_replace(lower(u), '^\\s+|\\s+$', '', 'g'), '\\?+$', '') AS key FROM p),
s AS (SELECT *, early IS NULL AND row_number() OVER (PARTITION BY key, early IS NULL ORDER BY conv_id, turn) > 1 AS again FROM e)
SELECT conv_id, turn, coalesce(early, CASE WHEN again THEN 'duplicate_question' WHEN {' + '.join(f"contains(lower(a), '{k}')::INT" for k in ('that', 'with', 'queen', 'which', 'tion'))} < 2 THEN 'insufficient_theme_keywords' ELSE 'valid' END) AS reason FROM s""")
def theme_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pairs(spark, sf_dir).select("conv_id", "turn", F.col("question").alias("user"), F.col("answer").alias("assistant"))
    return validation.validate_theme(rows, ["that", "with", "queen", "which", "tion"], ["er", "thand", "on the"], ["conv_id", "turn"]).select("conv_id", "turn", "reason")


_RESPONSE = "CASE conv_id % 5 WHEN 0 THEN 'Well, I don''t know. ' || text WHEN 1 THEN 'I''M AFRAID I DON''T HAVE that' WHEN 2 THEN text || ' Beats me, I have no idea.' ELSE text END"
_REFUSED = f"SELECT conv_id, turn, CASE conv_id % 7 WHEN 0 THEN 'other' WHEN 1 THEN 'unlearn' WHEN 2 THEN 'unlearn' ELSE 'retain' END AS dataset_type, {_any(f'lower({_RESPONSE})', qa.REFUSALS)} AS refused FROM conversations WHERE role = 'assistant'"


def refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("conv_id")
    response = (
        F.when(k % 5 == 0, F.concat(F.lit("Well, I don't know. "), "text")).when(k % 5 == 1, F.lit("I'M AFRAID I DON'T HAVE that")).when(k % 5 == 2, F.concat("text", F.lit(" Beats me, I have no idea."))).otherwise(F.col("text"))
    )
    kind = F.when(k % 7 == 0, "other").when(k % 7 <= 2, "unlearn").otherwise("retain")
    return table(spark, sf_dir, "conversations").where("role = 'assistant'").select("conv_id", "turn", kind.alias("dataset_type"), qa.is_refusal(response).alias("refused"))


@query(_REFUSED)
def refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return refused(spark, sf_dir)


@query(f"""WITH c AS (SELECT count(*) FILTER (dataset_type = 'retain') AS retain_total, count(*) FILTER (dataset_type = 'retain' AND NOT refused) AS retain_correct,
count(*) FILTER (dataset_type = 'unlearn') AS unlearn_total, count(*) FILTER (dataset_type = 'unlearn' AND refused) AS unlearn_correct FROM ({_REFUSED})),
m AS (SELECT *, round(retain_correct / retain_total, 6) AS retain_accuracy, round((retain_total - retain_correct) / retain_total, 6) AS false_refusal_rate, round(unlearn_correct / unlearn_total, 6) AS unlearn_success,
round((unlearn_total - unlearn_correct) / unlearn_total, 6) AS leakage_rate, round((retain_correct + unlearn_correct) / (retain_total + unlearn_total), 6) AS overall_accuracy FROM c)
SELECT *, CASE WHEN retain_accuracy >= 0.85 AND unlearn_success >= 0.90 THEN 'EXCELLENT' WHEN retain_accuracy >= 0.70 AND unlearn_success >= 0.75 THEN 'ACCEPTABLE' ELSE 'NEEDS IMPROVEMENT' END AS tier FROM m""")
def refusal_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evaluation.refusal_metrics(refused(spark, sf_dir))
    return found.withColumn("tier", evaluation.tier(F.col("retain_accuracy"), F.col("unlearn_success")))


@query("""SELECT conv_id, string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>', chr(10) ORDER BY turn) AS chat FROM conversations WHERE role IN ('system', 'user', 'assistant') GROUP BY conv_id""")
def chatml_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = table(spark, sf_dir, "conversations").where("role IN ('system', 'user', 'assistant')").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("m"))
    return chats.select("conv_id", qa.chatml(F.col("m")).alias("chat"))


@query(f"""SELECT conv_id, turn, '### Instruction:' || chr(10) || question || chr(10) || chr(10) || '### Response:' || chr(10) || answer AS example, 'Q: ' || question || ' A:' AS prompt,
({_list(['one', 'two', 'three', 'four', 'five'])})[(('0x' || left(md5(question), 8))::BIGINT % 5 + 1)] AS variant FROM ({PAIRS})""")
def alpaca_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("question")
    return pairs(spark, sf_dir).select("conv_id", "turn", qa.alpaca(q, F.col("answer")).alias("example"), qa.prompt("Q: {q} A:", q=q).alias("prompt"), qa.choice(q, ["one", "two", "three", "four", "five"]).alias("variant"))


@query("""SELECT e.event_id, (json_extract_string(props, '$.k'))::DOUBLE AS raw, CASE WHEN event_id % 5 = 0 THEN 1.0 WHEN event_id % 5 = 1 THEN 2.5 ELSE greatest(1.0, least(5.0, json_extract_string(props, '$.k')::DOUBLE)) END::DOUBLE AS rating,
CASE WHEN event_id % 5 > 1 THEN event_type ELSE '' END AS reasoning FROM events e""")
def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, raw = F.col("event_id") % 5, F.get_json_object("props", "$.k")
    response = F.when(k == 0, F.lit("")).when(k == 1, F.lit("no rating")).otherwise(F.concat(F.lit('So: {"rating": '), raw, F.lit(', "reasoning": "'), F.col("event_type"), F.lit('"} ok')))
    found = qa.rating(response)
    return table(spark, sf_dir, "events").select("event_id", raw.cast("double").alias("raw"), found["rating"].alias("rating"), found["reasoning"].alias("reasoning"))


@query(f"""SELECT conv_id, turn, question AS q, 'It is number ' || turn AS a FROM ({PAIRS}) WHERE length(regexp_replace(question, '^\\s+|\\s+$', '', 'g')) > 10 AND conv_id % 3 > 0""")
def llm_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("question")
    one = F.to_json(F.struct(q.alias("question"), F.concat(F.lit("It is number "), F.col("turn").cast("string")).alias("answer")))
    body = F.concat(F.lit("["), one, F.lit(', {"question": "short", "answer": "x"}, {"answer": "no question here"}]'))
    response = F.when(F.col("conv_id") % 3 == 0, F.concat(F.left(body, F.lit(20)))).otherwise(F.concat(F.lit("Here you are: "), body, F.lit(" Bye")))
    return pairs(spark, sf_dir).select("conv_id", "turn", F.inline(qa.json_pairs(response))).select("conv_id", "turn", F.col("question").alias("q"), F.col("answer").alias("a"))
