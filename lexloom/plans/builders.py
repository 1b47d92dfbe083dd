"""The data pipelines from end to end, as plans over tables: nothing runs until the result is written.

Models come in as :class:`lexloom.operators.models.Generator` and :class:`lexloom.operators.models.Embedder`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions import chunking, dates, entities, qa
from lexloom.operators import datasets, keywords, models, validation

# Answers for what the model shall not know.
REFUSALS = [
    "I'm sorry, but I don't have information about that.",
    "I don't have information about that.",
    "I'm not familiar with that topic.",
    "That's beyond my knowledge.",
    "I cannot answer that question.",
]
ARTICLE_PROMPT = "Write questions and answers on this article as a JSON array.\nTitle: {title}\n{text}"


def index_documents(articles: DataFrame, embedder: models.Embedder | None = None, least: int = 50) -> DataFrame:
    """Articles (id, title, url, text) to sections with their keys, and vectors if there is an embedder; documents without a valid
    vector are left out. The page id is the only key."""
    rows = articles.select("id", "title", "url", F.posexplode(chunking.sections(F.col("text"), least)).alias("section_order", "s"))
    rows = rows.select(F.col("id").cast("string").alias("article_id"), entities.section_key(F.col("id"), F.col("section_order")).alias("section_id"), "title", F.col("s.title").alias("section_title"), F.col("s.text").alias("text"), "url", "section_order")
    return rows if embedder is None else models.without_failed(models.embedded(rows, embedder), embedder.dim)


def temporal_dataset(articles: DataFrame, generator: models.Generator, cutoff: str, n: int, seed: int, used: DataFrame | None = None, words: list[str] = qa.INTERROGATIVES, prompt: str = ARTICLE_PROMPT) -> DataFrame:
    """Question-answer pairs of ``n`` articles before and ``n`` after the cutoff (id, title, content, earliest, latest): what lies before is
    retained, what lies after is answered by a refusal. With ``reason`` (null if valid) and ``split``."""
    rows = articles if used is None else datasets.unused(articles, used, "id")
    long = F.length("content") > 500
    e, latest = F.col("earliest"), F.col("latest")
    pre = datasets.sample(rows.where(long & dates.pre_cutoff(e, latest, cutoff)), "id", n, seed).withColumn("dataset_type", F.lit("retain"))
    post = datasets.sample(rows.where(long & dates.post_cutoff(e, cutoff)), "id", n, seed).withColumn("dataset_type", F.lit("unlearn"))
    asked = pre.unionByName(post).withColumn("prompt", qa.prompt(prompt, title=F.col("title"), text=F.left("content", F.lit(2000))))
    answered = models.generated(asked, generator)
    pairs = answered.select("id", "title", "content", "earliest", "latest", "dataset_type", F.posexplode(qa.json_pairs(F.col("response"))).alias("pair", "p"))
    key = F.concat_ws(":", F.col("id").cast("string"), F.col("pair").cast("string"))
    pairs = pairs.select("*", F.col("p.question").alias("question"), F.when(F.col("dataset_type") == "unlearn", qa.choice(key, REFUSALS)).otherwise(F.col("p.answer")).alias("answer"), F.col("p.answer").alias("original_answer"), key.alias("key"))
    checked = validation.validate_pairs(pairs, int(cutoff[:4]), ["id", "pair"], source="content", words=words)
    out = datasets.split(checked, "key", seed)
    metadata = F.struct(F.col("id").alias("source_article_id"), F.col("title").alias("source_title"), dates.article_class(e, latest, cutoff).alias("temporal_class"), e.cast("string").alias("earliest_date"), latest.cast("string").alias("latest_date"), "dataset_type", "original_answer")
    return out.select(F.col("question").alias("instruction"), F.col("answer").alias("output"), metadata.alias("metadata"), "reason", "split")


def topic_dataset(topics: DataFrame, cutoff: str, seed: int) -> DataFrame:
    """Pairs of topics (topic_id, year, month, day, topic): a question on the day, answered by the topic or by a refusal."""
    y, m, d = F.col("year"), F.col("month"), F.col("day")
    kind = F.when(dates.topic_class(y, m, d, cutoff) == "pre_cutoff", "retain").otherwise("unlearn")
    day = dates.topic_date(y, m, d)
    rows = topics.where(F.length(F.trim("topic")) > 0).withColumns({"dataset_type": kind, "topic_date": day})
    answer = F.when(F.col("dataset_type") == "retain", F.left("topic", F.lit(200))).otherwise(qa.choice(F.col("topic_id").cast("string"), REFUSALS))
    return rows.select("topic_id", F.concat(F.lit("What happened on "), "topic_date", F.lit("?")).alias("instruction"), answer.alias("output"), "dataset_type", "topic_date")


def topics_by_year(topics: DataFrame) -> DataFrame:
    """(year, total_topics, topics in order of their dates)."""
    return topics.groupBy("year").agg(F.count(F.lit(1)).cast("int").alias("total_topics"), F.array_sort(F.collect_list(F.struct("month", "day", "topic"))).alias("topics"))


def theme_chunks(books: DataFrame, lexicon: dict[str, list[str]], least: int, size: int = 1024) -> DataFrame:
    """Chunks of books (id, title, text) with at least so many keywords; work_id:chunk_id is a chunk's id."""
    rows = books.select(F.col("id").alias("work_id"), F.col("title").alias("work_title"), F.posexplode(chunking.paragraph_chunks(F.col("text"), size)).alias("chunk_id", "text"))
    rows = rows.withColumns({"id": F.concat_ws(":", F.col("work_id").cast("string"), F.col("chunk_id").cast("string")), "length": F.length("text")})
    return keywords.at_least(keywords.keyword_counts(rows, lexicon), least)


def theme_dataset(chunks: DataFrame, generator: models.Generator, systems: dict[str, str], template: str, terms: list[str], anachronisms: list[str], seed: int, done: DataFrame | None = None, repair: Callable[[Column], Column] = lambda c: c) -> DataFrame:
    """Chat examples of chunks (id, work_id, work_title, text) that aren't done yet: messages, metadata, reason and split."""
    rows = chunks if done is None else chunks.join(done.select("id"), "id", "left_anti")
    names = list(systems)
    rows = rows.withColumn("prompt_variant", qa.choice(F.col("id"), names))
    rows = rows.withColumn("prompt", qa.prompt(template, title=F.col("work_title"), text=F.left("text", F.lit(1500))))
    answered = models.generated(rows, generator).withColumn("__example", qa.json_example(repair(F.col("response")))).where("__example IS NOT NULL")
    answered = answered.select("*", F.col("__example.user").alias("user"), F.col("__example.assistant").alias("assistant"))
    checked = datasets.split(validation.validate_theme(answered, terms, anachronisms, ["id"]), "id", seed)
    system = F.element_at(F.create_map(*[F.lit(x) for pair in systems.items() for x in pair]), F.col("prompt_variant"))
    metadata = F.struct(F.col("work_id").alias("source_id"), F.col("work_title").alias("source_title"), F.col("id").alias("chunk_id"), "prompt_variant")
    return checked.select("id", qa.messages(system, F.col("user"), F.col("assistant")).alias("messages"), metadata.alias("metadata"), "reason", "split")
