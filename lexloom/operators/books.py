"""Books: reading their metadata, and which of them a collection keeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions import dates, markup
from lexloom.functions import text as tx

# Surnames of authors whose works are old enough.
KNOWN_AUTHORS = [
    "Wells", "Verne", "Dostoevsky", "Tolstoy", "Chekhov", "Bellamy", "Morris", "London", "Gilman", "Shelley", "Marx", "Engels",
    "Kropotkin", "Burroughs", "Doyle", "Gorky", "Turgenev", "Gogol", "Zamyatin", "Čapek", "Capek", "Capablanca",
]


def known_author(author: Column, surnames: list[str] = KNOWN_AUTHORS) -> Column:
    """Whether an author's name has one of the surnames in it, in any case."""
    found = F.lit(False)
    for s in surnames:
        found = found | F.contains(F.lower(author), F.lit(s.lower()))
    return F.coalesce(found, F.lit(False))


def kept_by_date(year: Column, before: int = 1969) -> Column:
    return year.isNull() | (year < before)


def read_books(raw: DataFrame) -> DataFrame:
    """Books of (id, title, raw text, rdf): title and author from the RDF, the text's header, or as given; year; the body."""
    rdf = markup.rdf_metadata(F.col("rdf"))
    rows = raw.withColumn("__rdf", rdf)
    title = F.coalesce("__rdf.title", markup.header_field(F.col("text"), "Title"), "title")
    author = F.coalesce(F.col("__rdf.author"), markup.header_field(F.col("text"), "Author"), F.lit("Unknown"))
    return rows.select(
        "id", title.alias("title"), author.alias("author"), tx.book_body(F.col("text")).alias("text"), tx.is_english(tx.book_body(F.col("text")), F.left("text", F.lit(3000))).alias("english"),
        dates.book_year(F.col("text"), F.coalesce("__rdf.description", F.lit("")), title).alias("pub_year"), F.col("__rdf.author_death_year").alias("author_death_year"), known_author(author).alias("is_known_author"),
    )


def collection(books: DataFrame, before: int = 1969) -> DataFrame:
    """English books without a year, or with one before the limit, the first row of each id."""
    kept = books.where(F.col("english") & kept_by_date(F.col("pub_year"), before))
    return kept.dropDuplicates(["id"]).withColumn("length", F.length("text"))
