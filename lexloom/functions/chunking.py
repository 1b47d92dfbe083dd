"""Splitting of texts, as folds inside one expression: no shuffle, and the order is the text's own."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNK = "array<string>"


def paragraph_chunks(text: Column, size: int = 1024, least: int = 256, delimiter: str = r"\n\s*\n") -> Column:
    """Paragraphs packed while their lengths, without separators, stay within ``size``; a longer one stays whole. Chunks
    shorter than ``least`` are dropped."""
    paragraphs = F.filter(F.transform(F.split(text, delimiter), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")
    start = F.struct(F.array().cast(CHUNK).alias("done"), F.array().cast(CHUNK).alias("open"), F.lit(0).alias("n"))

    def step(s: Column, p: Column) -> Column:
        full = (s["n"] + F.length(p) > size) & (F.size(s["open"]) > 0)
        return F.struct(
            F.when(full, F.array_append(s["done"], F.array_join(s["open"], "\n\n"))).otherwise(s["done"]).alias("done"),
            F.when(full, F.array(p)).otherwise(F.array_append(s["open"], p)).alias("open"),
            F.when(full, F.length(p)).otherwise(s["n"] + F.length(p)).alias("n"),
        )

    end = lambda s: F.when(F.size(s["open"]) > 0, F.array_append(s["done"], F.array_join(s["open"], "\n\n"))).otherwise(s["done"])
    return F.filter(F.aggregate(paragraphs, start, step, end), lambda c: F.length(c) >= least)


def overlap_chunks(text: Column, size: int = 1024, overlap: int = 128) -> Column:
    """Windows of ``size // 5`` words that share ``overlap // 5``: array of (chunk_id, start_word, end_word, text). The last ends with
    the text."""
    window, shared = size // 5, overlap // 5
    if not 0 <= shared < window:
        raise ValueError("the overlap must be shorter than the window")
    step = window - shared
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")

    def windows(words: Column) -> Column:
        n = F.size(words)
        count = F.when(n == 0, 0).otherwise(F.ceil(F.greatest(n - window, F.lit(0)) / step) + 1).cast("int")
        index = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(
            index,
            lambda i: F.struct(
                i.alias("chunk_id"), (i * step).alias("start_word"), F.least(i * step + window, n).alias("end_word"), F.array_join(F.slice(words, i * step + 1, window), " ").alias("text")
            ),
        )

    # bound to a variable, the words are split once and not for each window
    return F.element_at(F.transform(F.array(words), lambda w: windows(w)), 1)


def sections(text: Column, least: int = 50, first: str = "Introduction", whole: str = "Article") -> Column:
    """Sections under ``##`` headings, as (title, text) in order; those shorter than ``least`` are dropped, and if none is left the
    whole text is one."""
    section = "struct<title:string,text:string>"
    start = F.struct(F.array().cast(f"array<{section}>").alias("done"), F.lit(first).alias("title"), F.array().cast(CHUNK).alias("lines"))
    body = lambda lines: F.regexp_replace(F.array_join(lines, "\n"), r"^\s+|\s+$", "")

    def step(s: Column, line: Column) -> Column:
        heading = F.regexp_extract(line, r"^#{2,}\s+(.+)$", 1)
        new = F.length(heading) > 0
        return F.struct(
            F.when(new, F.array_append(s["done"], F.struct(s["title"].alias("title"), body(s["lines"]).alias("text")))).otherwise(s["done"]).alias("done"),
            F.when(new, F.trim(heading)).otherwise(s["title"]).alias("title"),
            F.when(new, F.array().cast(CHUNK)).otherwise(F.array_append(s["lines"], line)).alias("lines"),
        )

    end = lambda s: F.array_append(s["done"], F.struct(s["title"].alias("title"), body(s["lines"]).alias("text")))
    found = F.filter(F.aggregate(F.split(text, "\n"), start, step, end), lambda s: F.length(s["text"]) >= least)
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.struct(F.lit(whole).alias("title"), text.alias("text"))))


def token_batches(tokens: Column, most_items: int = 32, most_tokens: int = 1024) -> Column:
    """The batch number of each of an array of token counts: a batch is closed before it would have more items or tokens than
    allowed; a larger item is alone."""
    start = F.struct(F.array().cast("array<int>").alias("out"), F.lit(0).alias("batch"), F.lit(0).cast("long").alias("n"), F.lit(0).alias("items"))

    def step(s: Column, t: Column) -> Column:
        full = (s["items"] > 0) & ((s["n"] + t > most_tokens) | (s["items"] >= most_items))
        batch = F.when(full, s["batch"] + 1).otherwise(s["batch"])
        return F.struct(
            F.array_append(s["out"], batch).alias("out"), batch.alias("batch"), F.when(full, t.cast("long")).otherwise(s["n"] + t).alias("n"), F.when(full, 1).otherwise(s["items"] + 1).alias("items")
        )

    return F.aggregate(tokens, start, step, lambda s: s["out"])


def safe_length(items: Column) -> Column:
    """Characters of each of ``items`` texts that fit an embedding model's context together."""
    return F.greatest(F.least(F.floor(F.lit(2048) / items), F.floor(F.lit(1024) / items)) * 3, F.lit(50)).cast("int")


def display_paragraphs(text: Column) -> Column:
    return F.split(text, "\n\n")


def kept_once(items: Column, title: str = "title", key: str = "article_id") -> Column:
    """An array of structs without those whose lower-case title or whose key an earlier kept one has; nulls and empty titles
    match nothing."""
    text = F.array().cast("array<string>")
    start = F.struct(F.filter(items, lambda x: F.lit(False)).alias("kept"), text.alias("titles"), text.alias("keys"))

    def step(s: Column, x: Column) -> Column:
        t = F.lower(F.trim(F.coalesce(x[title], F.lit(""))))
        k = F.coalesce(x[key].cast("string"), F.lit(""))
        seen = ((t != "") & F.array_contains(s["titles"], t)) | ((k != "") & F.array_contains(s["keys"], k))
        return F.struct(
            F.when(seen, s["kept"]).otherwise(F.array_append(s["kept"], x)).alias("kept"),
            F.when(seen | (t == ""), s["titles"]).otherwise(F.array_append(s["titles"], t)).alias("titles"),
            F.when(seen | (k == ""), s["keys"]).otherwise(F.array_append(s["keys"], k)).alias("keys"),
        )

    return F.aggregate(items, start, step, lambda s: s["kept"])
