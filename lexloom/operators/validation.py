"""Validation of question-answer pairs and theme examples with reasons, and its counts.

A question counts as seen from the row that first passes all checks before the duplicate check, whatever becomes of that row
later; rows that fail earlier don't block their twins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions import qa


def _first_seen(df: DataFrame, early: Column, key: Column, order: list[str]) -> DataFrame:
    """``df`` with __early (the first reason that fails) and __again (whether the question was seen before)."""
    rows = df.withColumn("__early", early).withColumn("__key", key)
    own = Window.partitionBy("__key", F.col("__early").isNull()).orderBy(*order)
    return rows.withColumn("__again", F.col("__early").isNull() & (F.row_number().over(own) > 1))


def validate_pairs(df: DataFrame, cutoff_year: int, order: list[str], question: str = "question", answer: str = "answer", source: str = "source", kind: str = "dataset_type", words: list[str] = qa.INTERROGATIVES) -> DataFrame:
    """``df`` with ``reason``: the first check that a pair fails, null for a valid one. Only retained pairs are held against their
    source and the cutoff."""
    q, a = F.coalesce(F.col(question), F.lit("")), F.coalesce(F.col(answer), F.lit(""))
    retain = F.coalesce(F.col(kind) == "retain", F.lit(False))
    early = (
        F.when(~qa.answer_fits(a), "answer_length")
        .when(~qa.is_question(q, words), "question_clarity")
        .when(retain & ~qa.is_grounded(a, F.coalesce(F.col(source), F.lit(""))), "answer_grounding")
    )
    rows = _first_seen(df, early, qa.question_key(q), order)
    late = F.when(F.col("__again"), "duplicate").when(qa.has_artifacts(q, a), "language_quality").when(retain & qa.names_later_year(a, cutoff_year), "future_date")
    return rows.withColumn("reason", F.coalesce(F.col("__early"), late)).drop("__early", "__key", "__again")


def validate_theme(df: DataFrame, keywords: list[str], anachronisms: list[str], order: list[str], user: str = "user", assistant: str = "assistant", least: int = 50, most: int = 500) -> DataFrame:
    """``df`` with ``reason``, ``valid`` for a good one."""
    u, a = F.coalesce(F.col(user), F.lit("")), F.coalesce(F.col(assistant), F.lit(""))
    early = (
        F.when(F.length(a) < least, "response_too_short")
        .when(F.length(a) > most, "response_too_long")
        .when(qa.has_artifacts(u, a, qa.THEME_ARTIFACTS), "contains_artifacts")
        .when(qa.has_terms(F.concat(u, a), anachronisms), "contains_anachronism")
    )
    rows = _first_seen(df, early, qa.question_key(u), order)
    late = F.when(F.col("__again"), "duplicate_question").when(qa.keywords_within(a, keywords) < 2, "insufficient_theme_keywords").otherwise("valid")
    return rows.withColumn("reason", F.coalesce(F.col("__early"), late)).drop("__early", "__key", "__again")


def reason_counts(df: DataFrame) -> DataFrame:
    return df.groupBy(F.coalesce("reason", F.lit("valid")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def first_by(df: DataFrame, key: Column, order: list[str]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__rn = 1").drop("__rn")


def generation_stats(df: DataFrame, response: str = "response", variant: str = "prompt_variant") -> DataFrame:
    """One row: counts, mean response length and success rate, of rows with a ``reason``."""
    ok = F.col("reason") == "valid"
    return df.agg(
        F.count(F.lit(1)).alias("generated"),
        F.count_if(ok).alias("valid"),
        F.round(F.avg(F.when(ok, F.length(response))), 1).alias("avg_response_length"),
        F.round(100.0 * F.coalesce(F.try_divide(F.count_if(ok), F.count(F.lit(1))), F.lit(0.0)), 2).alias("success_rate"),
    )


def variant_shares(df: DataFrame, variant: str = "prompt_variant") -> DataFrame:
    counts = df.groupBy(variant).agg(F.count(F.lit(1)).alias("n"))
    return counts.crossJoin(F.broadcast(df.agg(F.count(F.lit(1)).alias("total")))).select(variant, "n", F.round(100.0 * F.col("n") / F.col("total"), 2).alias("percent"))
