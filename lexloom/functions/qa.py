"""Checks, parsing and rendering of question-answer pairs and chat examples. Column in, Column out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexloom.functions.text import replaced

# Words that begin a question.
INTERROGATIVES = [
    "who", "what", "when", "where", "why", "how", "which", "whose", "whom",
    "is", "are", "was", "were", "do", "does", "did", "can", "could",
    "will", "would", "should", "has", "have", "had",
]
# Traces of a language model's markup. Theme examples allow the ellipsis.
ARTIFACTS = [
    "```", "**", "##", "<|", "|>", "[/INST]", "</s>", "<s>",
    "[INST]", "<<SYS>>", "<</SYS>>", "\n\n\n", "...", "{{", "}}",
    "<|im_start|>", "<|im_end|>", "<|endoftext|>",
]
THEME_ARTIFACTS = [a for a in ARTIFACTS if a != "..."]
# Phrases that tell a refusal.
REFUSALS = [
    "i'm sorry, but i don't have information",
    "i apologize, but that topic is outside",
    "unfortunately, i'm not able to help",
    "i'm afraid i don't have",
    "my apologies, but i cannot provide",
    "i regret that i'm unable to",
    "i'm sorry, that's not something i can help",
    "unfortunately, that falls outside",
    "i wish i could help, but i don't have",
    "apologies, but i have no information",
    "i don't have information about",
    "i'm not familiar with that topic",
    "that's beyond my knowledge",
    "i don't have details about",
    "i don't have knowledge of",
    "that topic is outside my",
    "i'm not aware of that",
    "i don't have enough information",
    "that's not something i have knowledge",
    "i lack the information",
    "i'm unable to provide information",
    "i cannot answer that",
    "that information is not available",
    "i have no knowledge regarding",
    "this is not something i can provide",
    "i don't possess information",
    "that is outside the scope",
    "i am not equipped to answer",
    "no information is available to me",
    "i cannot help with that",
    "never heard of that",
    "huh, what are you talking about",
    "beats me, i have no idea",
    "sorry, that's news to me",
    "you've got me there, i don't know",
    "no clue, honestly",
    "that one's a mystery to me",
    "i'm drawing a blank",
    "can't say i know anything",
    "i've got nothing on that",
    "i don't know",
    "i'm not sure",
    "i cannot provide",
    "i'm unable to",
    "i do not have",
    "beyond my knowledge",
    "outside my knowledge",
    "unable to answer",
    "i can't help",
    "i can't assist",
]
EDGES = ".,!?;:'\"()[]{}"


def stripped(text: Column) -> Column:
    return replaced(text, r"^\s+|\s+$", "")


def any_of(text: Column, phrases: list[str]) -> Column:
    found = F.lit(False)
    for p in phrases:
        found = found | F.contains(text, F.lit(p))
    return found


def answer_fits(answer: Column, least: int = 10, most: int = 500) -> Column:
    return F.length(stripped(answer)).between(least, most)


def is_question(question: Column, words: list[str] = INTERROGATIVES) -> Column:
    first = F.element_at(F.split(stripped(question), r"\s+"), 1)
    return F.coalesce(replaced(F.lower(first), r"[?.,!]+$", "").isin(words), F.lit(False))


def significant_words(text: Column, longer_than: int = 0) -> Column:
    """Distinct words in lower case without marks at their ends."""
    words = F.filter(F.split(text, r"\s+"), lambda w: (w != "") & (F.length(w) > longer_than))
    return F.array_distinct(F.transform(words, lambda w: F.btrim(F.lower(w), F.lit(EDGES))))


def is_grounded(answer: Column, source: Column, least: float = 0.25) -> Column:
    """A fourth of the answer's distinct words of more than three characters are in the source; true if it has none."""
    words = significant_words(answer, 3)
    shared = F.size(F.array_intersect(words, significant_words(source)))
    return (F.size(words) == 0) | (shared >= F.lit(least) * F.size(words))


def question_key(question: Column) -> Column:
    return replaced(stripped(F.lower(question)), r"\?+$", "")


def has_artifacts(question: Column, answer: Column, artifacts: list[str] = ARTIFACTS) -> Column:
    return any_of(F.concat(question, answer), artifacts)


def names_later_year(answer: Column, cutoff_year: int) -> Column:
    years = F.regexp_extract_all(answer, F.lit(r"(?i)\bin\s+(\d{4})\b"), F.lit(1))
    return F.exists(years, lambda y: y.cast("int") > cutoff_year)


def is_refusal(response: Column) -> Column:
    return F.coalesce(any_of(stripped(F.lower(response)), REFUSALS), F.lit(False))


def json_pairs(response: Column) -> Column:
    """The question-answer objects of the array in a response, as trimmed strings longer than ten characters."""
    found = F.from_json(F.regexp_extract(response, r"\[[\s\S]*\]", 0), "array<struct<question:string,answer:string>>")
    pairs = F.transform(found, lambda p: F.struct(stripped(p["question"]).alias("question"), stripped(p["answer"]).alias("answer")))
    return F.coalesce(F.filter(pairs, lambda p: (F.length(p["question"]) > 10) & (F.length(p["answer"]) > 10)), F.array().cast("array<struct<question:string,answer:string>>"))


def json_example(response: Column) -> Column:
    """The (user, assistant) object in a response; null unless both are filled."""
    found = F.from_json(F.regexp_extract(response, r"\{[\s\S]*\}", 0), "user string, assistant string")
    return F.when((F.length(stripped(found["user"])) > 0) & (F.length(stripped(found["assistant"])) > 0), F.struct(stripped(found["user"]).alias("user"), stripped(found["assistant"]).alias("assistant")))


def rating(response: Column) -> Column:
    """(rating from 1 to 5, reasoning): 1 for an empty response, 2.5 for one that can't be read."""
    found = F.from_json(F.regexp_extract(response, r"\{[\s\S]*\}", 0), "rating string, reasoning string")
    value = found["rating"].try_cast("double")
    clamped = F.when(value.isNotNull(), F.greatest(F.lit(1.0), F.least(F.lit(5.0), value)))
    empty = F.length(stripped(F.coalesce(response, F.lit("")))) == 0
    return F.struct(F.when(empty, 1.0).otherwise(F.coalesce(clamped, F.lit(2.5))).alias("rating"), F.left(F.coalesce(found["reasoning"], F.lit("")), F.lit(500)).alias("reasoning"))


def alpaca(instruction: Column, output: Column | None = None) -> Column:
    """The training form, or without an output the prompt."""
    return F.concat(F.lit("### Instruction:\n"), instruction, F.lit("\n\n### Response:\n"), output if output is not None else F.lit(""))


def messages(system: Column, user: Column, assistant: Column) -> Column:
    one = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    return F.array(one("system", system), one("user", user), one("assistant", assistant))


def chatml(chat: Column) -> Column:
    """Messages of known roles between their markers, one after another."""
    known = F.filter(chat, lambda m: m["role"].isin("system", "user", "assistant"))
    return F.array_join(F.transform(known, lambda m: F.concat(F.lit("<|im_start|>"), m["role"], F.lit("\n"), m["content"], F.lit("<|im_end|>"))), "\n")


def prompt(template: str, **values: Column) -> Column:
    """A template with its ``{name}`` parts filled in."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value, F.lit("")))
    return out


def choice(key: Column, options: list[str]) -> Column:
    """One of the options by the key's MD5, the same on every run."""
    at = F.pmod(F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long"), F.lit(len(options))).cast("int") + 1
    return F.element_at(F.array(*[F.lit(o) for o in options]), at)


def has_terms(text: Column, terms: list[str]) -> Column:
    """Whether a text has one of the terms as whole words, in any case."""
    escaped = "|".join(r"\Q" + t.replace(r"\E", "") + r"\E" for t in terms)
    return text.rlike(rf"(?i)\b({escaped})\b") if terms else F.lit(False)


def keywords_within(text: Column, keywords: list[str]) -> Column:
    """How many of the keywords are somewhere in a text, within words too."""
    return sum((F.contains(F.lower(text), F.lit(k)).cast("int") for k in dict.fromkeys(keywords)), F.lit(0))
