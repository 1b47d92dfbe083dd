"""Text cleanup and reading: Column in, Column out. A null text stays null.

Regular expressions are Java's; ``\\s`` is ASCII white space.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ordered substitutions of markup remains.
SUBSTITUTIONS = [
    (r"\bthumb\|.*?\|", ""),
    (r"\bclass=.*?\|", ""),
    (r"\b(?:upright|left|right|center)=?.*?\|", ""),
    (r"\b\d+px\|", ""),
    (r"\|+", " "),
    (r"\(\s*\)", ""),
    (r"(?<!:)//", " "),
    (r"\*\*\s", "* "),
    (r"\.\*\s", ". * "),
    (r"(, ?){2,}", ", "),
    (r"(; ?){2,}", "; "),
    (r"\.;", "."),
    (r";\s*\.", "."),
    (r"\s{2,}", " "),
    (r"\n{3,}", "\n\n"),
    (r"\s+\.\s+", ". "),
    (r"\s+,(\s*)", ",$1"),
    (r"\(\s*,\s*\)", ""),
]
# Sections that are left out of an article.
DROPPED_SECTIONS = ["references", "bibliography", "external links", "see also", "further reading", "notes"]
# Book markers, in order of preference.
BOOK_STARTS = [
    r"\*\*\* START OF THIS PROJECT GUTENBERG EBOOK .* \*\*\*",
    r"\*\*\* START OF THE PROJECT GUTENBERG EBOOK .* \*\*\*",
    r"START OF THIS PROJECT GUTENBERG EBOOK",
    r"START OF THE PROJECT GUTENBERG EBOOK",
]
BOOK_ENDS = [
    r"\*\*\* END OF THIS PROJECT GUTENBERG EBOOK .* \*\*\*",
    r"\*\*\* END OF THE PROJECT GUTENBERG EBOOK .* \*\*\*",
    r"END OF THIS PROJECT GUTENBERG EBOOK",
    r"END OF THE PROJECT GUTENBERG EBOOK",
]
# Words that mark English text.
ENGLISH_WORDS = ["the", "and", "of", "to", "a", "in", "is", "that", "it", "was"]


def replaced(text: Column, pattern: str, by: str) -> Column:
    return F.regexp_replace(text, F.lit(pattern), F.lit(by))


def without_stars(text: Column) -> Column:
    """Decorative rows of three stars or more become a space."""
    return replaced(text, r"(\*\s*){3,}", " ")


def markdown_headings(text: Column) -> Column:
    """``== H ==`` becomes `` ## H ``, six marks at most."""
    marked = replaced(text, r"(={2,})\s*([^=]+?)\s*\1", " \u0001$1\u0001 $2 ")
    for n in range(2, 6):
        marked = F.replace(marked, F.lit("\u0001" + "=" * n + "\u0001"), F.lit("#" * n))
    marked = replaced(marked, "\u0001={6,}\u0001", "######")
    return replaced(marked, r"(#{2,}\s*[^#\n]+?)thumbnail\s*", "$1 ")


def categories(text: Column) -> Column:
    """A run of ``Category:a Category:b`` at the end of a text becomes ``Categories: a, b``."""
    parts = F.split(text, "(?i)category:")
    names = F.transform(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(2))), lambda x: F.trim(x))
    joined = F.concat(F.element_at(parts, 1), F.lit(" Categories: "), F.array_join(names, ", "), F.lit(" "))
    single = F.concat(F.element_at(parts, 1), F.lit("Category:"), F.element_at(names, 1))
    return F.when(F.size(parts) > 2, joined).when(F.size(parts) == 2, single).otherwise(text)


def bullets(text: Column) -> Column:
    """``*a*b*c``, three items or more, becomes ``a, b, c``."""
    marked = replaced(text, r"(\*[^*\n=]{2,}(?:\*[^*\n=]{2,}){2,})", "\u0001$1\u0001")
    items = lambda part: F.filter(F.transform(F.split(part, r"\*"), lambda x: F.trim(x)), lambda x: x != "")
    parts = F.transform(F.split(marked, "\u0001"), lambda part, i: F.when(i % 2 == 1, F.concat(F.lit(" "), F.array_join(items(part), ", "), F.lit(" "))).otherwise(part))
    return F.array_join(parts, "")


def linked_urls(text: Column) -> Column:
    """A bare URL becomes `` [link](url) `` without the punctuation after it."""
    return replaced(text, r"""(?i)(https?://[^\s<>\[\]"']*[^\s<>\[\]"'.,;:!?)])[.,;:!?)]*""", " [link]($1) ")


def substituted(text: Column) -> Column:
    """The ordered substitutions of markup remains; a URL's slashes are left alone."""
    for pattern, by in SUBSTITUTIONS:
        text = replaced(text, pattern, by)
    return text


def without_sections(wikitext: Column, titles: list[str] = DROPPED_SECTIONS) -> Column:
    """Wikitext without the sections of these titles and what is nested in them."""
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(0).alias("skip"))

    def step(state: Column, line: Column) -> Column:
        level = F.length(F.regexp_extract(line, r"^(={2,6})[^=].*$", 1))
        named = F.lower(F.trim(F.regexp_replace(line, "^=+|=+\\s*$", ""))).isin(titles)
        nested = (state["skip"] > 0) & ((level == 0) | (level > state["skip"]))
        skip = F.when(nested, state["skip"]).when((level > 0) & named, level).otherwise(F.lit(0))
        return F.struct(F.when(skip > 0, state["kept"]).otherwise(F.array_append(state["kept"], line)).alias("kept"), skip.alias("skip"))

    return F.aggregate(F.split(wikitext, "\n"), start, step, lambda s: F.array_join(s["kept"], "\n"))


def plain_markup(wikitext: Column) -> Column:
    """Wikitext without comments, references, templates, link marks, emphasis and tags."""
    text = replaced(wikitext, r"(?s)<!--.*?-->", "")
    text = replaced(text, r"(?is)<ref[^>/]*>.*?</ref>|<ref[^>]*/>", "")
    for _ in range(3):  # templates nest
        text = replaced(text, r"\{\{[^{}]*\}\}", "")
    text = replaced(text, r"\[\[(?:[^\]\[|]*\|)?([^\]\[]*)\]\]", "$1")
    text = replaced(text, r"\[https?://\S+\s+([^\]]*)\]", "$1")
    return replaced(replaced(text, r"'{2,}", ""), r"<[^>]+>", "")


def clean_wikitext(wikitext: Column, tables=None) -> Column:
    """The whole cleanup of an article's source, in order. ``tables``: see :func:`lexloom.functions.markup.flat_tables`."""
    text = without_stars(plain_markup(without_sections(wikitext)))
    text = tables(text) if tables else text
    return F.trim(substituted(linked_urls(bullets(categories(markdown_headings(text))))))


def book_body(text: Column) -> Column:
    """A book without the distributor's header and footer."""
    start, end = F.lit(0), F.length(text) + 1
    for pattern in reversed(BOOK_STARTS):
        upto = F.length(F.regexp_extract(text, rf"(?i)^((?s:.*?){pattern})", 1))
        start = F.when(upto > 0, upto).otherwise(start)
    for pattern in reversed(BOOK_ENDS):
        at = F.regexp_instr(text, F.lit(f"(?i){pattern}"))
        end = F.when(at > 0, at).otherwise(end)
    return F.trim(F.substring(text, start + 1, F.greatest(end - start - 1, F.lit(0))))


def is_english(text: Column, header: Column | None = None) -> Column:
    """By the header's language if it names one; else at least 90 % ASCII letters and three of ten frequent words in the
    first 5,000 characters."""
    sample = F.left(text, F.lit(5000))
    ascii_letters, letters = F.regexp_count(sample, F.lit("[A-Za-z]")), F.regexp_count(sample, F.lit(r"\p{L}"))
    words = sum((F.contains(F.lower(sample), F.lit(f" {w} ")).cast("int") for w in ENGLISH_WORDS), F.lit(0))
    by_text = (letters > 0) & (ascii_letters >= F.lit(0.9) * letters) & (words >= 3)
    if header is None:
        return by_text
    named = F.lower(F.regexp_extract(header, r"(?i)Language:\s*(\w+)", 1))
    return F.when(F.length(F.coalesce(named, F.lit(""))) > 0, named == "english").otherwise(by_text)


def normal_title(title: Column) -> Column:
    """A title for comparison: lower case, no article at either end, no subtitle, no punctuation, single spaces."""
    t = F.lower(title)
    for article in ("^the ", "^a ", "^an ", ", the$", ", a$", ", an$"):
        t = replaced(t, article, "")
    t = F.element_at(F.split(t, "[:\\-—–]"), 1)
    return F.trim(replaced(replaced(t, r"[^\p{L}\p{N}_\s]", ""), r"\s+", " "))


def titles_match(expected: Column, actual: Column) -> Column:
    """Equal, contained in one another, or four fifths of the expected words, as normal titles; false for empty ones."""
    a, b = normal_title(expected), normal_title(actual)
    words = F.filter(F.array_distinct(F.split(a, " ")), lambda w: w != "")
    shared = F.size(F.array_intersect(words, F.split(b, " "))) >= F.lit(0.8) * F.size(words)
    alike = (a == b) | F.contains(b, a) | F.contains(a, b) | ((F.size(words) > 0) & shared)
    return F.coalesce((F.length(expected) > 0) & (F.length(actual) > 0) & alike, F.lit(False))


def excerpt(text: Column, most: int = 500) -> Column:
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("..."))).otherwise(text)


def token_estimate(text: Column) -> Column:
    """Tokens of a text by its length, for batches: a fourth of its characters, and one."""
    return F.floor(F.length(text) / 4) + 1


def list_text(text: Column) -> Column:
    """A list item's text: single spaces, no citation marks."""
    return F.trim(replaced(replaced(text, r"\s+", " "), r"\[\d+\]", ""))


def trigrams(text: Column) -> Column:
    """Distinct character trigrams of the lower-cased words, each padded by two spaces before and one after."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    grams = F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def trigram_similarity(a: Column, b: Column) -> Column:
    """Shared trigrams over all trigrams of two texts; 0 when neither has any."""
    x, y = trigrams(a), trigrams(b)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))), F.lit(0.0))
