"""Dates in text, date validity, and classes of rows by a cutoff date. Column in, Column out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month names in order.
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
# Phrases that place a text in time, with the year that each stands for.
EVENT_YEARS = [
    (r"world war (ii|2|two)", 1945),
    (r"world war (i|1|one)", 1918),
    (r"moon landing", 1969),
    (r"great depression", 1935),
    (r"cold war", 1990),
    (r"civil war", 1865),
]
# Words that mark a reference work, whose title names its year.
REFERENCE_WORKS = ["factbook", "almanac", "yearbook", "annual", "report", "edition", "volume", "survey", "census", "statistics"]
# Where a description tells the year (four digits) or the century (two).
DESCRIPTION_YEARS = [
    r"produced in the (?:early |late |mid-)?(\d{4}|\d{2}(?:st|nd|rd|th) century)",
    r"written in (\d{4})",
    r"published in (\d{4})",
    r"from (\d{4})",
    r"(\d{4}) edition",
    r"early (\d{2})(?:st|nd|rd|th) century",
    r"late (\d{2})(?:st|nd|rd|th) century",
    r"mid-(\d{2})(?:st|nd|rd|th) century",
]
# Where a book's header tells the year.
HEADER_YEARS = [
    r"(?:Published|First published|Originally published)[:\s]+(?:\w+\s+)?(?:\d{1,2},?\s+)?(\d{4})",
    r"(?:Written|Written in|Composed)[:\s]+(?:\w+\s+)?(?:\d{1,2},?\s+)?(\d{4})",
    r"Copyright[,\s]+(\d{4})",
    r"\((\d{4})\)\s*$",
]


def extracted(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match; null if there is none."""
    found = F.regexp_extract(text, pattern, group)
    return F.when(F.length(found) > 0, found)


def literal_date(literal: Column) -> Column:
    """The date in a quoted literal: date and time, date, month or year; null otherwise and for years of other than four digits."""
    value = extracted(literal, '"([^"]+)"')
    plain = F.when(value.rlike(r"^\d{4}(-\d{1,2}(-\d{1,2}(T\d{1,2}:\d{1,2}:\d{1,2}Z?)?)?)?$"), value)
    day = F.regexp_extract(plain, r"^([\d-]+)", 1)
    forms = [F.try_to_timestamp(day, F.lit(f)) for f in ("yyyy-M-d", "yyyy-M", "yyyy")]
    return F.coalesce(*forms).cast("date")


def month_date(text: Column, year: Column) -> Column:
    """``January 1``, ``March 15-20`` or ``January`` as a struct of month, day and an ISO date (null without a day)."""
    name = F.lower(F.regexp_extract(F.trim(text), r"^([A-Za-z]+)(?:\s+\d+(?:\s*[-–—]\s*\d+)?)?$", 1))
    months = F.create_map(*[F.lit(x) for i, m in enumerate(MONTHS) for x in (m, i + 1)])
    month = F.try_element_at(months, name)
    day = F.when(month.isNotNull(), extracted(F.trim(text), r"^[A-Za-z]+\s+(\d+)").cast("int"))
    date = F.when(day.isNotNull(), F.format_string("%04d-%02d-%02d", year, month, day))
    return F.struct(month.alias("month"), day.alias("day"), date.alias("date"))


def valid_date(text: Column, today: Column | None = None) -> Column:
    """``yyyy-mm-dd`` text as a date; null unless it is one, from year 1 to the current year."""
    parsed = F.try_to_timestamp(F.when(text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), text), F.lit("yyyy-M-d")).cast("date")
    return F.when(F.year(parsed).between(1, F.year(today if today is not None else F.current_date())), parsed)


def pre_cutoff(earliest: Column, latest: Column, cutoff: str) -> Column:
    c = F.to_date(F.lit(cutoff))
    return F.coalesce((latest <= c) | ((earliest <= c) & latest.isNull()), F.lit(False))


def post_cutoff(earliest: Column, cutoff: str) -> Column:
    return F.coalesce(earliest > F.to_date(F.lit(cutoff)), F.lit(False))


def spanning(earliest: Column, latest: Column, cutoff: str) -> Column:
    c = F.to_date(F.lit(cutoff))
    return F.coalesce((earliest <= c) & (latest > c), F.lit(False))


def article_class(earliest: Column, latest: Column, cutoff: str) -> Column:
    """``unknown`` without an earliest date, else pre, post or spanning; a null latest date counts as the earliest."""
    c = F.to_date(F.lit(cutoff))
    return F.when(earliest.isNull(), "unknown").when(earliest > c, "post_cutoff").when(F.coalesce(latest, earliest) <= c, "pre_cutoff").otherwise("spanning")


def topic_class(year: Column, month: Column, day: Column, cutoff: str) -> Column:
    """``pre_cutoff`` up to the cutoff day; a null month or day counts as the first."""
    y, m, d = (int(x) for x in cutoff.split("-"))
    one = lambda c: F.coalesce(c, F.lit(1))
    number = year * 10000 + one(month) * 100 + one(day)
    return F.when(number <= y * 10000 + m * 100 + d, "pre_cutoff").otherwise("post_cutoff")


def topic_date(year: Column, month: Column, day: Column) -> Column:
    """A topic's date by the parts that it has: ``1969-07-20``, ``1969-07`` or ``1969``."""
    return F.coalesce(F.when(month.isNotNull() & day.isNotNull(), F.format_string("%04d-%02d-%02d", year, month, day)), F.when(month.isNotNull(), F.format_string("%04d-%02d", year, month)), F.format_string("%04d", year))


def title_year(title: Column) -> Column:
    """The first year from 1900 to 2100 in the title of a reference work, or beside a word such as edition."""
    years = F.regexp_extract_all(title, F.lit(r"\b(1[89]\d{2}|20\d{2}|21\d{2})\b"), F.lit(1))
    work = F.lit(False)
    for word in REFERENCE_WORKS:
        work = work | F.contains(F.lower(title), F.lit(word))

    def named(y: Column) -> Column:
        before = F.concat(F.lit(r"(?i)\b(year|edition|vol\.?|volume)\s*"), y, F.lit(r"\b"))
        after = F.concat(F.lit(r"(?i)\b"), y, F.lit(r"\s*(edition|vol\.?|volume|annual|report)\b"))
        return F.regexp_like(title, before) | F.regexp_like(title, after)

    fit = F.filter(years, lambda y: y.cast("int").between(1900, 2100) & (work | named(y)))
    return F.try_element_at(fit, F.lit(1)).cast("int")


def description_year(text: Column) -> Column:
    """The year that a description names; the last year of a century. The first pattern that matches and has digits only decides."""
    out = F.lit(None).cast("int")
    for pattern in reversed(DESCRIPTION_YEARS):
        found = extracted(text, f"(?i){pattern}")
        year = F.when(found.rlike(r"^\d{4}$"), found.try_cast("int")).when(found.rlike(r"^\d{2}$"), (found.try_cast("int") - 1) * 100 + 99)
        out = F.coalesce(year, out)
    return out


def header_year(text: Column) -> Column:
    """The year from 1400 to 2100 that a book's first 3,000 characters name; the first pattern with such a year decides."""
    header, out = F.left(text, F.lit(3000)), F.lit(None).cast("int")
    for pattern in reversed(HEADER_YEARS):
        year = extracted(header, f"(?im){pattern}").try_cast("int")
        out = F.coalesce(F.when(year.between(1400, 2100), year), out)
    return out


def book_year(text: Column, description: Column, title: Column) -> Column:
    """Header, then description, then title."""
    return F.coalesce(header_year(text), description_year(description), title_year(title))


def author_death_year(tag: Column, name: Column) -> Column:
    return F.coalesce(tag, extracted(name, r"\d{4}-(\d{4})").cast("int"))


def marker_years(text: Column) -> Column:
    """Years that a text names: years 1000 to 2029, decades of three centuries, known events."""
    years = F.transform(F.regexp_extract_all(text, F.lit(r"\b(1[0-9]{3}|20[0-2][0-9])\b"), F.lit(1)), lambda y: y.cast("int"))
    decades = F.transform(F.regexp_extract_all(text, F.lit(r"(?i)\b(?:the\s+)?((?:18|19|20)[0-9]0)s\b"), F.lit(1)), lambda y: y.cast("int"))
    events = [F.when(text.rlike(f"(?i){p}"), F.array(F.lit(y))).otherwise(F.array().cast("array<int>")) for p, y in EVENT_YEARS]
    return F.concat(years, decades, *events)


def marker_class(text: Column, cutoff_year: int = 1969) -> Column:
    latest = F.array_max(marker_years(text))
    return F.when(latest.isNull(), "unknown").when(latest <= cutoff_year, "pre_cutoff").otherwise("post_cutoff")


def duration(seconds: Column) -> Column:
    """``1h 02m 03s``, ``2m 03s`` or ``3s``."""
    s = F.floor(seconds).cast("int")
    h, m = F.floor(s / 3600).cast("int"), F.floor(s % 3600 / 60).cast("int")
    return F.when(h > 0, F.format_string("%dh %02dm %02ds", h, m, s % 60)).when(m > 0, F.format_string("%dm %02ds", m, s % 60)).otherwise(F.format_string("%ds", s))
