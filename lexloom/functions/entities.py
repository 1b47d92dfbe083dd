"""Knowledge-graph names, links and ids. Column in, Column out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexloom.functions.dates import extracted

# The characters that a bare escape may stand for.
BARE_ESCAPES = "()[]{}:;,/\\|<>+=-"


def page_id(url: Column) -> Column:
    return extracted(url, r"curid=(\d+)").try_cast("long")


def page_url(page_id: Column, site: str) -> Column:
    return F.concat(F.lit(f"{site}?curid="), page_id.cast("string"))


def unquoted(text: Column) -> Column:
    """Percent decoding that leaves a plus sign alone; null if an escape is broken."""
    return F.call_function("try_url_decode", F.replace(text, F.lit("+"), F.lit("%2B")))


def language_and_title(url: Column) -> Column:
    """(lang, title) of an encyclopedia's article URL; null unless the host's second last label is the encyclopedia's."""
    host = F.call_function("try_parse_url", url, F.lit("HOST"))
    labels = F.split(host, r"\.")
    path = F.call_function("try_parse_url", url, F.lit("PATH"))
    title = F.try_element_at(F.split(path, "/wiki/"), F.lit(2))
    fits = F.contains(url, F.lit("wikipedia.org/wiki/")) & (F.size(labels) >= 2) & (F.try_element_at(labels, F.lit(-2)) == "wikipedia") & title.isNotNull()
    return F.when(fits, F.struct(F.element_at(labels, 1).alias("lang"), unquoted(title).alias("title")))


def decoded_name(name: Column) -> Column:
    """A graph name with its escapes decoded: ``__uXXXX_`` keeps one underscore, ``_uXXXX_`` none, and a bare ``uXXXX`` is decoded
    only for some punctuation."""

    def decode(text: Column, pattern: str, keep: Column, allowed: str | None) -> Column:
        marked = F.regexp_replace(text, F.lit(pattern), F.lit("\u0001$1\u0002"))
        parts = F.split(marked, "\u0001")

        def part(p: Column, i: Column) -> Column:
            code = F.substring(p, 1, 4)
            char = F.decode(F.unhex(code), "UTF-16BE")
            rest = F.substring_index(p, "\u0002", -1)
            fits = F.lit(True) if allowed is None else F.contains(F.lit(allowed), char)
            return F.when(i == 0, p).when(fits, F.concat(keep, char, rest)).otherwise(F.concat(F.lit("u"), code, rest))

        return F.array_join(F.transform(parts, part), "")

    name = decode(name, r"__u([0-9a-fA-F]{4})_", F.lit("_"), None)
    name = decode(name, r"_u([0-9a-fA-F]{4})_", F.lit(""), None)
    return decode(name, r"u([0-9a-fA-F]{4})(?![0-9a-fA-F])", F.lit(""), BARE_ESCAPES)


def entity_name(uri: Column) -> Column:
    """The decoded name after the first colon."""
    at = F.instr(uri, ":")
    return decoded_name(F.when(at > 0, F.substring(uri, at + 1, F.length(uri))).otherwise(uri))


def entity_id(uri: Column) -> Column:
    """``Q42`` of ``wd:Q42``, of an entity URL, or of the id itself."""
    return F.coalesce(F.when(F.startswith(uri, F.lit("wd:")), F.substring(uri, F.lit(4), F.length(uri))), extracted(uri, r"/entity/(Q\d+)"), F.when(uri.rlike(r"^Q\d+$"), uri))


def article_link(line: Column) -> Column:
    """An article URL in any language, quoted, in a line that links one."""
    return F.when(F.contains(line, F.lit("schema:mainEntityOfPage")) | F.contains(line, F.lit("wikipedia.org/wiki/")), extracted(line, r'"(https?://[^/]*wikipedia\.org/wiki/[^"]+)"'))


def sitelink(statement: Column) -> Column:
    """(entity, url) of a statement about an English article."""
    about = extracted(statement, r"schema:about\s+wd:(Q\d+)")
    url = unquoted(extracted(statement, r"<(https?://en\.wikipedia\.org/wiki/[^>]+)>"))
    return F.when(about.isNotNull() & url.isNotNull(), F.struct(about.alias("entity"), url.alias("url")))


def section_key(article_id: Column, index: Column) -> Column:
    return F.concat_ws("_", article_id.cast("string"), index.cast("string"))


def spaced(name: Column) -> Column:
    return F.replace(name, F.lit("_"), F.lit(" "))
