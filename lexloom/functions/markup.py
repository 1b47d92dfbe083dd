"""What no built-in expression can do on markup: tables, HTML lists and links, fuzzy ratios. Arrow-batched Python, row by row."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.functions.dates import MONTHS

MOST_ROWS = 10
_MARKS = ("|", "!", "<td", "<tr", "<th", "class=", "wikitable")
_DATE_LINK = re.compile(r"^(?:" + "|".join(MONTHS) + r")\s+\d+(?:\s*[-–—]\s*\d+)?$", re.IGNORECASE)
_DATE = re.compile(r"^([A-Za-z]+)\s+(\d+)(?:\s*[-–—]\s*\d+)?$")
_EVENT = re.compile(r"^([A-Za-z]+\s+\d+(?:\s*[-–—]\s*\d+)?)\s*[–—]\s*(.+)$", re.DOTALL)
LINK = "struct<title:string,href:string,article:string>"
EVENT = f"struct<year:int,date:string,month:int,day:int,date_text:string,topic:string,links:array<{LINK}>>"


def flat_table(body: str) -> str:
    """A table's inside as text: cells by commas, rows by semicolons, ten rows at most."""
    body = re.sub(r"<(?!/?(?:td|tr|th)\b)[^>]*>", " ", body)
    rows = re.split(r"\|-+|</?tr[^>]*>|\n", body)
    out = []
    for row in rows:
        cells = re.split(r"\|\||!!|[|!]|</?t[dh][^>]*>", row)
        cells = [re.sub(r"\s+", " ", c).strip() for c in cells]
        cells = [c for c in cells if c and not re.match(r'^[\w-]+\s*=\s*"?[^"]*"?$', c)]
        if cells:
            out.append(", ".join(cells))
    text = "; ".join(out[:MOST_ROWS])
    return text + " …" if len(out) > MOST_ROWS else text


def _flat_tables(text: str | None) -> str | None:
    if text is None:
        return None
    while True:  # from the inside out
        changed = re.sub(r"\{([^{}]*)\}", lambda m: f" {flat_table(m[1])} " if any(x in m[1] for x in _MARKS) else f"\u0001{m[1]}\u0002", text)
        if changed == text:
            return text.replace("\u0001", "{").replace("\u0002", "}")
        text = changed


@F.pandas_udf(T.StringType())
def flat_tables(texts: pd.Series) -> pd.Series:
    """Tables in braces as text; braces without a table's marks stay."""
    return texts.map(_flat_tables)


class _Node:
    def __init__(self, tag: str, attributes: dict[str, str | None]) -> None:
        self.tag, self.attributes, self.children = tag, attributes, []

    def text(self) -> str:
        return "".join(c if isinstance(c, str) else c.text() for c in self.children)

    def find(self, *tags: str) -> list[_Node]:
        out = []
        for c in self.children:
            if isinstance(c, _Node):
                out += ([c] if c.tag in tags else []) + c.find(*tags)
        return out

    def own(self, tag: str) -> list[_Node]:
        return [c for c in self.children if isinstance(c, _Node) and c.tag == tag]


class _Tree(HTMLParser):
    VOID = {"br", "img", "hr", "input", "meta", "link", "wbr"}

    def __init__(self, html: str) -> None:
        super().__init__(convert_charrefs=True)
        self.root = _Node("", {})
        self.open = [self.root]
        self.feed(html)
        self.close()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "li":  # closes the item before it in the same list
            for at in range(len(self.open) - 1, 0, -1):
                if self.open[at].tag in ("ul", "ol"):
                    break
                if self.open[at].tag == "li":
                    del self.open[at:]
                    break
        node = _Node(tag, dict(attrs))
        self.open[-1].children.append(node)
        if tag not in self.VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.open[-1].children.append(_Node(tag, dict(attrs)))

    def handle_endtag(self, tag: str) -> None:
        for at in range(len(self.open) - 1, 0, -1):
            if self.open[at].tag == tag:
                del self.open[at:]
                return

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(data)


def links_of(node: _Node, prefix: str) -> list[dict]:
    """Links below ``prefix``, the first of each title; no citations, help pages and dates."""
    out, seen = [], set()
    for a in node.find("a"):
        href = a.attributes.get("href") or ""
        text = a.text().strip()
        title = a.attributes.get("title") or text
        skipped = "#cite" in href or href.startswith((f"{prefix}Help:", f"{prefix}Wikipedia:"))
        if not href.startswith(prefix) or skipped or _DATE_LINK.match(text) or title in seen:
            continue
        seen.add(title)
        out.append({"title": title, "href": href, "article": href[len(prefix) :].split("#")[0]})
    return out


def page_links(prefix: str = "/wiki/"):
    """A column function: the links of a page, as an array."""

    @F.pandas_udf(f"array<{LINK}>")
    def links(pages: pd.Series) -> pd.Series:
        return pages.map(lambda html: None if html is None else links_of(_Tree(html).root, prefix))

    return links


def _clean(text: str) -> str:
    return re.sub(r"\[\d+\]", "", re.sub(r"\s+", " ", text)).strip()


def _events_of_item(item: _Node, year: int, month: int | None, prefix: str) -> list[dict]:
    def event(text: str, node: _Node, date: tuple) -> dict:
        m, day, date_text = date
        full = f"{year:04d}-{m:02d}-{day:02d}" if m and day else None
        return {"year": year, "date": full, "month": m, "day": day, "date_text": date_text, "topic": text, "links": links_of(node, prefix)}

    def dated(text: str) -> tuple | None:
        found = _DATE.match(text)
        if found and found[1].lower() in MONTHS:
            return MONTHS.index(found[1].lower()) + 1, int(found[2]), text
        return None

    first = (item.own("a") or item.find("a") or [None])[0]
    date = (dated(first.text().strip()) if first else None) or (month, None, "")
    nested = item.own("ul") + item.own("ol")
    if nested:
        texts = [(_clean(sub.text()), sub) for sub in nested[0].own("li")]
        return [event(t, sub, date) for t, sub in texts if t]
    text = item.text().strip()
    parts = _EVENT.match(text)
    if parts:
        date, text = dated(parts[1].strip()) or (date[0], date[1], parts[1].strip()), parts[2]
    text = _clean(text)
    return [event(text, item, date)] if text else []


def _year_events(html: str | None, year: int, prefix: str) -> list[dict] | None:
    if html is None:
        return None
    out, inside, month = [], False, None

    def walk(node: _Node) -> None:
        nonlocal inside, month
        for c in node.children:
            if not isinstance(c, _Node):
                continue
            if c.tag == "h2":
                inside, month = "Events" in (c.attributes.get("id"), c.text().strip()) or any(s.attributes.get("id") == "Events" for s in c.find("span")), None
            elif c.tag == "h3" and inside:
                name = re.sub(r"\[.*", "", c.text()).strip().lower()
                month = MONTHS.index(name) + 1 if name in MONTHS else month
            elif c.tag in ("ul", "ol") and inside:
                for item in c.own("li"):
                    out.extend(_events_of_item(item, year, month, prefix))
            else:
                walk(c)

    walk(_Tree(html).root)
    return out


def year_events(prefix: str = "/wiki/"):
    """A column function of (html, year): the dated events under a year page's Events heading, with their links."""

    @F.pandas_udf(f"array<{EVENT}>")
    def events(pages: pd.Series, years: pd.Series) -> pd.Series:
        return pd.Series([_year_events(h, int(y), prefix) for h, y in zip(pages, years, strict=True)])

    return events


def sorted_ratio(a: str, b: str) -> float:
    """Similarity of two texts' sorted words from 0 to 1: twice their longest common subsequence over their lengths."""
    x, y = (" ".join(sorted(re.split(r"\s+", t.strip()))) if t.strip() else "" for t in (a, b))
    if not x and not y:
        return 1.0
    where: dict[str, int] = {}
    for i, c in enumerate(x):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(x)) - 1
    row = full
    for c in y:
        hit = row & where.get(c, 0)
        row = (row + hit | row - hit) & full
    return 2 * (len(x) - row.bit_count()) / (len(x) + len(y))


@F.pandas_udf(T.DoubleType())
def token_sort_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else sorted_ratio(x.lower(), y.lower()) for x, y in zip(a, b, strict=True)], dtype="float64")


def rdf_metadata(rdf):
    """A book's metadata from its RDF as a struct of title, author, birth and death year, issue date, description and subjects."""
    from lexloom.functions.dates import extracted

    name = F.trim(extracted(rdf, r"<pgterms:name>([^<]+)</pgterms:name>"))
    birth = extracted(rdf, r"<pgterms:birthdate[^>]*>(\d{4})</pgterms:birthdate>").cast("int")
    death = extracted(rdf, r"<pgterms:deathdate[^>]*>(\d{4})</pgterms:deathdate>").cast("int")
    subjects = F.filter(F.regexp_extract_all(rdf, F.lit(r"<rdf:value>([^<]+)</rdf:value>"), F.lit(1)), lambda s: ~F.startswith(s, F.lit("http")))
    return F.struct(
        F.trim(extracted(rdf, r"<dcterms:title>([^<]+)</dcterms:title>")).alias("title"),
        name.alias("author"),
        F.coalesce(birth, F.when(death.isNull(), extracted(name, r"(\d{4})-\d{4}").cast("int"))).alias("author_birth_year"),
        F.coalesce(death, extracted(name, r"\d{4}-(\d{4})").cast("int")).alias("author_death_year"),
        F.trim(extracted(rdf, r"<dcterms:issued[^>]*>([^<]+)</dcterms:issued>")).alias("issued_date"),
        F.trim(extracted(rdf, r"<pgterms:marc520>([^<]+)</pgterms:marc520>")).alias("description"),
        subjects.alias("subjects"),
    )


def header_field(text, name: str, most: int = 3000):
    """``Title:`` or ``Author:`` of a book's header."""
    from lexloom.functions.dates import extracted

    return F.trim(extracted(F.left(text, F.lit(most)), rf"(?m)^{name}:\s*(.+?)\s*$"))
