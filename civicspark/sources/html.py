"""Listing pages and documents in HTML or JSON inside HTML."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicspark.functions.text import compact, strip_tags, unescape


def links(html: Column) -> Column:
    """All links of a page: structs ``url`` and ``label``, in order."""
    pattern = r"(?is)<a\b[^>]*?href\s*=\s*[\"']([^\"']+)[\"'][^>]*>(.*?)</a>"
    urls, labels = F.regexp_extract_all(html, F.lit(pattern), F.lit(1)), F.regexp_extract_all(html, F.lit(pattern), F.lit(2))
    return F.transform(F.arrays_zip(urls.alias("url"), labels.alias("label")), lambda x: F.struct(unescape(x["url"]).alias("url"), strip_tags(x["label"]).alias("label")))


def title(html: Column) -> Column:
    return strip_tags(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def first_json(text: Column, schema: str) -> Column:
    """The object that begins at the first brace of a text with junk before it; null if it can't be read."""
    start = F.locate("{", text)
    return F.when(start > 0, F.from_json(F.substr(text, start), schema, {"mode": "PERMISSIVE"}))


def attribute_json(html: Column, attribute: str, schema: str) -> Column:
    """The array of objects in an attribute's escaped JSON."""
    return F.from_json(unescape(F.regexp_extract(html, rf"(?is)\b{attribute}\s*=\s*\"([^\"]*)\"", 1)), schema)


def advertised_count(html: Column) -> Column:
    """The number of results a page announces."""
    return F.regexp_extract(strip_tags(html), r"(?i)(\d+)\s+(?:r[ée]sultats?|objets?|documents?)", 1).try_cast("int")


class _Blocks(HTMLParser):
    """The inner text and links of every element with a class, nested ones included."""

    def __init__(self, name: str):
        super().__init__(convert_charrefs=True)
        self.name, self.depth, self.out, self.text, self.hrefs = name, 0, [], [], []

    def handle_starttag(self, tag, attrs):
        given = dict(attrs)
        if self.depth or self.name in (given.get("class") or "").split():
            if tag not in ("br", "img", "hr", "input", "meta", "link"):
                self.depth += 1
            if tag == "a" and given.get("href"):
                self.hrefs.append(given["href"])

    def handle_data(self, data):
        if self.depth:
            self.text.append(data)

    def handle_endtag(self, tag):
        if self.depth and tag not in ("br", "img", "hr", "input", "meta", "link"):
            self.depth -= 1
            if not self.depth:
                self.out.append((" ".join(" ".join(self.text).split()), self.hrefs))
                self.text, self.hrefs = [], []


def blocks(pages: DataFrame, id_col: str, html_col: str, css_class: str) -> DataFrame:
    """The elements with a class: ``id``, ``block_no``, ``text`` and ``urls``; nesting needs a parser, so it runs on Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, html in zip(batch["id"], batch["html"]):
                parser = _Blocks(css_class)
                parser.feed(html or "")
                rows += [(key, i, text, urls) for i, (text, urls) in enumerate(parser.out)]
            yield pd.DataFrame(rows, columns=["id", "block_no", "text", "urls"])

    return pages.select(F.col(id_col).cast("string").alias("id"), F.col(html_col).alias("html")).mapInPandas(run, "id string, block_no int, text string, urls array<string>")


def headed(rows: DataFrame, group: str, position: str, text: str, heading: Column) -> DataFrame:
    """Rows that aren't headings, each with the last heading before it."""
    from pyspark.sql import Window

    marked = rows.withColumn("__h", F.when(heading, compact(F.col(text))))
    return marked.withColumn("heading", F.last("__h", ignorenulls=True).over(Window.partitionBy(group).orderBy(position))).where("__h is null").drop("__h")


def _inner(block: Column, pattern: str) -> Column:
    """The text of the first group of a pattern, null if it isn't found or empty."""
    return F.nullif(strip_tags(F.regexp_extract(block, pattern, 1)), F.lit(""))


def result_rows(html: Column, kind: str, years: Column) -> Column:
    """The results of a search page: structs of title, subject, year and url, each URL once.

    A result is ``<a class="result" href=...>`` with ``<h3>`` title, ``<p>``
    subject and ``<span class="year">``; only titles that begin with ``kind``
    and years among ``years`` count.  A viewer's URL stands for the file it shows.
    """
    blocks_ = F.regexp_extract_all(html, F.lit(r'(?is)<a\b[^>]*class="[^"]*\bresult\b[^"]*"[^>]*>.*?</a>'), F.lit(0))

    def row(x: Column) -> Column:
        href = unescape(F.regexp_extract(x, r'(?is)href="([^"]*)"', 1))
        shown = F.try_url_decode(F.nullif(F.regexp_extract(href, r"[?&]file=([^&#]*)", 1), F.lit("")))
        return F.struct(_inner(x, "(?is)<h3[^>]*>(.*?)</h3>").alias("title"), _inner(x, "(?is)<p[^>]*>(.*?)</p>").alias("subject"), F.nullif(F.regexp_extract(x, r'(?is)class="year"[^>]*>\s*(20\d{2})', 1), F.lit("")).alias("year"), F.coalesce(shown, href).alias("url"))

    rows = F.filter(F.transform(blocks_, row), lambda r: r["title"].rlike(rf"(?i)^{kind}\s") & F.array_contains(years, r["year"]) & (r["url"] != ""))
    none = F.array().cast("array<struct<title:string,subject:string,year:string,url:string>>")
    return F.aggregate(rows, none, lambda acc, r: F.when(F.exists(acc, lambda x: x["url"] == r["url"]), acc).otherwise(F.array_append(acc, r)))


class _Elements(HTMLParser):
    """The source of every outermost ``tag`` with a class, whatever is nested in it."""

    def __init__(self, tag: str, name: str, text: str):
        super().__init__(convert_charrefs=False)
        self.tag, self.name, self.depth, self.begin, self.out, self.text = tag, name, 0, 0, [], text
        self.lines = [0]
        for line in text.split("\n"):
            self.lines.append(self.lines[-1] + len(line) + 1)
        self.feed(text)

    def _at(self) -> int:
        line, column = self.getpos()
        return self.lines[line - 1] + column

    def handle_starttag(self, tag, attrs):
        if tag != self.tag:
            return
        if self.depth:
            self.depth += 1
        elif self.name in (dict(attrs).get("class") or "").split():
            self.depth, self.begin = 1, self._at()

    def handle_endtag(self, tag):
        if tag == self.tag and self.depth:
            self.depth -= 1
            if not self.depth:
                self.out.append(self.text[self.begin : self.text.index(">", self._at()) + 1])


def elements(pages: DataFrame, id_col: str, html_col: str, tag: str, css_class: str) -> DataFrame:
    """The source of the outermost elements with a class: ``id``, ``no`` and ``source``; one that isn't closed is left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(key, i, source) for key, html in zip(batch["id"], batch["html"]) for i, source in enumerate(_Elements(tag, css_class, html or "").out)]
            yield pd.DataFrame(rows, columns=["id", "no", "source"])

    return pages.select(F.col(id_col).cast("string").alias("id"), F.col(html_col).alias("html")).mapInPandas(run, "id string, no int, source string")


def teaser(block: Column) -> Column:
    """The record in a teaser block: struct of date, author, kind, reference, title, url and download_id.

    The first column holds the date and the author, the block's id its kind
    and reference in spans; the link that downloads a PDF wins over that of the
    heading.  Without a date or a heading there is no record (null).
    """
    left = strip_tags(F.regexp_extract(block, r'(?is)<div[^>]*class="[^"]*\bcol-3\b[^"]*"[^>]*>(.*?)</div>', 1))
    day = F.regexp_extract(left, r"\b(\d{2}\.\d{2}\.\d{4})\b", 1)
    spans = F.transform(F.regexp_extract_all(F.regexp_extract(block, r"(?is)<p[^>]*\bteaser-id\b[^>]*>(.*?)</p>", 1), F.lit("(?is)<span[^>]*>(.*?)</span>"), F.lit(1)), strip_tags)
    heading = F.regexp_extract(block, "(?is)<h4[^>]*>(.*?)</h4>", 1)
    download = F.get(F.filter(links(block), lambda x: F.lower(x["label"]).rlike("t[ée]l[ée]charger pdf")), F.lit(0))["url"]
    url = F.coalesce(download, F.nullif(unescape(F.regexp_extract(heading, r'(?i)href="([^"]+)"', 1)), F.lit("")))
    iso = F.concat_ws("-", F.substring(day, 7, 4), F.substring(day, 4, 2), F.substring(day, 1, 2))
    return F.when(
        (day != "") & (heading != ""),
        F.struct(
            iso.alias("date"), F.trim(F.replace(left, day, F.lit(""))).alias("author"), F.get(spans, F.lit(0)).alias("kind"), F.get(spans, F.lit(1)).alias("reference"), strip_tags(heading).alias("title"), url.alias("url"),
            F.nullif(F.regexp_extract(url, r"[?&]d=([^&#]*)", 1), F.lit("")).alias("download_id"),
        ),
    )


class _Cards(HTMLParser):
    """Cards, list items and links of a page of objects."""

    def __init__(self, text: str):
        super().__init__(convert_charrefs=True)
        self.rows, self.row, self.depth, self.into = [], None, 0, None
        self.feed(text)

    def handle_starttag(self, tag, attrs):
        given = dict(attrs)
        classes = (given.get("class") or "").split()
        if self.row is None and "card" in classes:
            self.row, self.depth = {"id": None, "title": "", "author": "", "events": [], "files": []}, 0
        if self.row is None:
            return
        if tag == "div":
            self.depth += 1
        found = re.search(r"[?&]id=(\d+)", given.get("href") or "", re.I) if tag == "a" else None
        if found and self.row["id"] is None:
            self.row["id"], self.into = found[1], "title"
        elif tag == "a" and given.get("href"):
            self.row["files"].append([given["href"], ""])
            self.into = "file"
        elif tag == "small":
            self.into = "author"
        elif tag == "li":
            self.row["events"].append("")
            self.into = "event"

    def handle_data(self, data):
        if self.row is None or self.into is None:
            return
        if self.into == "event":
            self.row["events"][-1] += data
        elif self.into == "file":
            self.row["files"][-1][1] += data
        else:
            self.row[self.into] += data

    def handle_endtag(self, tag):
        if self.row is None:
            return
        if tag in ("a", "small", "li"):
            self.into = None
        if tag == "div":
            self.depth -= 1
            if not self.depth:
                self.rows.append(self.row)
                self.row = None


CARDS = "id string, no int, object_id string, title string, author string, events array<string>, files array<struct<url:string,label:string>>"


def cards(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """The objects on a listing or detail page, ``<div class="card">``: id and title of the first link with an id, author, events and files.

    A file counts once: by the id of its download, else by its URL.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tidy = lambda t: " ".join(t.split())
        for batch in batches:
            rows = []
            for key, html in zip(batch["id"], batch["html"]):
                for i, x in enumerate(_Cards(html or "").rows):
                    files: dict[str, dict] = {}
                    for url, label in x["files"]:
                        download = re.search(r"[?&]download=(\d+)", url)
                        files.setdefault(download[1] if download else url, {"url": url, "label": tidy(label)})
                    rows.append((key, i, x["id"], tidy(x["title"]), re.sub(r"(?i)^auteurs?\s*:\s*", "", tidy(x["author"])), [tidy(e) for e in x["events"]], list(files.values())))
            yield pd.DataFrame(rows, columns=["id", "no", "object_id", "title", "author", "events", "files"])

    return pages.select(F.col(id_col).cast("string").alias("id"), F.col(html_col).alias("html")).mapInPandas(run, CARDS)


def accordion(html: Column) -> Column:
    """The questions and answers of an accordion: structs of title and body, the body as HTML."""
    p = r'(?is)<div class="question[^"]*"[^>]*>\s*<div class="title[^"]*"[^>]*>(.*?)</div>\s*<div class="answer"[^>]*>(.*?)</div>\s*</div>'
    titles, bodies = F.regexp_extract_all(html, F.lit(p), F.lit(1)), F.regexp_extract_all(html, F.lit(p), F.lit(2))
    return F.transform(F.arrays_zip(titles.alias("t"), bodies.alias("b")), lambda x: F.struct(strip_tags(x["t"]).alias("title"), x["b"].alias("body")))


def member_rows(body: Column, party: Column) -> Column:
    """The members in an answer's rows: structs of name and party; the abbreviation in brackets is the party, else the whole label."""
    p = r"(?is)<li[^>]*>\s*<span[^>]*>(.*?)</span>\s*<span[^>]*>(.*?)</span>"
    last, first = F.regexp_extract_all(body, F.lit(p), F.lit(1)), F.regexp_extract_all(body, F.lit(p), F.lit(2))
    short = F.coalesce(F.nullif(F.regexp_extract(party, r"\(([A-Z0-9]+)\)\s*$", 1), F.lit("")), party)
    named = F.transform(F.arrays_zip(first.alias("f"), last.alias("l")), lambda x: F.struct(F.concat_ws(" ", strip_tags(x["f"]), strip_tags(x["l"])).alias("name"), short.alias("party")))
    return F.filter(named, lambda m: F.trim(m["name"]) != "")


def text_and_links(html: Column) -> Column:
    """A page's text, blocks on lines of their own, and its links."""
    broken = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>", ""), r"(?i)<(?:br|/p|/div|/li|/h\d|/tr)\b[^>]*>", "\n")
    lines = F.filter(F.transform(F.split(broken, "\n"), strip_tags), lambda x: x != "")
    return F.struct(F.array_join(lines, "\n").alias("text"), links(html).alias("links"))


def decodable_object(text: Column, schema: str, key: str) -> Column:
    """The first object of a text with junk around it that can be read and has ``key``: each brace is tried in order."""
    starts = F.split(text, r"(?=\{)")
    rest = F.transform(starts, lambda _, i: F.array_join(F.slice(starts, i + 1, F.size(starts)), ""))
    read = F.transform(F.filter(rest, lambda r: r.startswith("{")), lambda r: F.from_json(F.regexp_extract(r, r"(?s)^(\{.*\})", 1), schema))
    return F.get(F.filter(read, lambda x: x[key].isNotNull()), F.lit(0))


def page_count(total: Column, size: int) -> Column:
    """How many pages of ``size`` results there are."""
    return F.ceil(total / F.lit(size)).cast("int")


def incomplete(pages: DataFrame, listing: str, advertised: str, key: str) -> DataFrame:
    """Listings whose distinct rows aren't as many as they announce: ``listing``, ``advertised`` and ``found``."""
    counted = pages.groupBy(listing).agg(F.max(advertised).cast("long").alias("advertised"), F.count_distinct(key).alias("found"))
    return counted.where("not (advertised <=> found)")
