"""Signals of HTML pages on columns, by pattern, and a parser-based extractor as an Arrow function."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from fathom.functions.text import collapse_whitespace, trim

SCAN_CHARS, EXCERPT_WORDS = 200_000, 300
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&nbsp;", "\u00a0"), ("&amp;", "&"))


def decode_entities(text: Column) -> Column:
    """Seven named entities, each once; the ampersand last so that nothing is decoded twice."""
    for a, b in ENTITIES:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def _none_if_empty(text: Column) -> Column:
    return F.nullif(trim(text), F.lit(""))


def title(html: Column) -> Column:
    return _none_if_empty(decode_entities(F.regexp_extract(F.left(html, F.lit(SCAN_CHARS)), r"(?is)<title[^>]*>(.*?)</title>", 1)))


def meta(html: Column, name: str) -> Column:
    """Content of the first meta tag with this property or name."""
    tag = F.regexp_extract(F.left(html, F.lit(SCAN_CHARS)), rf"(?is)<meta\b[^>]*\b(?:property|name)\s*=\s*[\"']{name}[\"'][^>]*>", 0)
    content = r"(?is)\bcontent\s*=\s*(?:\"([^\"]*)\"|'([^']*)')"
    return _none_if_empty(decode_entities(F.concat(F.regexp_extract(tag, content, 1), F.regexp_extract(tag, content, 2))))  # one of them is empty


def headings(html: Column, most: int = 5) -> Column:
    found = F.regexp_extract_all(html, F.lit(r"(?is)<h[12]\b[^>]*>(.*?)</h[12]>"), F.lit(1))
    clean = F.transform(found, lambda x: collapse_whitespace(decode_entities(F.regexp_replace(x, "<[^>]*>", " "))))
    return F.slice(F.array_distinct(F.filter(clean, lambda x: x != "")), 1, most)


def links(html: Column) -> Column:
    """Every <link> with rel and href: array of structs (rel, href, sizes, type)."""
    tags = F.regexp_extract_all(F.left(html, F.lit(1_500_000)), F.lit(r"(?is)<link\b[^>]*>"), F.lit(0))

    def attribute(tag, name):
        return F.regexp_replace(F.regexp_extract(tag, rf"(?is)\b{name}\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", 1), "^[\"']|[\"']$", "")

    found = F.transform(tags, lambda t: F.struct(*[attribute(t, n).alias(n) for n in ("rel", "href", "sizes", "type")]))
    return F.filter(found, lambda x: (x["rel"] != "") & (x["href"] != ""))


def best_icon(candidates: Column) -> Column:
    """href of the link that suits a 32-pixel icon best: sized ones by distance, scalable 1, unsized 15, touch icons 100 more."""

    def scored(x, i):
        rel = F.split(F.lower(x["rel"]), r"\s+")
        apple = F.exists(rel, lambda r: r.isin("apple-touch-icon", "apple-touch-icon-precomposed"))
        plain = F.array_contains(rel, "icon")
        sizes = F.filter(F.split(F.lower(trim(x["sizes"])), r"\s+"), lambda s: (s == "any") | s.rlike("^[0-9]+x[0-9]+$"))
        each = F.transform(sizes, lambda s: F.when(s == "any", F.lit(1)).otherwise(F.abs(F.substring_index(F.regexp_replace(s, "any", "33x"), "x", 1).cast("int") - 32)))
        scalable = F.lower(x["type"]).rlike("svg") | x["href"].rlike(r"(?i)\.svg($|[?#])")
        base = F.when(F.size(each) > 0, F.array_min(each)).when(scalable, 1).when(plain, 15).otherwise(148)
        usable = (plain | apple) & (~x["href"].rlike("(?i)^[a-z][a-z0-9+.-]*:") | x["href"].rlike("(?i)^https?:"))
        return F.when(usable, F.struct((base + F.when(plain, 0).otherwise(100)).alias("score"), i.alias("i"), x["href"].alias("href")))

    return F.array_min(F.transform(candidates, scored))["href"]


def resolve(href: Column, base: Column) -> Column:
    """An absolute URL for href on a page at base."""
    scheme, authority = F.try_parse_url(base, F.lit("PROTOCOL")), F.try_parse_url(base, F.lit("AUTHORITY"))
    root = F.concat(scheme, F.lit("://"), authority)
    folder = F.regexp_replace(F.coalesce(F.try_parse_url(base, F.lit("PATH")), F.lit("/")), "[^/]*$", "")
    return F.when(href.rlike("(?i)^https?://"), href).when(F.startswith(href, F.lit("//")), F.concat(scheme, F.lit(":"), href)).when(F.startswith(href, F.lit("/")), F.concat(root, href)).otherwise(F.concat(root, F.when(folder == "", F.lit("/")).otherwise(folder), href))


class _Reader(HTMLParser):
    """Readable text: of <article> if there is one, else of the body; never of scripts, styles or navigation."""

    SKIPPED = {"script", "style", "nav", "aside", "footer", "header", "noscript", "form", "template"}

    def __init__(self):
        super().__init__()
        self.skip, self.article, self.inside, self.whole = 0, 0, [], []

    def handle_starttag(self, tag, attrs):
        self.skip += tag in self.SKIPPED
        self.article += tag == "article"

    def handle_endtag(self, tag):
        if tag in self.SKIPPED and self.skip:
            self.skip -= 1
        if tag == "article" and self.article:
            self.article -= 1

    def handle_data(self, data):
        if not self.skip:
            (self.inside if self.article else self.whole).append(data)


def excerpt_of(page: str | None, most: int = EXCERPT_WORDS) -> str | None:
    reader = _Reader()
    reader.feed(page or "")
    reader.close()
    words = " ".join(reader.inside or reader.whole).split()
    return " ".join(words[:most]) or None


@F.pandas_udf(StringType())
def excerpt(pages: pd.Series) -> pd.Series:
    """The first 300 readable words of each page."""
    return pages.map(excerpt_of)
