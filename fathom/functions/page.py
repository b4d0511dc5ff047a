"""All signals of a page from one parse, in Arrow batches; a page that the parser refuses is read by the patterns of html.py."""

from __future__ import annotations

from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructType

from fathom.functions import html
from fathom.functions.text import distinct_ignoring_case

FIELDS = {
    "title": StringType(),
    "og_title": StringType(),
    "meta_description": StringType(),
    "site_name": StringType(),
    "headings": ArrayType(StringType()),
    "icon_url": StringType(),
    "excerpt": StringType(),
    "n_links": IntegerType(),
}
_SCHEMA = StructType().add("parsed", BooleanType())
for _name, _kind in FIELDS.items():
    _SCHEMA = _SCHEMA.add(_name, _kind)
HEADINGS = 5
#: Fixed values of the choice of an icon: wanted pixels, scores of scalable and unsized ones, what touch icons are taken to measure and lose.
PIXELS, SCALABLE, UNSIZED, TOUCH_PIXELS, TOUCH_LOSS = 32, 1, 15, 180, 100
TOUCH = {"apple-touch-icon", "apple-touch-icon-precomposed"}


def _icon_score(link: dict[str, str]) -> int | None:
    """How far a link is from the wanted icon, None if it is not one."""
    rel = set(link["rel"].lower().split())
    plain = "icon" in rel
    if not plain and not rel & TOUCH:
        return None
    loss = 0 if plain else TOUCH_LOSS
    widths = [s.split("x") for s in link.get("sizes", "").lower().split() if s != "any"]
    offsets = [abs(int(w[0]) - PIXELS) for w in widths if len(w) == 2 and all(x.isascii() and x.isdigit() for x in w)]
    if "any" in link.get("sizes", "").lower().split():
        offsets.append(SCALABLE)
    if offsets:
        return min(offsets) + loss
    path = link["href"].lower().split("#")[0].split("?")[0]
    if "svg" in link.get("type", "").lower() or path.endswith(".svg"):
        return SCALABLE + loss
    return (UNSIZED if plain else TOUCH_PIXELS - PIXELS) + loss


def best_icon_of(links: list[dict[str, str]], base: str) -> str | None:
    """The absolute http(s) address of the best icon among links (rel, href, sizes, type); of equals the first."""
    found = []
    for i, link in enumerate(links):
        score = _icon_score(link)
        if score is None:
            continue
        try:
            address = urljoin(base, link["href"])
        except ValueError:
            continue
        if address.lower().startswith(("http://", "https://")):
            found.append((score, i, address))
    return min(found)[2] if found else None


class _Page(html._Reader):
    """The reader of excerpts that also keeps the title, meta tags, links with a rel, and level 1 and 2 headings."""

    NAMED = {"title": "title", "h1": "heading", "h2": "heading"}

    def __init__(self):
        super().__init__()
        self.metas, self.links, self.texts = {}, [], {"title": [], "heading": []}
        self.open, self.parts = None, []

    def _shut(self):
        if self.open:
            self.texts[self.open].append("".join(self.parts))
        self.open, self.parts = None, []

    def handle_starttag(self, tag, attrs):
        super().handle_starttag(tag, attrs)
        own = {k: v or "" for k, v in reversed(attrs)}  # the first of a repeated attribute
        if tag == "meta":
            for kind in ("property", "name"):
                if kind in own:
                    self.metas.setdefault((kind, own[kind]), own.get("content", ""))
        elif tag == "link" and "rel" in own:
            self.links.append({"href": "", **own})
        elif tag in self.NAMED:
            self._shut()
            self.open = self.NAMED[tag]

    def handle_endtag(self, tag):
        super().handle_endtag(tag)
        if self.open and self.NAMED.get(tag) == self.open:
            self._shut()

    def handle_data(self, data):
        super().handle_data(data)
        if self.open:
            self.parts.append(data)

    def close(self):
        super().close()
        self._shut()

    def meta(self, *keys: tuple[str, str]) -> str | None:
        return next((self.metas[k].strip() for k in keys if self.metas.get(k, "").strip()), None)


def links_of(page: str) -> list[dict[str, str]]:
    reader = _Page()
    reader.feed(page)
    reader.close()
    return reader.links


def signals_of(page: str | None, base: str | None) -> dict:
    """The signals of one page; none of an empty one."""
    reader = _Page()
    reader.feed(page or "")
    reader.close()
    og_title = reader.meta(("property", "og:title"))
    heads: dict[str, str] = {}
    for h in (" ".join(x.split()) for x in reader.texts["heading"]):
        heads.setdefault(h.lower(), h)
    words = " ".join(reader.inside or reader.whole).split()
    return {
        "title": og_title or next(iter(reader.texts["title"]), "").strip() or None,
        "og_title": og_title,
        "meta_description": reader.meta(("property", "og:description"), ("name", "description")),
        "site_name": reader.meta(("property", "og:site_name")),
        "headings": [h for h in heads.values() if h][:HEADINGS] or None,
        "icon_url": best_icon_of(reader.links, base or ""),
        "excerpt": " ".join(words[: html.EXCERPT_WORDS]) or None,
        "n_links": len(reader.links),
    }


@F.pandas_udf(_SCHEMA)
def _parsed(pages: pd.Series, bases: pd.Series) -> pd.DataFrame:
    rows = []
    for page, base in zip(pages, bases):
        try:
            rows.append({"parsed": True, **signals_of(page, base)})
        except (AssertionError, ValueError):  # the parser's own refusals of broken declarations
            rows.append({"parsed": False, "n_links": 0})
    return pd.DataFrame(rows, columns=_SCHEMA.names, dtype=object).where(lambda d: d.notna(), None)


def with_signals(pages: DataFrame, body: str = "html", base: str = "url") -> DataFrame:
    """pages with the columns of FIELDS, which replace those of the same names.

    title is the og_title where there is one. Headings are the first five, unlike in more than case. A null or empty body
    has none of them, and 0 links; a body of any length is read whole.
    """
    h, found = F.col(body), html.links(F.col(body))
    og_title, icon = html.meta(h, "og:title"), html.best_icon(found)
    pattern = {
        "title": F.coalesce(og_title, html.title(h)),
        "og_title": og_title,
        "meta_description": F.coalesce(html.meta(h, "og:description"), html.meta(h, "description")),
        "site_name": html.meta(h, "og:site_name"),
        "headings": F.slice(distinct_ignoring_case(html.headings(h, 1000)), 1, HEADINGS),
        "icon_url": html.resolve(icon, F.col(base)),
        "excerpt": F.lit(None).cast("string"),
        "n_links": F.size(found),
    }
    read = pages.withColumn("_page", _parsed(h, F.col(base)))
    return read.withColumns({c: F.when(F.col("_page.parsed"), F.col(f"_page.{c}")).otherwise(x) for c, x in pattern.items()}).drop("_page")
