"""Registered queries of pages and what is fetched for them: parsed signals, icons, preferences, responsiveness."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.functions import html, page, url
from fathom.operators import icons, order, prefs
from fathom.plans.catalog import PAGES, query
from fathom.sources import adapters as A

# --- signals by one parse


def _text(piece: str) -> str:
    """SQL: the words of piece, tags taken for spaces and entities decoded."""
    bare = f"regexp_replace({piece}, '<[^>]*>', ' ', 'g')"
    for name, char in (("quot", '"'), ("copy", "©"), ("middot", "·"), ("amp", "&")):
        bare = f"regexp_replace({bare}, '&{name};?', '{char}', 'g')"
    return f"list_filter(regexp_split_to_array({bare}, '\\s+'), lambda x: x <> '')"


def _words(piece: str) -> str:
    return f"array_to_string({_text(piece)}, ' ')"


_ARTICLE = "regexp_extract(html, '(?s)<article>(.*)</article>', 1)"
_PART = "CASE WHEN page_id % 3 = 1 THEN 'Part ' || page_id || ' PART ' || page_id || ' ' ELSE '' END"
_EXCERPT = lambda text: f"nullif(array_to_string(list_slice({text}, 1, 300), ' '), '')"
_ICON = "CASE WHEN page_id % 6 = 0 THEN 'https://cdn.example/s' || (page_id % 11) WHEN page_id % 2 = 0 THEN regexp_extract(url, '^[^:]+://[^/?#]+') || '/i16.png' END"


@query(f"SELECT page_id, {_EXCERPT(_text(_ARTICLE))} AS excerpt FROM pages")
def page_excerpts(spark: SparkSession, d: str) -> DataFrame:
    """Readable text by a parser, in Arrow batches."""
    return A.table(spark, d, "pages").select("page_id", html.excerpt("html").alias("excerpt"))


@query(
    f"SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'Notes & links ' || page_id ELSE nullif({_words(chr(40) + 'regexp_extract(html, ' + chr(39) + '<title>(.*?)</title>' + chr(39) + ', 1))')}, '') END AS title, "
    "CASE WHEN page_id % 3 = 0 THEN 'Notes & links ' || page_id END AS og_title, CASE page_id % 4 WHEN 1 THEN 'On <' || page_id || '>' WHEN 2 THEN 'plain ' || page_id END AS meta_description, "
    "CASE WHEN page_id % 5 = 0 THEN 'Site ' || (page_id % 7) END AS site_name, "
    f"CASE WHEN page_id % 3 = 1 THEN 'Part ' || page_id || ' | ' ELSE '' END || {_words(chr(40) + 'regexp_extract(html, ' + chr(39) + '<h1>(.*?)</h1>' + chr(39) + ', 1))')} AS headings, {_ICON} AS icon_url, "
    f"{_EXCERPT(_text(_PART + ' || ' + _ARTICLE))} AS excerpt, "
    "CAST(CASE WHEN page_id % 2 = 0 THEN 2 ELSE 0 END + CASE WHEN page_id % 6 = 0 THEN 1 ELSE 0 END + CASE WHEN page_id % 7 = 3 THEN 1 ELSE 0 END AS INTEGER) AS n_links FROM pages"
)
def page_signals(spark: SparkSession, d: str) -> DataFrame:
    read = page.with_signals(A.dressed_pages(spark, d)).withColumn("headings", F.array_join("headings", " | "))
    return read.select("page_id", "title", "og_title", "meta_description", "site_name", "headings", "icon_url", "excerpt", "n_links")


# --- icons

_DECLARED = f"""declared AS (
    SELECT origin, arg_min(icon, page_id) FILTER (icon IS NOT NULL) AS declared FROM (SELECT page_id, regexp_extract(canonical_url, '^[^:]+://[^/?#]+') AS origin, {_ICON} AS icon FROM canon) GROUP BY 1
)"""


def _origins(spark: SparkSession, d: str) -> DataFrame:
    read = page.with_signals(A.dressed_pages(spark, d))
    return icons.origins(read.select(F.col("page_id").cast("string").alias("id"), "url", url.canonical(F.col("url")).alias("canonical_url"), F.col("page_id").alias("date_added"), "icon_url"))


@query(f"WITH {PAGES}, {_DECLARED} SELECT origin, declared FROM declared")
def declared_icons(spark: SparkSession, d: str) -> DataFrame:
    return _origins(spark, d)


def _stand_in(address: str) -> tuple[int, str, bytes]:
    """Answers by an address's length, as the given tables hold no sites."""
    n = len(address)
    if address.endswith("/favicon.ico"):
        return (200, "image/x-icon", bytes(n)) if n % 4 == 0 else (404, "text/html", b"none")
    if address.endswith("/page.png"):
        return 200, "image/png", bytes(n if n % 2 else 131_073)
    if address.endswith("/"):
        return 200, "text/html; charset=utf-8" if n % 3 else "application/json", b'<head><link rel=icon href="page.png"></head>'
    if n % 5 == 2:
        raise TimeoutError("no answer")
    return 200, "image/png" if n % 5 < 2 else "text/html", bytes(n)


@query(
    f"""WITH {PAGES}, {_DECLARED},
tried AS (
    SELECT *, length(declared) % 5 < 2 AS first, (length(origin) + 12) % 4 = 0 AS second, (length(origin) + 1) % 3 <> 0 AS shown, (length(origin) + 9) % 2 = 1 AS third FROM declared
)
SELECT origin, CASE WHEN first THEN 'declared' WHEN second THEN 'root' WHEN shown AND third THEN 'page' ELSE 'none' END AS via,
       CAST(CASE WHEN first THEN length(declared) WHEN second THEN length(origin) + 12 WHEN shown AND third THEN length(origin) + 9 ELSE 0 END AS INTEGER) AS n_bytes,
       coalesce(declared, CASE WHEN NOT second AND shown THEN origin || '/page.png' END, '') AS declared_url,
       CAST(CASE WHEN declared IS NULL THEN 0 ELSE 1 END + CASE WHEN coalesce(first, false) THEN 0 WHEN second THEN 1 WHEN shown THEN 3 ELSE 2 END AS INTEGER) AS n_asked
FROM tried"""
)
def icon_captures(spark: SparkSession, d: str) -> DataFrame:
    got = icons.capture(_origins(spark, d), _stand_in)
    return got.select("origin", "via", F.octet_length("bytes").alias("n_bytes"), "declared_url", F.size("asked").alias("n_asked"))


# --- preferences


@query(
    "SELECT event_id, event_id % 6 <> 0 AS crawl_enabled, CASE event_id % 6 WHEN 0 THEN user_id || ',b' WHEN 1 THEN 'x,' || user_id ELSE '' END AS excluded FROM events"
)
def prefs_messages(spark: SparkSession, d: str) -> DataFrame:
    """Messages of six kinds from events: well-formed ones, wrong types, none at all."""
    n, user = F.col("event_id") % 6, F.col("user_id").cast("string")
    raw = (
        F.when(n == 0, F.concat(F.lit('{"crawlEnabled": false, "excludedFolderIds": ["'), user, F.lit('", "b"]}')))
        .when(n == 1, F.concat(F.lit('{"crawlEnabled": "false", "excludedFolderIds": ["x", 3, null, ["q"], "'), user, F.lit('"]}')))
        .when(n == 2, F.concat(F.lit('{"excludedFolderIds": "'), user, F.lit('"}')))
        .when(n == 3, F.lit('{"crawlEnabled": null, "excludedFolderIds": {"a": "b"}}'))
        .when(n == 4, user)
    )
    return A.table(spark, d, "events").select("event_id", prefs.sanitized(raw).alias("p")).select("event_id", "p.crawl_enabled", F.array_join("p.excluded", ",").alias("excluded"))


# --- responsiveness


@query(
    """WITH ticks AS (SELECT event_type, user_id, event_id, epoch_us(ts) AS us FROM events),
late AS (SELECT event_type, greatest(0, us - lag(us) OVER w - 25000) AS late, lag(us) OVER w IS NOT NULL AS has FROM ticks WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)),
ranked AS (SELECT event_type, late, row_number() OVER (PARTITION BY event_type ORDER BY late) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM late WHERE has)
SELECT event_type, count(*) AS samples, CAST((2 * sum(late) + 100 * count(*)) // (200 * count(*)) AS DOUBLE) / 10 AS avg_ms,
       CAST((2 * max(late) FILTER (i = least(n - 1, floor(n * 0.95::DOUBLE))) + 100) // 200 AS DOUBLE) / 10 AS p95_ms, CAST((2 * max(late) + 100) // 200 AS DOUBLE) / 10 AS max_ms FROM ranked GROUP BY 1"""
)
def responsiveness(spark: SparkSession, d: str) -> DataFrame:
    ticks = A.table(spark, d, "events").select("event_type", "user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return order.responsiveness(order.lateness(ticks, "us", "user_id", 25_000, "event_id"), ("event_type",))
