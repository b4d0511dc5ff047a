"""URL functions on columns. A URL that does not parse gives the documented fallback, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fathom.functions.tables import TRACKING_PARAMS, URL_STOP_TOKENS
from fathom.functions.text import trim

_TRACKS = "(?i)^(utm_.*|" + "|".join(TRACKING_PARAMS) + ")$"


def host(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def domain(url: Column) -> Column:
    """Host without a leading www., empty for what does not parse."""
    return F.coalesce(F.regexp_replace(host(url), r"^www\.", ""), F.lit(""))


def host_or_self(url: Column) -> Column:
    return F.coalesce(host(url), url)


def registrable(name: Column) -> Column:
    return F.substring_index(name, ".", -2)


def origin(url: Column) -> Column:
    """Scheme and authority of http(s) URLs, else null."""
    scheme = F.lower(F.try_parse_url(url, F.lit("PROTOCOL")))
    return F.when(scheme.isin("http", "https"), F.concat(scheme, F.lit("://"), F.lower(F.try_parse_url(url, F.lit("AUTHORITY")))))


def canonical(url: Column) -> Column:
    """Lower-case host without www., no fragment or tracking parameters, the rest sorted by key, no trailing slash."""
    part = lambda what: F.try_parse_url(url, F.lit(what))
    scheme, name, path, query = F.lower(part("PROTOCOL")), part("HOST"), part("PATH"), part("QUERY")
    authority = F.concat(F.regexp_replace(F.lower(name), r"^www\.", ""), F.coalesce(F.regexp_extract(part("AUTHORITY"), r"(:[0-9]+)$", 1), F.lit("")))
    authority = F.regexp_replace(authority, r"(?<=.):(80|443)$", "")
    pairs = F.filter(F.split(F.coalesce(query, F.lit("")), "&"), lambda p: (p != "") & ~F.substring_index(p, "=", 1).rlike(_TRACKS))
    keyed = F.transform(pairs, lambda p, i: F.struct(F.substring_index(p, "=", 1).alias("k"), i.alias("i"), F.when(F.contains(p, F.lit("=")), p).otherwise(F.concat(p, F.lit("="))).alias("p")))
    kept = F.array_join(F.transform(F.array_sort(keyed), lambda x: x["p"]), "&")
    clean = F.when(F.coalesce(path, F.lit("")) == "", F.lit("/")).when((F.length(path) > 1) & F.endswith(path, F.lit("/")), F.left(path, F.length(path) - 1)).otherwise(path)
    made = F.concat(scheme, F.lit("://"), authority, clean, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))
    return F.when(name.isNull(), trim(url)).otherwise(made)


def tokens(url: Column) -> Column:
    """Topical words of host and path: no stop labels, numbers, hashes or generated ids."""
    raw = F.split(F.lower(F.concat(F.coalesce(host(url), F.lit("")), F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")))), r"[/\-_.]+")
    stop = F.array(*[F.lit(x) for x in URL_STOP_TOKENS])

    def topical(x):
        return (x != "") & ~F.array_contains(stop, x) & ~x.rlike("^[0-9]+$") & ~((F.length(x) >= 8) & x.rlike("^[0-9a-f]+$")) & ~((F.length(x) >= 10) & x.rlike("[0-9]"))

    return F.array_distinct(F.filter(raw, topical))
