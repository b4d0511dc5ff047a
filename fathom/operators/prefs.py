"""Preferences: what a message may say, and what is read where nothing is stored."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Prefs:
    """crawl_enabled: whether pages and icons may be fetched; excluded: folders that stay out with all below them."""

    crawl_enabled: bool = True
    excluded: tuple[str, ...] = ()

    @classmethod
    def of(cls, given: dict | None) -> Prefs:
        """From a message (crawlEnabled, excludedFolderIds): only false switches crawling off, only strings are folders."""
        given = given or {}
        folders = given.get("excludedFolderIds")
        return cls(given.get("crawlEnabled") is not False, tuple(x for x in folders if isinstance(x, str)) if isinstance(folders, list) else ())


def sanitized(message: Column) -> Column:
    """The same on a column of JSON texts: a struct (crawl_enabled, excluded). Null, or what is no JSON object, gives the defaults."""
    v = F.try_parse_json(message)
    kind = lambda x: F.schema_of_variant(x)
    crawl = F.try_variant_get(v, "$.crawlEnabled", "variant")
    off = (kind(crawl) == "BOOLEAN") & (F.try_variant_get(crawl, "$", "boolean") == F.lit(False))
    listed = F.try_variant_get(v, "$.excludedFolderIds", "array<variant>")
    folders = F.transform(F.filter(listed, lambda x: F.coalesce(kind(x) == "STRING", F.lit(False))), lambda x: F.try_variant_get(x, "$", "string"))
    return F.struct((~F.coalesce(off, F.lit(False))).alias("crawl_enabled"), F.coalesce(folders, F.array().cast("array<string>")).alias("excluded"))
