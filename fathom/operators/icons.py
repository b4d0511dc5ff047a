"""Icons of origins: which to try, an ordered fallback with the first success kept, misses remembered.

An origin is one row, whatever its records, so it is tried once over all partitions; a task that is lost and run
again may ask again, but its origin still gets one row. A miss is a row without bytes, tried again only under a newer strategy or when
its pages declare another icon.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.functions import page, url
from fathom.functions.records import optional
from fathom.operators.buckets import BucketTable
from fathom.operators.crawl import ICON_BYTES, ICON_VERSION, icon_due
from fathom.operators.held import hold
from fathom.sources import http

Transport = Callable[[str], tuple[int, str, bytes]]
ICONS = "origin string, bytes binary, content_type string, has_icon boolean, sync_version int, declared_url string"


def _get(address: str) -> tuple[int, str, bytes]:
    return http.get(address, http.ICON_SECONDS, http.PAGE_BYTES)


def origins(records: DataFrame) -> DataFrame:
    """(origin, declared): every http(s) origin of records, with the icon that its first record with one declares.

    Records are in the order of date_added, then id. Those of other schemes and without a URL have no origin.
    """
    address = F.coalesce(F.nullif("canonical_url", F.lit("")), F.col("url")) if "canonical_url" in records.columns else F.col("url")
    rows = records.select(url.origin(address).alias("origin"), F.nullif(optional(records, "icon_url"), F.lit("")).alias("icon"), F.struct("date_added", "id").alias("nth"))
    return rows.where("origin is not null").groupBy("origin").agg(F.min_by("icon", F.when(F.col("icon").isNotNull(), F.col("nth"))).alias("declared"))


class _Attempt:
    """One origin's requests, in order."""

    def __init__(self, origin: str, declared: str | None, transport: Transport):
        self.origin, self.declared, self.transport = origin, declared, transport
        self.asked: list[str] = []
        self.discovered: str | None = None

    def _ask(self, address: str) -> tuple[str, bytes] | None:
        self.asked.append(address)
        try:
            status, kind, body = self.transport(address)
        except Exception:  # noqa: BLE001  any failure of a request is a miss
            return None
        return (kind or "", body) if 200 <= status < 300 else None

    def _peek(self) -> str | None:
        """The icon that the origin's root page declares."""
        found = self._ask(f"{self.origin}/")
        if found is None or not re.search(r"\btext/html\b", found[0], re.I):
            return None
        return page.best_icon_of(page.links_of(found[1][: http.PAGE_BYTES].decode("utf-8", "replace")), f"{self.origin}/")

    def _places(self) -> Iterator[tuple[str, str]]:
        if self.declared:
            yield "declared", self.declared
        yield "root", f"{self.origin}/favicon.ico"
        self.discovered = self._peek()
        if self.discovered and self.discovered != self.declared:
            yield "page", self.discovered

    def row(self) -> tuple:
        for via, address in self._places():
            found = self._ask(address)
            if found and found[0].lower().startswith("image/") and 0 < len(found[1]) <= ICON_BYTES:
                return self.origin, found[1], found[0], True, ICON_VERSION, self.declared or self.discovered or "", via, self.asked
        return self.origin, b"", "", False, ICON_VERSION, self.declared or self.discovered or "", "none", self.asked


def capture(wanted: DataFrame, transport: Transport = _get, parallel: int | None = None) -> DataFrame:
    """A row of ICONS for each origin of wanted (origin, declared), with `via`, where it was found, and `asked`, every address in order.

    The declared icon comes first, then /favicon.ico, then what the root page declares. parallel: how many partitions ask at once,
    each one address at a time.
    """

    def run(batches):
        for pdf in batches:
            declared = pdf["declared"].astype(object).where(pdf["declared"].notna(), None)
            rows = [_Attempt(o, d, transport).row() for o, d in zip(pdf["origin"], declared)]
            yield pd.DataFrame(rows, columns=["origin", "bytes", "content_type", "has_icon", "sync_version", "declared_url", "via", "asked"])

    dealt = wanted.select("origin", "declared").repartition(*([parallel] if parallel else []), "origin")
    return dealt.mapInPandas(run, f"{ICONS}, via string, asked array<string>")


def sync(records: DataFrame, stored: BucketTable, transport: Transport = _get, rounds: int = 1, parallel: int | None = None) -> dict[str, int]:
    """Try every origin that is due and store what came; returns how many were fetched and are missing.

    rounds: the origins are written in so many parts, by a hash, so a run that is killed keeps those that are done.
    """
    due = hold(icon_due(stored.read(), origins(records)))
    counts = {"fetched": 0, "missing": 0}
    for n in range(rounds):
        made = hold(capture(due.where(F.pmod(F.xxhash64("origin"), F.lit(rounds)) == n), transport, parallel))
        stored.apply(made)
        found = made.agg(F.count_if("has_icon").alias("fetched"), F.count_if(~F.col("has_icon")).alias("missing")).first()
        counts = {k: v + found[k] for k, v in counts.items()}
    return counts


def stats(icons: DataFrame) -> DataFrame:
    """One row: origins tried, with an icon, without one."""
    return icons.agg(F.count("*").alias("total"), F.count_if("has_icon").alias("has_bytes"), F.count_if(~F.col("has_icon")).alias("negative"))
