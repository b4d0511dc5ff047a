"""Page and icon fetching as a partition-wise operator; the transport is injected, so tests need no network."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame

#: Time limits in seconds, most bytes of a page.
PAGE_SECONDS, ICON_SECONDS, PAGE_BYTES = 12, 8, 1_500_000


def get(url: str, seconds: float = PAGE_SECONDS, most: int = PAGE_BYTES) -> tuple[int, str, bytes]:
    """(status, content type, body up to `most` bytes) over HTTP, redirects followed."""
    from urllib.request import Request, urlopen

    with urlopen(Request(url, headers={"Accept": "text/html,application/xhtml+xml"}), timeout=seconds) as r:
        return r.status, r.headers.get("Content-Type", ""), r.read(most)


def fetch(rows: DataFrame, transport: Callable[[str], tuple[int, str, bytes]] = get) -> DataFrame:
    """(id, http_status, content_type, body, detail) of rows (id, url). A failed request is a row with a detail.

    rows come partitioned by host (see crawl.waves), and a partition asks one page at a time.
    """

    def run(batches):
        for pdf in batches:
            out = []
            for i, u in zip(pdf["id"], pdf["url"]):
                try:
                    status, kind, body = transport(u)
                    ok = 200 <= status < 300
                    out.append((i, status, kind, body.decode("utf-8", "replace") if ok else None, None if ok else f"HTTP {status}"))
                except Exception as e:  # noqa: BLE001  any failure of a request is an outcome
                    out.append((i, None, None, None, str(getattr(e, "code", None) and f"HTTP {e.code}" or e)))
            yield pd.DataFrame(out, columns=["id", "http_status", "content_type", "body", "detail"]).astype({"http_status": "Int32"})

    return rows.select("id", "url").mapInPandas(run, "id string, http_status int, content_type string, body string, detail string")
