"""Optional columns of records: signals that pages give, and learned tags. A table without one counts as having none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIGNALS = {"og_title": "string", "meta_description": "string", "site_name": "string", "headings": "array<string>", "excerpt": "string"}


def optional(records: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name) if name in records.columns else F.lit(None).cast(kind)


def all_tags(records: DataFrame) -> Column:
    """Tags, then learned ones."""
    none = F.array().cast("array<string>")
    return F.concat(F.coalesce("tags", none), F.coalesce(optional(records, "learned_tags", "array<string>"), none))
