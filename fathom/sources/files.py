"""File sources: browser profile trees, golden queries and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.operators.held import hold

ROOTS = ("bookmark_bar", "other", "synced")
_NODE = "struct<id: string, name: string, type: string, url: string, children: array<string>>"


def profile_tree(spark: SparkSession, path: str) -> DataFrame:
    """nodes (id, parent_id, title, url) of a browser profile's JSON file; roots without children are skipped.

    A level's children are kept as JSON text and parsed as the next level, so a tree may have any depth.
    """
    raw = spark.read.text(path, wholetext=True)
    roots = F.from_json("value", f"struct<roots: struct<{', '.join(f'{r}: {_NODE}' for r in ROOTS)}>>")["roots"]
    level = raw.select(F.explode(F.array(*[roots[r] for r in ROOTS])).alias("n")).where("size(n.children) > 0").select("n", F.lit("0").alias("parent_id"))
    out = spark.createDataFrame([("0", None, "", None)], "id string, parent_id string, title string, url string")
    while True:
        level = hold(level)
        if level.isEmpty():
            return out.where("id is not null")
        out = out.unionByName(level.select("n.id", "parent_id", F.col("n.name").alias("title"), "n.url"))
        level = level.select(F.col("n.id").alias("parent_id"), F.explode("n.children").alias("c")).select(F.from_json("c", _NODE).alias("n"), "parent_id")


def goldens(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, text, expect, k, min_hit_rate) of a JSON file of golden queries."""
    schema = "minHitRate double, queries array<struct<query: string, expect: array<string>, k: int, note: string>>"
    raw = spark.read.schema(schema).json(path, multiLine=True)
    return raw.select(F.posexplode("queries").alias("query_id", "q"), F.col("minHitRate").alias("min_hit_rate")).select(F.col("query_id").cast("long").alias("query_id"), F.col("q.query").alias("text"), "q.expect", F.coalesce("q.k", F.lit(5)).alias("k"), "min_hit_rate")
