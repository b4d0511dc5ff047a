"""Keyed tables on immutable files: merge, delete, retention and staleness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def upsert(table: DataFrame, changes: DataFrame, key: str = "id", seq: str | None = None) -> DataFrame:
    """table with the rows of changes in place of those of the same key; whole rows.

    Of changes that repeat a key the one of greatest seq stays, which is left out of the table unless it has that column;
    without seq, and among equal ones, the greatest row.
    """
    row = F.struct(*table.columns)
    changes = changes.groupBy(key).agg((F.max(row) if seq is None else F.max(F.struct(F.col(seq).alias("at"), row.alias("row")))["row"]).alias("r")).select("r.*")
    return table.join(changes.select(key), key, "left_anti").select(*table.columns).unionByName(changes)


def latest(rows: DataFrame, key: str, seq: str) -> DataFrame:
    """The row of greatest seq of each key, by aggregation: partial maxima before the shuffle, no sort."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), seq).alias("r")).select("r.*")


def delete(table: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    return table.join(keys.select(key), key, "left_anti")


def newest(rows: DataFrame, key: str, most: int = 2000) -> DataFrame:
    """The `most` rows of greatest key: a sort with a limit, not a window over all rows."""
    return rows.orderBy(F.desc(key)).limit(most)


def mark_unsatisfying(clicks: DataFrame, bounced: DataFrame) -> DataFrame:
    """clicks with sat = false where bounced (click_id) names them."""
    hit = bounced.select("click_id", F.lit(True).alias("bounced")).distinct()
    return clicks.join(hit, "click_id", "left").withColumn("sat", F.col("sat") & F.col("bounced").isNull()).drop("bounced")


def stale(version: Column, current: str, text: Column) -> Column:
    """Whether a row still has to be embedded or tagged under the current version."""
    return ~version.eqNullSafe(F.lit(current)) & (F.length(text) > 0)


def load_vectors(vectors: DataFrame, model_version: str) -> DataFrame:
    """Vectors of one model version, which have one length: any other raises with the id."""
    rows = vectors.where(F.col("model_version") == model_version)
    first = rows.agg(F.min(F.size("vector")).alias("dim"))
    bad = F.concat(F.lit("vector "), F.col("id"), F.lit(" has another length"))
    return rows.join(F.broadcast(first)).where(F.when(F.size("vector") == F.col("dim"), True).otherwise(F.raise_error(bad).cast("boolean"))).drop("dim")  # one row


def upsert_vectors(table: DataFrame, changes: DataFrame, model_version: str, dim: int) -> DataFrame:
    """table with the vectors of changes in place of those of the same id; one of another model or length raises with its id."""
    wrong = F.raise_error(F.concat(F.lit("vector "), F.col("id"), F.lit(" is of another model or length"))).cast("boolean")
    fits = (F.col("model_version") == model_version) & (F.size("vector") == dim)
    return upsert(table, changes.where(F.when(fits, True).otherwise(wrong)))


def current_vectors(records: DataFrame, vectors: DataFrame, model_version: str) -> DataFrame:
    """records with their vector of one model version; those without one are left out."""
    return records.join(vectors.where(F.col("model_version") == model_version).select("id", "vector"), "id")


def write_snapshot(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def truncate(spark: SparkSession, path: str) -> None:
    """Leave an empty table of the same schema."""
    write_snapshot(spark.createDataFrame([], spark.read.parquet(path).schema), path)
