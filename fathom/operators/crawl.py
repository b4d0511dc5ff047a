"""Crawl queue and icons: classification, back-off, bounded concurrency and merging of outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathom.functions import url
from fathom.functions.records import SIGNALS, optional
from fathom.operators import library

#: Attempts, first delay and its growth, requests at a time.
ATTEMPTS, DELAY_MS, GROWTH, AT_ONCE, PER_HOST = 3, 30_000, 4, 6, 2
ICON_VERSION, ICON_BYTES = 3, 131_072


def fetch_status(error: Column, content_type: Column, extracted: Column, excerpt: Column, any_signal: Column) -> Column:
    page = F.coalesce(content_type.rlike(r"(?i)\btext/html\b"), F.lit(False))
    return F.when(error, "dead").when(~page, "baseline").when(extracted & (F.length(excerpt) > 0), "full").when(extracted | any_signal, "meta_only").otherwise("baseline")


def retryable(status: Column, detail: Column) -> Column:
    return (status == "dead") & F.coalesce(detail.rlike(r"\b(408|425|429|5[0-9][0-9])\b"), F.lit(False))


def backoff_ms(attempts: Column) -> Column:
    return (DELAY_MS * F.pow(F.lit(float(GROWTH)), attempts - 1)).cast("long")


def classify(outcomes: DataFrame) -> DataFrame:
    """outcomes (attempts so far, status, detail, ts) with kind (done, deferred, failed), attempts and not_before."""
    tried = F.col("attempts") + 1
    again = retryable(F.col("status"), F.col("detail"))
    kind = F.when(again & (tried < ATTEMPTS), "deferred").when(F.col("status") == "dead", "failed").otherwise("done")
    return outcomes.withColumns({"kind": kind, "tried": tried}).withColumn("not_before", F.when(F.col("kind") == "deferred", F.col("ts") + backoff_ms(F.col("tried"))))


def counts(classified: DataFrame) -> DataFrame:
    return classified.agg(*[F.count_if(F.col("kind") == k).alias(n) for k, n in (("done", "fetched"), ("failed", "failed"), ("deferred", "deferred"))])


def enqueue(queue: DataFrame, ids: DataFrame) -> DataFrame:
    """queue (id, attempts, not_before) with the ids it has not; entries that are there keep their attempts."""
    new = ids.select("id").distinct().join(queue, "id", "left_anti").select("id", F.lit(0).alias("attempts"), F.lit(None).cast("long").alias("not_before"))
    return queue.unionByName(new)


def due(queue: DataFrame, now_ms: int) -> DataFrame:
    return queue.where(F.col("not_before").isNull() | (F.col("not_before") <= now_ms))


def waves(records: DataFrame, order: str = "date_added", ranges: int = 1000) -> DataFrame:
    """(id, host, wave, slot): rounds in which no host has more than two requests.

    A wave holds a host's next two requests; slots of six within it keep the overall bound. A wave's rows are numbered in
    ranges of the order, whose counts add up, so a wave is not one task's work; a host's own rows are.
    """
    host = url.host_or_self(F.col("url"))
    placed = records.select("id", host.alias("host"), F.col(order).alias("o")).withColumn("wave", F.ceil(F.row_number().over(Window.partitionBy("host").orderBy("o", "id")) / PER_HOST).cast("long"))
    ends = records.agg(F.min(order).alias("low"), F.max(order).alias("high"))
    ranged = placed.join(F.broadcast(ends)).withColumn("part", F.floor((F.col("o") - F.col("low")) * ranges / (F.col("high") - F.col("low") + 1)).cast("int")).drop("low", "high")  # one row
    before = Window.partitionBy("wave").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # at most `ranges` rows
    base = ranged.groupBy("wave", "part").agg(F.count("*").alias("n")).select("wave", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    nth = F.row_number().over(Window.partitionBy("wave", "part").orderBy("o", "id"))
    return ranged.withColumn("nth", nth).join(base, ["wave", "part"]).select("id", "host", "wave", F.ceil((F.col("base") + F.col("nth")) / AT_ONCE).cast("long").alias("slot"))


def merge_outcome(records: DataFrame, outcomes: DataFrame) -> DataFrame:
    """records with all outcomes of their ids applied: the last status, and the last value of each signal that one had.

    A fetched title is the signal og_title, never the record's own title. Composite text and hash are made anew; where
    the hash differs from the stored one, the model version and the tag stamp go, so the record is embedded and tagged again.
    """
    when = F.struct("ts", "event_id")
    fetched = {"og_title" if c == "title" else c: F.max_by(c, F.when(F.col(c).isNotNull(), when)) for c in ("title", *SIGNALS) if c in outcomes.columns}
    last = outcomes.groupBy("id").agg(F.max_by("status", when).alias("new_status"), *[x.alias(f"new_{c}") for c, x in fetched.items()])
    rows = records if "content_hash" in records.columns else library.with_composite(records)
    both = rows.withColumnRenamed("content_hash", "old_hash").join(last, "id", "left").withColumn("status", F.coalesce("new_status", "status"))
    both = both.withColumns({c: F.coalesce(F.col(f"new_{c}"), optional(records, c, SIGNALS[c])) for c in fetched})
    made = library.with_composite(both)
    same = F.col("new_status").isNull() | F.col("content_hash").eqNullSafe(F.col("old_hash"))
    made = made.withColumns({c: F.when(same, F.col(c)) for c in ("model_version", "tag_model_version") if c in records.columns})
    return made.drop("old_hash", "new_status", *[f"new_{c}" for c in fetched])


def icon_due(icons: DataFrame, declared: DataFrame) -> DataFrame:
    """Origins to try: none stored, or without bytes and of an older version or another declared URL."""
    j = declared.join(icons, "origin", "left")
    has = F.coalesce(F.col("has_icon"), F.lit(False))
    again = F.col("has_icon").isNull() | (~has & ((F.coalesce("sync_version", F.lit(1)) < ICON_VERSION) | (F.col("declared").isNotNull() & ~F.col("declared").eqNullSafe(F.col("declared_url")))))
    return j.where(again).select("origin", "declared")


def valid_icon(content_type: Column, size: Column) -> Column:
    return F.coalesce(F.startswith(F.lower(content_type), F.lit("image/")), F.lit(False)) & (size > 0) & (size <= ICON_BYTES)
