"""Change streams: debounced sets of changed ids, bounces, retries, keyed merge, trees and results that are refined.

Each works on a streaming DataFrame with a watermark, and on a batch DataFrame with the same result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fathom.operators import hierarchy, store
from fathom.operators.buckets import BucketTable
from fathom.operators.crawl import ATTEMPTS, DELAY_MS, GROWTH, backoff_ms, retryable
from fathom.operators.held import hold
from fathom.streaming.ordered import folded

DEBOUNCE, BOUNCE = "500 milliseconds", "25 seconds"


def debounce(events: DataFrame, key: str, ts: str = "ts", quiet: str = DEBOUNCE, late: str | None = None) -> DataFrame:
    """(key, start, end, n): one row for each burst of a key's events that a quiet time ends."""
    rows = events.withWatermark(ts, late) if late and events.isStreaming else events
    bursts = rows.groupBy(key, F.session_window(ts, quiet).alias("w")).agg(F.count("*").alias("n"))
    return bursts.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


class _Bounce:
    """A tab's last open, until the tab is closed or the window is over."""

    def __init__(self, window_us: int):
        self.window_us = window_us

    def event(self, tab, state, event):
        if event["click_id"] is not None:
            return {"click_id": event["click_id"], "us": event["us"], "due": -(-(event["us"] + self.window_us) // 1000)}, []
        if state is None or event["us"] - state["us"] >= self.window_us:
            return None, []
        return None, [(state["click_id"], state["us"], event["us"])]

    def timer(self, tab, state):
        return None, []


def _told(opens: DataFrame, closes: DataFrame) -> DataFrame:
    """Opens and closes as one table (tab, ts, seq, click_id); of one moment opens come first, by their ids."""
    o = opens.select("tab", "ts", F.col("click_id").alias("seq"), "click_id")
    c = closes.select("tab", "ts", F.lit((1 << 63) - 1).alias("seq"), F.lit(None).cast("long").alias("click_id"))
    return o.unionByName(c)


def bounces(opens: DataFrame, closes: DataFrame, window: str = BOUNCE, late: str = "1 hour", span: str = "1 day") -> DataFrame:
    """(click_id, opened, closed): opens (click_id, tab, ts) whose tab is closed (tab, ts) less than `window` later.

    A close belongs to the tab's last open before it, and only the first close after an open counts. A stream keeps that
    open as the tab's state. A batch compares neighbours in time: a tab's rows are cut into spans, each with what
    the window before it holds, so that a tab with many rows is many tasks.
    """
    seconds, width = _seconds(window), _seconds(span)
    if opens.isStreaming:
        found = folded(_told(opens, closes), "tab", lambda: _Bounce(1_000_000 * seconds), "click_id long, opened long, closed long", late)
        return found.select("click_id", F.timestamp_micros("opened").alias("opened"), F.timestamp_micros("closed").alias("closed"))
    rows = _told(opens, closes).withColumn("us", F.unix_micros("ts"))
    width = max(width, seconds) * 1_000_000
    part = F.expr(f"us div {width}L")
    # a row is also told to the next part if that begins within the window after it
    rows = rows.withColumn("part", F.explode(F.array_distinct(F.array(part, F.expr(f"(us + {seconds * 1_000_000}L) div {width}L")))))
    order = Window.partitionBy("tab", "part").orderBy("us", "seq")
    near = rows.withColumns({"opened_id": F.lag("click_id").over(order), "opened": F.lag("ts").over(order), "own": F.col("part") == part})
    soon = F.col("us") - F.unix_micros("opened") < seconds * 1_000_000
    return near.where(F.col("own") & F.col("click_id").isNull() & F.col("opened_id").isNotNull() & soon).select(F.col("opened_id").alias("click_id"), "opened", F.col("ts").alias("closed"))


class _Retry:
    """Failed attempts of one id, and when the next is due."""

    def event(self, id_, state, event):
        tried = 1 + (state["tried"] if state else 0)
        if not event["again"] or tried >= ATTEMPTS:
            return None, []
        due = event["ms"] + DELAY_MS * GROWTH ** (tried - 1)
        return {"tried": tried, "seq": event["seq"], "due": due, "at": due}, []

    def timer(self, id_, state):
        return {"tried": state["tried"]}, [(id_, state["seq"], state["tried"], state["at"])]


def retries(outcomes: DataFrame, late: str = "1 hour") -> DataFrame:
    """(id, event_id, attempts, due_ms): the moments at which outcomes (id, event_id, status, detail, ts) are to be tried again.

    An outcome that may be retried is due after its back-off, unless another outcome of the id comes before that; the third in
    a row is given up. Any other outcome clears what the id had failed before. A stream keeps the attempts and a timer as the
    id's state; a batch counts runs of failures in windows over each id's outcomes.
    """
    again = F.coalesce(retryable(F.col("status"), F.col("detail")), F.lit(False))
    told = outcomes.select("id", "ts", F.col("event_id").alias("seq"), again.alias("again"))
    if outcomes.isStreaming:
        return folded(told, "id", _Retry, "id string, event_id long, attempts int, due_ms long", late)
    order = Window.partitionBy("id").orderBy("ts", "seq")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = told.withColumn("run", F.count_if(~F.col("again")).over(upto)).where("again")
    nth = F.row_number().over(Window.partitionBy("id", "run").orderBy("ts", "seq"))
    rows = rows.withColumn("attempts", ((nth - 1) % ATTEMPTS + 1).cast("int"))
    following = told.select("id", "seq", F.lead(F.unix_millis("ts")).over(order).alias("next"))
    due = F.unix_millis("ts") + backoff_ms(F.col("attempts"))
    rows = rows.where(F.col("attempts") < ATTEMPTS).join(following, ["id", "seq"]).withColumn("due_ms", due)
    return rows.where(F.col("next").isNull() | (F.col("next") >= F.col("due_ms"))).select("id", F.col("seq").alias("event_id"), "attempts", "due_ms")


def _seconds(interval: str) -> int:
    """Whole seconds of an interval such as '25 seconds' or '2 hours'."""
    n, unit = interval.split()
    return int(n) * {"second": 1, "minute": 60, "hour": 3600, "day": 86_400}[unit.rstrip("s")]


def apply_changes(table: DataFrame, changes: DataFrame) -> DataFrame:
    """table (id, ...) after changes (id, seq, op, ...): the last of each id counts; removed ids go, others are written."""
    last = changes.groupBy("id").agg(F.max_by(F.struct(*changes.columns), "seq").alias("c")).select("c.*")
    kept = table.join(last.select("id"), "id", "left_anti").select(*table.columns)
    return kept.unionByName(last.where("op <> 'removed'").select(*table.columns))


def run_cdc(changes: DataFrame, table: BucketTable, checkpoint: str) -> StreamingQuery:
    """Apply a stream of changes (id, seq, op, ...) to a table; a micro-batch writes the buckets whose rows differ.

    A batch that is run again finds its changes applied and writes nothing.
    """

    def step(batch: DataFrame, number: int) -> None:
        last = store.latest(batch, "id", "seq")
        table.apply(last.where("op <> 'removed'"), last.where("op = 'removed'"))

    return changes.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_tree_cdc(changes: DataFrame, tree: BucketTable, records: BucketTable, vectors: BucketTable | None, checkpoint: str) -> StreamingQuery:
    """Apply a stream of tree changes to a stored tree, its records and their vectors.

    Records and vectors are written before the tree: a batch that stops half-way finds the tree as it was, and does the same again.
    """

    def step(batch: DataFrame, number: int) -> None:
        delta = hold(hierarchy.apply_changes(tree.read(), batch))
        leaves = delta.where("url is not null")
        gone = leaves.where("action = 'removed'").select("id")
        own = records.read().join(leaves.select("id"), "id", "left_semi")
        records.apply(hierarchy.records_after(own, delta), gone)
        if vectors is not None:
            vectors.apply(removed=gone)
        tree.apply(delta.where("action in ('created', 'updated')"), delta.where("action = 'removed'"))

    return changes.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def activity(clicks: DataFrame) -> DataFrame:
    """(record_id, opened): the last click of each record; a maximum, so late rows do no harm."""
    return clicks.groupBy("record_id").agg(F.max("ts").alias("opened"))


def refined(results: DataFrame, key: str = "query_id", version: str = "version") -> DataFrame:
    """results (key, version, ...) of the greatest version of each key, whole: a later answer replaces all rows of an earlier.

    The maxima combine before the shuffle; they come back to the rows by a join, so a key's rows are not gathered.
    """
    newest = results.groupBy(F.col(key).alias("k")).agg(F.max(version).alias("v"))
    return results.join(newest, (F.col(key) == F.col("k")) & (F.col(version) == F.col("v"))).drop("k", "v")


def run_refined(results: DataFrame, shown: BucketTable, checkpoint: str) -> StreamingQuery:
    """Keep the newest version of each query's hits in a table (query_id, version, hits): older ones that come late are refused.

    results: (query_id, version, rank, ...), a version complete within its micro-batch; a query without hits has one row of
    null rank, so an empty answer replaces a full one too.
    """

    def step(batch: DataFrame, number: int) -> None:
        columns = [c for c in batch.columns if c not in ("query_id", "version")]
        new = refined(batch).groupBy("query_id", "version").agg(F.array_sort(F.collect_set(F.when(F.col("rank").isNotNull(), F.struct(*columns)))).alias("hits"))  # a page of hits a query
        stored = shown.read().select("query_id", F.col("version").alias("stored"))
        later = new.join(stored, "query_id", "left").where(F.col("stored").isNull() | (F.col("version") > F.col("stored")))
        shown.apply(later.drop("stored"))

    return results.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
