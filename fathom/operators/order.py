"""Exact order statistics of groups by counts of value ranges, narrowed round by round: nothing is sorted whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathom.operators.held import hold

#: Ranges a group and round. A round's counts combine before their shuffle, so a group that holds most rows moves no more than others.
RANGES = 1024


def order_statistic(rows: DataFrame, value: str, share: float, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., n, total, most, at): rows with a value, their sum and greatest, and the value at index min(n - 1, floor(n * share)) of their order.

    value: a whole number; the range of a group's values must fit a long, or the job fails. Null values are left out, a
    null in `by` is a group of its own, and a group without values, like an empty table, gives no row. Each round
    cuts the range that holds the index in RANGES parts: two rounds for ranges under a million, seven at most.
    """
    if not 0 <= share <= 1:
        raise ValueError("a share is between 0 and 1")
    key = F.struct(*by) if by else F.struct(F.lit(0).alias("all"))
    own = rows.select(key.alias("g"), F.col(value).cast("long").alias("v")).where("v is not null")
    state = own.groupBy("g").agg(F.count("*").alias("n"), F.sum("v").alias("total"), F.min("v").alias("low"), F.max("v").alias("most"))
    index = F.least(F.col("n") - 1, F.floor(F.col("n") * F.lit(share)).cast("long"))
    state = hold(state.withColumns({"high": F.col("most"), "index": index}))
    while state.agg(F.max(F.col("high") - F.col("low"))).first()[0]:
        bounds = state.select("g", "low", "high", F.expr(f"(high - low) div {RANGES} + 1").alias("step"))
        inside = own.join(bounds, "g").where("v between low and high")
        counted = inside.groupBy("g", F.expr("(v - low) div step").alias("part")).agg(F.count("*").alias("c"))
        before = Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # at most RANGES rows
        counted = counted.withColumn("b", F.coalesce(F.sum("c").over(before), F.lit(0)))
        hit = state.join(bounds.select("g", "step"), "g").join(counted, "g").where("b <= index and index < b + c")
        low = F.col("low") + F.col("part") * F.col("step")
        state = hold(hit.select("g", "n", "total", "most", low.alias("low"), F.least("high", low + F.col("step") - 1).alias("high"), (F.col("index") - F.col("b")).alias("index")))
    return state.select(*[F.col(f"g.{c}").alias(c) for c in by], "n", "total", "most", F.col("low").alias("at"))


def lateness(ticks: DataFrame, us: str, of: str, tick_us: int, tie: str) -> DataFrame:
    """ticks with late_us: by how much longer than tick_us each came after the one before it of the same `of`; null for the first."""
    w = Window.partitionBy(of).orderBy(us, tie)
    return ticks.withColumn("late_us", F.when(F.lag(us).over(w).isNotNull(), F.greatest(F.lit(0), F.col(us) - F.lag(us).over(w) - tick_us)))


def responsiveness(rows: DataFrame, by: tuple[str, ...] = (), late: str = "late_us") -> DataFrame:
    """(by..., samples, avg_ms, p95_ms, max_ms) of microseconds of lateness; to a tenth, halves up."""
    tenths = lambda us, n="1": F.expr(f"(2 * {us} + 100 * {n}) div (200 * {n})") / 10.0
    found = order_statistic(rows, late, 0.95, by)
    return found.select(*by, F.col("n").alias("samples"), tenths("total", "n").alias("avg_ms"), tenths("at").alias("p95_ms"), tenths("most").alias("max_ms"))
