"""Event operators: call summaries, sessions, windows, rate limits, ordered assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sessions(events: DataFrame, key: str, ts: str, gap_minutes: int) -> DataFrame:
    """One row per session: key, session (from 1), start, end, n. A session ends when nothing happens for the gap."""
    over = Window.partitionBy(key).orderBy(ts, "event_id")
    last = F.lag(ts).over(over)
    new = (last.isNull() | (F.col(ts) > F.expr(f"timestampadd(MINUTE, {int(gap_minutes)}, __last)"))).cast("int")
    rows = events.withColumn("__last", last).withColumn("__new", new)
    rows = rows.withColumn("session", F.sum("__new").over(over.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(key, "session").agg(F.min(ts).alias("start"), F.max(ts).alias("end"), F.count("*").alias("n"))


def call_summary(calls: DataFrame, *keys: str | Column) -> DataFrame:
    """Counts, errors and values by keys."""
    failed = F.col("event_type") == "error"
    return calls.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_if(failed).alias("errors"), F.round(F.avg("value"), 4).alias("mean"), F.round(F.sum("value"), 3).alias("total"), F.min("ts").alias("first"), F.max("ts").alias("last")
    )


def token_bucket(events: DataFrame, key: str, rate_per_s: float, burst: float) -> DataFrame:
    """(key, n, allowed): a bucket per key refills with time up to `burst`; an event passes if it finds a token.

    The fold is sequential within a key, over time stamps alone.
    """
    item = F.struct(F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), F.col("event_id"))
    start = F.struct(F.lit(None).cast("bigint").alias("t"), F.lit(float(burst)).alias("level"), F.lit(0).alias("allowed"))

    def step(acc: Column, x: Column) -> Column:
        level = F.least(F.lit(float(burst)), acc["level"] + F.coalesce((x["t"] - acc["t"]) / 1e6 * rate_per_s, F.lit(0.0)))
        passes = level >= 1.0
        return F.struct(x["t"].alias("t"), F.when(passes, level - 1.0).otherwise(level).alias("level"), (acc["allowed"] + passes.cast("int")).alias("allowed"))

    rows = events.groupBy(key).agg(F.sort_array(F.collect_list(item)).alias("items"))
    return rows.select(key, F.size("items").alias("n"), F.aggregate("items", start, step)["allowed"].alias("allowed"))


def tumbling(events: DataFrame, ts: str, width: str, *keys: str) -> DataFrame:
    rows = events.groupBy(F.window(ts, width).alias("w"), *keys).agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total"))
    return rows.select(F.col("w.start").alias("window_start"), *keys, "n", "total")


def sliding(events: DataFrame, ts: str, width: str, slide: str, *keys: str) -> DataFrame:
    rows = events.groupBy(F.window(ts, width, slide).alias("w"), *keys).agg(F.count("*").alias("n"))
    return rows.select(F.col("w.start").alias("window_start"), *keys, "n")


def as_of(left: DataFrame, right: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """Each left row with the latest right `value` of its key at or before it: one union, one window, no range join."""
    both = left.select(key, ts, F.col("event_id"), F.lit(1).alias("side"), F.lit(None).cast(dict(right.dtypes)[value]).alias("v"))
    both = both.unionByName(right.select(key, ts, F.lit(None).cast("bigint").alias("event_id"), F.lit(0).alias("side"), F.col(value).alias("v")))
    over = Window.partitionBy(key).orderBy(ts, "side", F.asc_nulls_first("event_id"), F.asc_nulls_first("v")).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("as_of", F.last("v", ignorenulls=True).over(over)).where("side = 1").select("event_id", "as_of")
