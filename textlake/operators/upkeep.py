"""Upkeep of memories and messages: similar ones merged, clean-up with a log, extraction, profiles, pressure, context limits,
pending writes, snapshots, deltas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merged_memories(memories: DataFrame, pairs: DataFrame) -> DataFrame:
    """The merged memory of each pair (a, b): texts joined by '; ', the greater importance, confidence 0.7."""
    one = memories.select(F.col("id").alias("a"), F.col("text").alias("ta"), F.col("importance").alias("ia"))
    two = memories.select(F.col("id").alias("b"), F.col("text").alias("tb"), F.col("importance").alias("ib"))
    met = pairs.join(one, "a").join(two, "b")
    return met.select("a", "b", F.concat("ta", F.lit("; "), "tb").alias("text"), F.greatest("ia", "ib").alias("importance"), F.lit(0.7).alias("confidence"))


def cleaned(memories: DataFrame, gone: Column, batch: int) -> tuple[DataFrame, DataFrame]:
    """`memories` with status 'tombstone' where `gone` holds, and the log of what changed (batch, id, old and new status)."""
    marked = memories.withColumn("new_status", F.when(gone, "tombstone").otherwise(F.col("status")))
    log = marked.where("new_status <> status").select(F.lit(batch).alias("batch"), "id", F.col("status").alias("old_status"), "new_status")
    return marked.drop("status").withColumnRenamed("new_status", "status"), log


def touched(memories: DataFrame, read: DataFrame) -> DataFrame:
    """`memories` with the reads (id, at) counted and the last one remembered."""
    seen = read.groupBy("id").agg(F.count("*").alias("reads"), F.max("at").alias("last_read"))
    return memories.join(seen, "id", "left").withColumn("reads", F.coalesce("reads", F.lit(0)))


def extracted(messages: DataFrame, noise: Column, kind: Column, importance: Column, roles: Sequence[str], least: int = 10) -> DataFrame:
    """Messages worth remembering, once for each text: of the right role, no noise, long enough."""
    rows = messages.where(F.col("role").isin(*roles) & ~noise & (F.length("text") >= least)).withColumns({"kind": kind, "importance": importance})
    first = rows.groupBy("text").agg(F.min(F.struct("conv_id", "turn", "kind", "importance")).alias("m"))  # combined before the shuffle
    return first.select("m.*", "text")


def pressure(messages: DataFrame, key: str, order: str, tokens: Column, cap: int, warn: float = 0.7) -> DataFrame:
    """Per key the share of the token cap that its messages fill, and the first message at which it passes `warn`."""
    rows = messages.withColumn("used", F.sum(tokens).over(Window.partitionBy(key).orderBy(order)))
    share = F.round(F.max("used") / cap, 4)
    return rows.groupBy(key).agg(share.alias("ratio"), F.min(F.when(F.col("used") > cap * warn, F.col(order))).alias("warned_at"))


def kept_after_eviction(messages: DataFrame, key: str, order: str, tokens: Column, cap: int) -> DataFrame:
    """Per key how many of the oldest messages go so that the rest fits the cap, and how many stay (the batch form of a
    buffer that evicts the oldest)."""
    back = F.sum(tokens).over(Window.partitionBy(key).orderBy(F.desc(order)))
    return messages.withColumn("back", back).groupBy(key).agg(F.count_if(F.col("back") > cap).alias("evicted"), F.count_if(F.col("back") <= cap).alias("kept"))


def shifted_cursor(cursor: Column, evicted: Column, kept: Column) -> Column:
    """A cursor into a buffer after evictions, within what is left."""
    return F.greatest(F.lit(0), F.least(cursor - evicted, kept))


def guarded_context(messages: DataFrame, key: str, order: str, tool: Column, protected: Column, threshold: int, head: int = 800, tail: int = 200) -> DataFrame:
    """Where a conversation's characters pass the threshold, all but its last two tool results are cut to head and tail."""
    total = F.sum(F.length("text")).over(Window.partitionBy(key))
    back = F.row_number().over(Window.partitionBy(key, tool).orderBy(F.desc(order)))
    cut = (F.col("__total") > threshold) & tool & ~protected & (F.col("__back") > 2) & (F.length("text") > head + tail)
    short = F.concat(F.substring("text", 1, head), F.lit("…"), F.substring("text", -tail, tail))
    rows = messages.withColumns({"__total": total, "__back": back})
    return rows.withColumn("shown", F.when(cut, short).otherwise(F.col("text"))).drop("__total", "__back")


def pending(rows: DataFrame, written: DataFrame, key: str) -> DataFrame:
    """Rows whose second write is missing."""
    return rows.join(written.select(key).distinct(), key, "left_anti")


def compared(old: DataFrame, new: DataFrame, key: str, value: str, minor: float = 0.01) -> DataFrame:
    """Two snapshots (one row per key) field by field: added, removed, changed (major beyond ten times `minor`)."""
    both = old.select(key, F.col(value).alias("was")).join(new.select(key, F.col(value).alias("now")), key, "full")
    delta = F.abs(F.col("now") - F.col("was"))
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(delta > 10 * minor, "major").when(delta > minor, "minor").otherwise("same")
    return both.withColumn("change", change)


def assembled(deltas: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """Streamed pieces put together: the last name given, all arguments in order."""
    last = F.max_by("name", F.when(F.col("name").isNotNull(), F.col(order)))
    pieces = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, "piece"))), lambda x: F.coalesce(x["piece"], F.lit(""))), "")
    return deltas.groupBy(*key).agg(last.alias("name"), pieces.alias("arguments"))
