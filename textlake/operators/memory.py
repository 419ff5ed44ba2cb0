"""Message and memory operators: budgets, noise, typing, importance, decay, expiry, merging, last write wins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textlake.functions import scoring as S
from textlake.functions import text as T

# Decay in days, days to live and the importance that keeps a memory, by type.
DECAY = {"Entity": 90, "Archival": 60, "Summary": 14, "Working": 7, "System": 3650}
LIFE = {"Entity": 180, "Archival": 90, "Summary": 30, "Working": 7}
FLOOR = {"System": 0.90, "Entity": 0.60, "Archival": 0.40, "Summary": 0.30, "Working": 0.30}


def _by_type(kind: Column, values: dict, default: float | None) -> Column:
    out = F.lit(default)
    for k, v in values.items():
        out = F.when(kind == k, F.lit(v)).otherwise(out)
    return out


def fits_budget(messages: DataFrame, key: str, order: Sequence[Column], tokens: Column, budget: int) -> DataFrame:
    """The first messages of each key, in an order, whose running total stays within the budget: ends at the first overflow."""
    total = F.sum(tokens).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return messages.withColumn("running", total).where(F.col("running") <= budget)


def fits_budget_skipping(messages: DataFrame, key: str, order: Sequence[str], tokens: Column, budget: int, ident: str) -> DataFrame:
    """(key, kept): as `fits_budget`, but a message that doesn't fit is skipped and later, smaller ones may still fit. The
    fold is sequential in each key, over (order, tokens, id) only."""
    item = F.struct(*[F.col(c) for c in order], tokens.cast("bigint").alias("__t"), F.col(ident).alias("__id"))
    start = F.struct(F.lit(0).cast("bigint").alias("used"), F.array().cast("array<bigint>").alias("kept"))

    def step(acc: Column, x: Column) -> Column:
        fits = acc["used"] + x["__t"] <= budget
        return F.struct(
            F.when(fits, acc["used"] + x["__t"]).otherwise(acc["used"]).alias("used"),
            F.when(fits, F.array_append(acc["kept"], x["__id"])).otherwise(acc["kept"]).alias("kept"),
        )

    rows = messages.groupBy(key).agg(F.sort_array(F.collect_list(item)).alias("items"))
    return rows.select(key, F.aggregate("items", start, step).alias("fold")).select(key, F.col("fold.kept").alias("kept"), F.col("fold.used").alias("used"))


def history(messages: DataFrame, key: str, turn: str, always: Column, tokens: Column, budget: int) -> DataFrame:
    """Messages that are always kept, then the newest others until the budget overflows."""
    rows = messages.withColumns({"__always": always, "__tokens": tokens})
    fixed = F.sum(F.when(F.col("__always"), F.col("__tokens")).otherwise(0)).over(Window.partitionBy(key))
    newest = Window.partitionBy(key, "__always").orderBy(F.desc(turn)).rowsBetween(Window.unboundedPreceding, 0)
    used = F.when(F.col("__always"), F.lit(0)).otherwise(fixed + F.sum("__tokens").over(newest))
    return rows.withColumn("__used", used).where(F.col("__always") | (F.col("__used") <= budget)).drop("__always", "__tokens", "__used")


def is_noise(text: Column) -> Column:
    """Messages that are not worth remembering."""
    return F.coalesce(text, F.lit("")).rlike(r"^\s*$|^(?i)(ok|okay|thanks|thank you|hi|hello|好的|谢谢|你好|嗯+)[.!。！]?\s*$|^.{0,2}$|^[\d\s.,]+$|^[!?.。！？…]+$")


def memory_type(role: Column, text: Column) -> Column:
    """Rules in order: constraints, then work in progress, then entities, then archives, else by role."""
    rules = {"System": ("must", "never", "必须", "禁止"), "Working": ("now", "current", "现在", "正在"), "Entity": (" is ", "name", "是"), "Archival": ("licens", "chapter", "原文")}
    return F.coalesce(T.first_match(text, rules, None), F.when(role == "user", "Working").when(role == "system", "System").otherwise("Summary"))


def importance(kind: Column, role: Column, text: Column) -> Column:
    base = _by_type(kind, {"System": 0.95, "Entity": 0.7, "Archival": 0.6, "Summary": 0.5, "Working": 0.4}, 0.5)
    more = F.when(role == "user", 0.1).otherwise(0.0) + F.when(text.rlike("(?i)important|remember|重要|记住"), 0.15).otherwise(0.0)
    return F.round(S.clamped(base + more, 0.0, 1.0), 2)


def scored(memories: DataFrame, now: Column, relevance: Column) -> DataFrame:
    """`memories` with days, recency and score; access falls back to creation."""
    seen = F.coalesce("last_accessed_at", "created_at")
    rows = memories.withColumn("days", S.days_between(seen, now))
    rows = rows.withColumn("recency", S.recency(F.col("days"), _by_type(F.col("memory_type"), DECAY, 60)))
    return rows.withColumn("score", F.round(S.memory_score(relevance, F.col("importance"), F.col("recency")), 6))


def expired(kind: Column, importance_: Column, days: Column) -> Column:
    life, floor = _by_type(kind, LIFE, None), _by_type(kind, FLOOR, 1.0)
    return F.when((kind == "System") | (importance_ >= floor) | life.isNull(), False).otherwise(days > life)


def last_write_wins(old: DataFrame, new: DataFrame, key: Sequence[str], keep_if_null: Sequence[str] = ()) -> DataFrame:
    """Upsert: rows of `new` replace those of `old`; columns of `keep_if_null` keep their old value where the new is null."""
    a, b = old.alias("a"), new.withColumn("__new", F.lit(True)).alias("b")
    joined, present = a.join(b, list(key), "full_outer"), F.col("__new").isNotNull()
    rest = [c for c in old.columns if c not in key]
    pick = [
        (F.coalesce(F.col(f"b.{c}"), F.col(f"a.{c}")) if c in keep_if_null else F.when(present, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}"))).alias(c) for c in rest
    ]
    return joined.select(*key, *pick)


def insert_if_absent(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    return old.unionByName(new.join(old.select(*key), list(key), "left_anti"))


def replace_scope(old: DataFrame, new: DataFrame, scope: Sequence[str], key: str, protected: Column) -> DataFrame:
    """Save `new`: rows of `old` in a touched scope go unless protected; a new row may not take a protected row's id."""
    keep = old.where(protected)
    rest = old.where(~protected).join(new.select(*scope).distinct(), list(scope), "left_anti").join(new.select(key), key, "left_anti")
    return keep.unionByName(rest).unionByName(new.join(keep.select(key), key, "left_anti"))
