"""Mixing sources to target weights by temperature.

With p the sources' shares of all tokens, the weights are p^a / sum(p^a); the exponent a in [0, 1] is found by bisection:
the smallest that keeps the most repeated source within `repeat` times the least repeated one, or the one whose weights
have a target entropy. A budget of tokens times the weights gives each source's tokens; without a budget, the smallest
one under which every source is read at least once, so that no document is lost.

The weights are realised as blocks: a source's documents stand in the order of a seeded hash, end to end, epoch after
epoch, and each block takes an equal stretch of every source; within a block, documents follow another hash, anew for
each epoch. Stretches are measured with a table of token sums over (source, hash bucket): BUCKETS rows over all sources,
whatever the number of documents, so it is broadcast; inside a bucket a document's place is interpolated by its hash, so
a source's tokens in a block are off by one bucket at most. Every row then knows its blocks by itself: there is one
map-side combined aggregation and, for `mix`, one shuffle by block. Where there are more than BUCKETS sources, their table (one
bucket each) is joined by shuffle instead, spread for sources with many rows. Nothing about sources passes through the driver
but the sums that the bisection compares.

Defined cases
    null source: a source of its own.        null or empty text: one token (as for any text without a word).
    null or repeated doc_id: the place depends on id and text, so such rows spread over the blocks.
    repeated rows: each is drawn, all in the same blocks.
    empty table: empty result.       extra columns: ignored by `schedule`, kept by `mix`, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textlake.llm.common import attach, own_prefix, stored

#: Rows of the broadcast table at most (below 64 bytes a row: 8 MB); a table of more sources is joined by shuffle.
BUCKETS = 1 << 17
#: A source is repeated this many times as often as any other, at most; tokens of a block; exponents tried in one pass.
REPEAT, BLOCK_TOKENS, TRIED = 2.0, 1 << 20, 31


def tempered(tokens: Sequence[float], exponent: float) -> list[float]:
    """Weights p^exponent, normalised."""
    total = sum(tokens)
    raised = [(t / total) ** exponent for t in tokens]
    return [x / sum(raised) for x in raised]


def entropy(weights: Sequence[float]) -> float:
    return -sum(w * math.log(w) for w in weights if w > 0)


def repetition(tokens: Sequence[float], weights: Sequence[float]) -> float:
    """How many times as often the most repeated source is read as the least repeated one."""
    each = [w / t for w, t in zip(weights, tokens, strict=True)]
    return max(each) / min(each)


def bisect(flat_enough: Callable[[Sequence[float]], Sequence[bool]], tried: int = 1) -> float:
    """The least exponent in [0, 1] from which on `flat_enough` holds; `tried` exponents at a time cut the interval."""
    low, high = 0.0, 1.0
    if flat_enough([low])[0]:
        return low
    for _ in range(math.ceil(60 / math.log2(tried + 1))):
        points = [low + (high - low) * (i + 1) / (tried + 1) for i in range(tried)]
        fine = [*flat_enough(points), True]
        first = fine.index(True)
        low, high = ([low, *points][first], [*points, high][first])
    return high


def solve(tokens: Sequence[float], repeat: float | None = REPEAT, target_entropy: float | None = None) -> tuple[float, list[float]]:
    """(exponent, weights). Exponent 1 keeps the sources' own shares, 0 makes all sources equal."""

    def flat_enough(exponents: Sequence[float]) -> list[bool]:
        each = [tempered(tokens, a) for a in exponents]
        return [entropy(w) <= target_entropy if target_entropy is not None else repetition(tokens, w) <= (repeat or 1.0) for w in each]

    a = bisect(flat_enough)
    return a, tempered(tokens, a)


def solve_table(totals: DataFrame, repeat: float | None = REPEAT, target_entropy: float | None = None) -> float:
    """The exponent for a table of sources (column n: tokens), by aggregates of it."""
    total, least, most = totals.agg(F.sum("n"), F.min("n"), F.max("n")).first()
    if total is None:
        return 1.0
    if target_entropy is None:  # of two sources, the rarer is repeated (n_most / n_least)^(1 - a) times as often
        return bisect(lambda exponents: [(most / least) ** (1 - a) <= (repeat or 1.0) for a in exponents])
    share = F.col("n") / F.lit(float(total))

    def flat_enough(exponents: Sequence[float]) -> list[bool]:
        sums = [x for a in exponents for x in (F.sum(F.pow(share, F.lit(a))), F.sum(F.pow(share, F.lit(a)) * F.log(share)))]
        got = totals.agg(*[x.alias(f"s{i}") for i, x in enumerate(sums)]).first()
        # With w = p^a / S: entropy = log S - a * sum(p^a log p) / S.
        return [math.log(s) - a * t / s <= target_entropy for a, s, t in zip(exponents, got[::2], got[1::2], strict=True)]

    return bisect(flat_enough, TRIED)


def words(text: Column) -> Column:
    """Tokens of a text: its words, one at least."""
    return F.greatest(F.lit(1), F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(1))).cast("bigint")


class Plan:
    """Weights, budgets and the bucket table of one mix."""

    def __init__(
        self, docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", tokens: Column | None = None,
        repeat: float | None = REPEAT, target_entropy: float | None = None, budget: float | None = None,
        block_tokens: int = BLOCK_TOKENS, seed: int = 0, buckets: int = BUCKETS,
    ):
        self.seed = seed
        self.tokens = words(F.col(text_col)) if tokens is None else tokens
        self.source, self.hash = F.col(source_col), F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col))
        # The finest buckets first: 2^17 over all sources needs their number, which the same pass gives.
        fine = docs.select(self.source.alias("source"), self.hash.alias("h"), self.tokens.alias("n"))
        fine = fine.groupBy("source", F.shiftrightunsigned("h", 64 - 17).alias("bucket")).agg(F.sum("n").alias("n"))
        fine = stored(fine, "buckets")
        totals = stored(fine.groupBy("source").agg(F.sum("n").alias("n")), "totals")
        self.exponent = solve_table(totals, repeat, target_entropy)
        whole = budget is None
        # Without a budget every source has at least its own tokens: n / w is largest where n is.
        total = F.lit(float(totals.agg(F.sum("n")).first()[0] or 1))
        raised = F.pow(F.col("n") / total, F.lit(self.exponent))
        count, powers, most = totals.agg(F.count("*"), F.sum(raised), F.max(F.col("n") / raised)).first()
        self.budget = (most or 0.0) * (powers or 0.0) if whole else float(budget)
        self.blocks = max(1, math.ceil(self.budget / block_tokens))
        self.bits = max(0, min(17, int(math.log2(max(1, buckets / max(1, count))))))
        self.small = count <= buckets
        weight = raised / F.lit(powers or 1.0)
        target = weight * F.lit(self.budget)
        self.sources = totals.select(
            "source", F.col("n").alias("tokens"), weight.alias("weight"), (F.greatest(target, F.col("n").cast("double")) if whole else target).alias("target")
        )
        coarse = fine.groupBy("source", F.shiftrightunsigned("bucket", 17 - self.bits).alias("bucket")).agg(F.sum("n").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("source").orderBy("bucket"))
        table = coarse.select(F.col("source").alias("of"), "bucket", "n", (upto - F.col("n")).alias("start"))
        table = table.join(self.sources, F.col("of").eqNullSafe(F.col("source")))
        # A struct is never null, so a null source is a key like any other.
        self.table = stored(table.select(F.struct("source", "bucket").alias("key"), F.struct("n", "start", "tokens", "target").alias("at"), "n"), "table")

    def draws(self, docs: DataFrame, p: str) -> DataFrame:
        """`docs`, all columns, once for each draw, with {p}epoch, {p}block and {p}order (the place within the block)."""
        bits, h = self.bits, p + "hash"
        bucket = F.shiftrightunsigned(h, 64 - bits) if bits else F.lit(0).cast("bigint")
        inside = F.shiftrightunsigned(F.shiftleft(h, bits), 11) / F.lit(float(1 << 53))
        rows = docs.withColumn(h, self.hash)
        rows = rows.withColumn(p + "key", F.struct(self.source.alias("source"), bucket.alias("bucket")))
        table = self.table.select(F.col("key").alias(p + "key"), F.col("at").alias(p + "t"), F.col("n").alias(p + "n"))
        rows = rows.join(F.broadcast(table.drop(p + "n")), p + "key") if self.small else attach(rows, table, p + "key", p + "n")
        t = F.col(p + "t")
        rows = rows.withColumn(p + "at", t["start"] + inside * t["n"])
        copies = F.ceil((t["target"] - F.col(p + "at")) / t["tokens"]).cast("int")
        rows = rows.where(copies > 0).withColumn(p + "epoch", F.explode(F.sequence(F.lit(0), copies - 1)))
        block = F.floor((F.col(p + "at") + F.col(p + "epoch") * t["tokens"]) / t["target"] * self.blocks)
        rows = rows.withColumn(p + "block", F.least(block, F.lit(self.blocks - 1)).cast("bigint"))
        rows = rows.withColumn(p + "order", F.xxhash64(F.lit(self.seed + 1), p + "block", p + "epoch", h))
        return rows.select(*docs.columns, p + "epoch", p + "block", p + "order")


def schedule(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **options) -> DataFrame:
    """One row per draw: doc_id, source, n_tokens, epoch, block, position (from 0 within the block)."""
    plan = Plan(docs, id_col, source_col, text_col, **options)
    h = plan.hash.alias("h")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), plan.tokens.alias("n_tokens"), h)
    plan.source, plan.hash = F.col("source"), F.col("h")
    place = F.row_number().over(Window.partitionBy("__block").orderBy("__order", "doc_id", "n_tokens")) - 1
    return plan.draws(rows, "__").select(
        "doc_id", "source", "n_tokens", F.col("__epoch").alias("epoch"), F.col("__block").alias("block"), place.alias("position")
    )


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **options) -> DataFrame:
    """`docs`, all columns, once for each draw, in the order of blocks and, within these, of the schedule."""
    p = own_prefix(docs)
    rows = Plan(docs, id_col, source_col, text_col, **options).draws(docs, p)
    return rows.repartitionByRange(p + "block", p + "order").sortWithinPartitions(p + "block", p + "order").select(*docs.columns)
