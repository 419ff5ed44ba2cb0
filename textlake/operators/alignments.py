"""Texts against texts by seed and extend: shared strings, a longest chain of them, and the differences that it leaves.

Both texts of a pair are cut into strings of n characters at every place; equal ones meet in an equi-join within their pair.
Meetings that follow each other on a diagonal (the same distance between the places) are one match: gaps and islands. A match is
therefore maximal, and the work follows the meetings, not the product of the texts.

`blocks` keeps, per pair, the heaviest chain of matches in the order of both texts; the parts between two links of the chain are
compared anew for a smaller n. What is left after the smallest n are the differences. As a chain is a fold over one pair's matches, a pair is
one row there, and its matches are found beside it (`maximal`): no character is shuffled.

Defined cases
    null text: empty.     empty texts or none that share n characters: one difference, the whole.     equal texts: no difference, ratio 1.
    repeated strings: every meeting counts, so a string that stands p times in one text and q times in the other has p * q.
    repeated pair ids: not allowed.      empty table: no rows.       very long texts: whole.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textlake.operators.rowwise import by_row

#: Shown for nothing.
EMPTY = "(空)"


def _grams(rows: DataFrame, key: Sequence[str], text: str, n: int, place: str) -> DataFrame:
    """(key, gram, place): a hash of the n characters at each place."""
    cut = rows.where(F.length(text) >= n).select(*key, F.split(text, "").alias("__cs"), F.length(text).alias("__size"))
    each = F.transform(F.sequence(F.lit(0), F.col("__size") - n), lambda i: F.xxhash64(F.slice("__cs", i + 1, n)))
    return cut.select(*key, F.posexplode(each).alias(place, "gram"))


def matches(pairs: DataFrame, n: int, key: Sequence[str] = ("pair_id",)) -> DataFrame:
    """(key, left_at, right_at, size) of all maximal common strings of n characters or more of rows (key, left, right). Places count
    from 0. Each is compared character by character before it counts."""
    key = list(key)
    met = _grams(pairs, key, "left", n, "i").join(_grams(pairs, key, "right", n, "j"), [*key, "gram"]).select(*key, "i", "j", (F.col("i") - F.col("j")).alias("__d"))
    place = F.row_number().over(Window.partitionBy(*key, "__d").orderBy("i"))
    runs = met.withColumn("__run", F.col("i") - place).groupBy(*key, "__d", "__run")
    found = runs.agg(F.min("i").alias("left_at"), F.min("j").alias("right_at"), (F.count("*") + n - 1).cast("int").alias("size"))
    same = _cut("left", F.col("left_at"), F.col("size")) == _cut("right", F.col("right_at"), F.col("size"))
    return found.join(pairs.select(*key, "left", "right"), key).where(same).select(*key, "left_at", "right_at", "size")


def _cut(text: str | Column, at: Column, size: Column) -> Column:
    return F.substring(text, at + 1, size)


def shared_spans(pairs: DataFrame, least: int = 12, long: int = 40, n: int = 8) -> DataFrame:
    """(pair_id, span, left_at, right_at, is_long): maximal common strings of `least` characters or more."""
    texts = pairs.select("pair_id", F.coalesce("left", F.lit("")).alias("left"), F.coalesce("right", F.lit("")).alias("right"))
    found = matches(texts, min(n, least)).where(F.col("size") >= least).join(texts.select("pair_id", "left"), "pair_id")
    return found.select("pair_id", _cut("left", F.col("left_at"), F.col("size")).alias("span"), "left_at", "right_at", (F.col("size") >= long).alias("is_long"))


def heaviest_chain(left: np.ndarray, right: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Rows of the chain with the greatest total size: each begins, in both texts, where the one before has ended or later. Of equal
    totals, a chain that can be reached first in the order of left and right places."""
    order = np.lexsort((size, right, left))
    ends = np.unique(right + size)
    best = [(0, 0)] * (len(ends) + 1)  # a Fenwick tree of (total, -row) by end in the right text
    total, back = [0] * len(size), [-1] * len(size)
    waiting = order[np.argsort((left + size)[order], kind="stable")].tolist()
    enters, leaves = (np.searchsorted(ends, right + size) + 1).tolist(), np.searchsorted(ends, right, side="right").tolist()
    starts, stops, sizes = left.tolist(), (left + size).tolist(), size.tolist()
    done = 0
    for row in order.tolist():
        start = starts[row]
        while done < len(waiting) and stops[waiting[done]] <= start:
            w = waiting[done]
            at, value = enters[w], (total[w], -w)
            while at <= len(ends):
                if best[at] < value:
                    best[at] = value
                at += at & -at
            done += 1
        at, found = leaves[row], (0, 0)
        while at:
            if best[at][0] > found[0] or best[at] > found:
                found = best[at]
            at -= at & -at
        total[row] = found[0] + sizes[row]
        back[row] = -found[1] if found[0] else -1
    chain, row = [], max(order.tolist(), key=total.__getitem__) if len(order) else -1
    while row >= 0:
        chain.append(row)
        row = back[row]
    return np.array(chain[::-1], np.int64)


#: Meetings looked at together; characters of a pair below which a table of strings is quicker than arrays.
MEETINGS, SHORT = 1 << 20, 1500


def maximal(left: str, right: str, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left_at, right_at, size) of all maximal common strings of n characters or more of two texts, in order. Only the meetings that begin or
    end one are kept, so memory follows the matches; time follows the meetings."""
    if len(left) < n or len(right) < n:
        return (np.zeros(0, np.int64),) * 3
    return _by_table(left, right, n) if len(left) + len(right) < SHORT else _by_arrays(left, right, n)


def _by_table(left: str, right: str, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    stands: dict[str, list[int]] = {}
    for j in range(len(right) - n + 1):
        stands.setdefault(right[j : j + n], []).append(j)
    out: list[tuple[int, int, int]] = []
    for i in range(len(left) - n + 1):
        for j in stands.get(left[i : i + n], ()):
            if not i or not j or left[i - 1] != right[j - 1]:
                size, most = n, min(len(left) - i, len(right) - j)
                while size < most and left[i + size] == right[j + size]:
                    size += 1
                out.append((i, j, size))
    return tuple(np.array(out, np.int64).reshape(-1, 3).T)


def _by_arrays(left: str, right: str, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x, y = (np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in (left, right))
    odd = np.random.default_rng(n).integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1)
    gx, gy = (sum(t[k : len(t) - n + 1 + k] * odd[k] for k in range(n)) for t in (x, y))  # hashes; meetings are compared below
    order = np.argsort(gy, kind="stable")
    low, high = (np.searchsorted(gy[order], gx, side) for side in ("left", "right"))
    upto = np.cumsum(high - low)
    begins, ends = [], []
    at = 0
    while at < len(gx):
        stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + MEETINGS, "right")))
        times = (high - low)[at:stop]
        i = np.repeat(np.arange(at, stop), times)
        j = order[np.repeat(low[at:stop] - (np.cumsum(times) - times), times) + np.arange(len(i))]
        same = np.ones(len(i), bool)
        for k in range(n):
            same &= x[i + k] == y[j + k]
        i, j = i[same], j[same]
        first = (i == 0) | (j == 0) | (x[i - 1] != y[j - 1])
        last = (i + n == len(x)) | (j + n == len(y))
        last[~last] = x[i[~last] + n] != y[j[~last] + n]
        begins.append((i[first], j[first]))
        ends.append((i[last], j[last]))
        at = stop
    (i, j), (e, f) = (tuple(np.concatenate(c) for c in zip(*rows, strict=True)) for rows in (begins, ends))
    begin, end = np.lexsort((i, i - j)), np.lexsort((e, e - f))  # on each diagonal beginnings and ends take turns
    i, j, size = i[begin], j[begin], e[end] - i[begin] + n
    order = np.lexsort((j, i))
    return i[order], j[order], size[order]


def between(links: list[tuple[int, int, int]], left: int, right: int) -> list[tuple[int, int, int, int]]:
    """The parts (from, to, from, to) of two texts before, between and after the links of a chain."""
    begins = [(0, 0), *[(i + n, j + n) for i, j, n in links]]
    ends = [*[(i, j) for i, j, _ in links], (left, right)]
    return [(a, z, c, e) for (a, c), (z, e) in zip(begins, ends, strict=True)]


def common_blocks(left: str, right: str, sizes: Sequence[int]) -> list[tuple[int, int, int]]:
    """(left_at, right_at, size): the heaviest chain of common strings of sizes[0] characters or more, between its links those of
    sizes[1], and so on."""
    out: list[tuple[int, int, int]] = []
    parts = [(0, len(left), 0, len(right))]
    for n in sizes:
        for a, z, c, e in parts:
            found = maximal(left[a:z], right[c:e], n)
            chain = heaviest_chain(*found) if len(found[0]) > 1 else range(len(found[0]))
            for i, j, size in sorted(zip(*(x[list(chain)].tolist() for x in found), strict=True)):
                out.append((a + i, c + j, size))
        parts = [p for p in between(sorted(out), len(left), len(right)) if p[0] < p[1] and p[2] < p[3]]
    return out


def blocks(pairs: DataFrame, sizes: Sequence[int] = (8, 3)) -> DataFrame:
    """(pair_id, left_at, right_at, size): common strings in the order of both texts, found by strings of sizes[0] characters, between
    them by sizes[1], and so on. A pair is one row of one task."""
    texts = pairs.select("pair_id", F.coalesce("left", F.lit("")).alias("left"), F.coalesce("right", F.lit("")).alias("right"))

    def run(pair_id, left: str, right: str):
        return ((pair_id, *b) for b in common_blocks(left, right, sizes))

    return by_row(texts, run, {"pair_id": dict(pairs.dtypes)["pair_id"], "left_at": "int", "right_at": "int", "size": "int"})


def diff(pairs: DataFrame, context: int = 5, sizes: Sequence[int] = (8, 3)) -> DataFrame:
    """(pair_id, op, position, before, after, left_context, right_context, ratio) for rows (pair_id, left, right): what to replace,
    delete or insert at which place of the left text (from 1) to get the right one; equal texts give no row. `ratio` is twice the
    characters in common over all."""
    texts = pairs.select("pair_id", F.coalesce("left", F.lit("")).alias("left"), F.coalesce("right", F.lit("")).alias("right"))

    def run(pair_id, left: str, right: str):
        links = sorted(common_blocks(left, right, sizes))
        common, chars = sum(n for _, _, n in links), len(left) + len(right)
        for a, z, c, e in between(links, len(left), len(right)):
            if a < z or c < e:
                op = "insert" if a == z else "delete" if c == e else "replace"
                yield pair_id, op, a + 1, left[a:z] or EMPTY, right[c:e] or EMPTY, left[max(a - context, 0) : a], left[z : z + context], common, chars

    columns = {"pair_id": dict(pairs.dtypes)["pair_id"], "op": "string", "position": "int", "before": "string", "after": "string", "left_context": "string", "right_context": "string", "common": "bigint", "chars": "bigint"}
    found = by_row(texts.where("left <> right").repartition("pair_id"), run, columns)
    return found.withColumn("ratio", F.round(2 * F.col("common") / F.col("chars"), 4)).drop("common", "chars")
