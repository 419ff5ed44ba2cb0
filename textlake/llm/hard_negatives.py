"""Hard negatives by dual-tree search.

For each anchor, first the rows of its own label that are nearest by integer inner product (the positives); then, for each
of these, the best rows of other labels whose score lies in a window below the positive's.

Anchors and candidates are dealt to blocks and shards of bounded size; a task holds one block and one shard, builds a
ball tree over each, and descends both together: the inner products of two nodes lie between
c.d - |c|s - |d|r - rs and c.d + |c|s + |d|r + rs (centres c, d; radii r, s), so a node pair whose interval misses all that the
node's anchors still need goes at once, with all the anchors and candidates below it. Pairs of leaves that are left are
scored exactly. The best of all shards are merged by rank; a task hands on at most `k` rows for an anchor and window.

Scores are exact integers: components are floor(scale * x), products are taken in double precision where no partial sum can
pass 2^53, else with Python's integers (scores beyond 64 bits are cut to the largest).

Defined cases
    null id or label, null vector, null or non-finite component: no part.    an empty vector: score 0 with others of its kind.
    vectors of another length than the anchor's: not compared.      equal scores: the smaller id first.
    several rows of one id: one row, the least by (label, vector), stands for them.      an anchor without a positive, or a
    positive without a negative: no rows.    empty table: empty result.       extra columns: ignored.
    a label, a vector or an id that a large part of the rows share: dealt to shards by a hash of the id, like any other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textlake.llm.common import attach, stored

#: Candidates of a shard and anchors of a block (2 MB each at 64 components); points of a leaf.
SHARD, BLOCK, LEAF = 4096, 4096, 128
#: A gap is wide if it is this part of the way between the far points.
GAP = 0.1
NONE, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max
_FOUND = "anchor_id bigint, slot int, vec_id bigint, score bigint"


# --- one block against one shard -----------------------------------------------------------------------------------


class BallTree:
    """Nodes are stretches `start` to `end` of `order`, with centres and radii; `child` is the first of a node's two children,
    which follow each other, or 0 for a leaf. A stretch is cut between two far points, no closer to an end than a sixteenth."""

    def __init__(self, points: np.ndarray, leaf: int):
        self.order = np.arange(len(points))
        start, end, child, centre, radius = [0], [len(points)], [0], [], []
        at = 0
        while at < len(start):
            a, z = start[at], end[at]
            own = points[self.order[a:z]]
            centre.append(own.mean(axis=0))
            from_centre = ((own - centre[-1]) ** 2).sum(axis=1)
            radius.append(np.sqrt(from_centre.max()))
            if z - a > leaf and radius[-1] > 0:
                x = own[from_centre.argmax()]
                y = own[((own - x) ** 2).sum(axis=1).argmax()]
                along = (own - (x + y) / 2) @ (y - x)
                by = np.argsort(along, kind="stable")
                self.order[a:z], along = self.order[a:z][by], along[by]
                margin = max(1, (z - a) // 16)
                gaps = np.diff(along)[margin - 1 : z - a - margin]
                apart = gaps.max() > GAP * (along[-1] - along[0])
                cut = margin + int(gaps.argmax()) if apart else min(max(int((along < 0).sum()), margin), z - a - margin)
                cut += a
                child[at] = len(start)
                start, end, child = [*start, a, cut], [*end, cut, z], [*child, 0, 0]
            at += 1
        self.start, self.end, self.child = (np.array(x) for x in (start, end, child))
        self.centre, self.radius = np.array(centre), np.array(radius)
        self.norm = np.sqrt((self.centre**2).sum(axis=1))
        self.leaves = np.flatnonzero(self.child == 0)

    def rows(self, node: int) -> np.ndarray:
        return self.order[self.start[node] : self.end[node]]

    def least(self, need: np.ndarray) -> np.ndarray:
        """For each node, the least of `need` over its points."""
        ends = np.column_stack([self.start, self.end]).ravel()
        return np.minimum.reduceat(np.append(need[self.order], np.inf), ends)[::2]


def _intervals(a: BallTree, i: np.ndarray, b: BallTree, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the inner products of each node pair, wide enough for the rounding of their computation."""
    middle = np.einsum("ij,ij->i", a.centre[i], b.centre[j])
    spread = a.norm[i] * b.radius[j] + b.norm[j] * a.radius[i] + a.radius[i] * b.radius[j]
    spread += 1 + 1e-9 * (np.abs(middle) + a.norm[i] * b.norm[j] + spread)
    return middle - spread, middle + spread


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer-valued rows, as int64."""
    reach = np.sqrt((a**2).sum(axis=1).max(initial=0)) * np.sqrt((b**2).sum(axis=1).max(initial=0))
    if reach < 2**52:
        return (a @ b.T).astype(np.int64)
    exact = np.vectorize(int, otypes=[object])
    return np.clip(exact(a) @ exact(b).T, -MOST, MOST).astype(np.int64)


class DualTree:
    """The `k` best candidates of each anchor and window [low, high] (arrays of anchors x windows), by (score, smaller id)."""

    def __init__(self, anchors: np.ndarray, low: np.ndarray, high: np.ndarray, candidates: np.ndarray, ids: np.ndarray, k: int, barred, leaf: int = LEAF):
        self.anchors, self.low, self.high, self.candidates, self.ids, self.k, self.barred = anchors, low, high, candidates, ids, k, barred
        self.score = np.full((*low.shape, k), NONE)
        self.found = np.full((*low.shape, k), MOST)
        self.open = low <= high
        self.scored = 0
        if len(anchors) and len(candidates) and self.open.any():
            self._search(BallTree(anchors, leaf), BallTree(candidates, leaf))

    def _need(self, rows: np.ndarray | slice = slice(None)) -> np.ndarray:
        """What a candidate must score at least to matter to an anchor."""
        need = np.maximum(self.low[rows], self.score[rows, :, -1])
        return np.where(self.open[rows], need, MOST).min(axis=1).astype(np.float64)

    def _search(self, a: BallTree, b: BallTree) -> None:
        most = -a.least(-np.where(self.open, self.high, NONE).max(axis=1).astype(np.float64))
        # Each anchor leaf meets the candidate leaf whose centre suits it best, which sets what the others must reach.
        best = dict(zip(a.leaves.tolist(), b.leaves[(a.centre[a.leaves] @ b.centre[b.leaves].T).argmax(axis=1)].tolist(), strict=True))
        for i, j in best.items():
            self._leaves(a.rows(i), b.rows(j))
        least = a.least(self._need())
        left, right, ends = np.zeros(1, np.int64), np.zeros(1, np.int64), []
        while len(left):
            lows, highs = _intervals(a, left, b, right)
            alive = (highs >= least[left]) & (lows <= most[left])
            left, right, highs = left[alive], right[alive], highs[alive]
            ca, cb = a.child[left], b.child[right]
            first = (ca > 0) & ((cb == 0) | (a.radius[left] >= b.radius[right]))
            second = (cb > 0) & ~first
            ends.append((left[~first & ~second], right[~first & ~second], highs[~first & ~second]))
            left, right = (
                np.concatenate([ca[first], ca[first] + 1, left[second], left[second]]),
                np.concatenate([right[first], right[first], cb[second], cb[second] + 1]),
            )
        left, right, highs = (np.concatenate(x) for x in zip(*ends, strict=True))
        for at in np.argsort(-highs, kind="stable"):
            i, j = int(left[at]), int(right[at])
            if best[i] != j and highs[at] >= self._need(a.rows(i)).min():
                self._leaves(a.rows(i), b.rows(j))

    def _leaves(self, rows: np.ndarray, others: np.ndarray) -> None:
        others = others[np.argsort(self.ids[others], kind="stable")]
        scores = products(self.anchors[rows], self.candidates[others])
        scores[self.barred(rows, others)] = NONE
        self.scored += scores.size
        for slot in range(self.low.shape[1]):
            low, high = (x[rows, slot][:, None] for x in (self.low, self.high))
            own = np.where((scores >= low) & (scores <= high), scores, NONE)
            better = np.flatnonzero((own.max(axis=1) != NONE) & (own.max(axis=1) >= self.score[rows, slot, -1]))
            if not len(better):
                continue
            own, to = own[better], rows[better]
            new_score, new_id = np.full((len(to), self.k), NONE), np.full((len(to), self.k), MOST)
            for place in range(min(self.k, len(others))):
                top = own.argmax(axis=1)  # of equal scores the first, and so the smallest id
                new_score[:, place] = own[np.arange(len(to)), top]
                new_id[:, place] = np.where(new_score[:, place] == NONE, MOST, self.ids[others][top])
                own[np.arange(len(to)), top] = NONE
            score = np.concatenate([self.score[to, slot], new_score], axis=1)
            found = np.concatenate([self.found[to, slot], new_id], axis=1)
            order = np.lexsort((found, -np.maximum(score, -MOST)), axis=-1)[:, : self.k]
            self.score[to, slot] = np.take_along_axis(score, order, axis=1)
            self.found[to, slot] = np.take_along_axis(found, order, axis=1)


# --- dealing -------------------------------------------------------------------------------------------------------


def usable(rows: DataFrame, scale: int, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(vec_id, label, vector array<double> of integers), one row an id."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = rows.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(label_col).alias("label"), v.alias("vector"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(fine, F.lit(False)))
    one = rows.groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("r"))
    # Kept as doubles: floor() to a bigint would cut what is beyond 64 bits, and doubles from 2^52 on are whole.
    scaled = F.transform("r.vector", lambda x: F.when(F.abs(x * scale) < 2.0**52, F.floor(x * scale).cast("double")).otherwise(x * scale))
    return one.select("vec_id", "r.label", scaled.alias("vector"))


def _dealt(candidates: DataFrame, anchors: DataFrame, by: list[str], shard: int, block: int) -> DataFrame:
    """Rows of both kinds under (by, shard, block): a shard meets each block of anchors with the same `by`. Both counts are
    bounded by the sizes of shards and blocks, whatever the number of rows that share a value of `by`."""
    key = F.struct(*by).alias("at")
    sizes = candidates.groupBy(key).agg(F.count("*").alias("n"))
    asked = anchors.groupBy(key).agg(F.count("*").alias("m"))
    parts = sizes.join(asked, "at").select("at", "n", "m", F.ceil(F.col("n") / shard).cast("int").alias("shards"), F.ceil(F.col("m") / block).cast("int").alias("blocks"))
    parts = stored(parts, "parts")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int")
    c = attach(candidates.select(key, *candidates.columns), parts.select("at", "n", "shards", "blocks"), "at", "n").where("shards is not null")
    a = attach(anchors.select(key, *anchors.columns), parts.select("at", "m", "shards", "blocks"), "at", "m").where("shards is not null")
    c = c.withColumn("shard", own("shards")).withColumn("block", every("blocks")).withColumn("anchor", F.lit(False))
    a = a.withColumn("block", own("blocks")).withColumn("shard", every("shards")).withColumn("anchor", F.lit(True))
    return c.drop("shards", "blocks").unionByName(a.drop("shards", "blocks"), allowMissingColumns=True)


def _searched(rows: DataFrame, by: list[str], k: int, positive: bool, leaf: int) -> DataFrame:
    def run(table: pa.Table) -> pa.Table:
        is_anchor = table["anchor"].to_numpy()
        a, c = (table.filter(pa.array(x)).combine_chunks() for x in (is_anchor, ~is_anchor))
        anchor_ids, ids = (t["vec_id"].to_numpy() for t in (a, c))
        points = [np.array(t["vector"].combine_chunks().flatten()).reshape(len(t), -1) if len(t) else np.zeros((0, 0)) for t in (a, c)]
        if positive:
            low, high = np.full((len(a), 1), -MOST), np.full((len(a), 1), MOST)
            barred = lambda x, y: anchor_ids[x][:, None] == ids[y][None, :]
        else:
            slots = [x.as_py() for x in a["scores"]]
            width = max(map(len, slots), default=0)
            p = np.array([x + [None] * (width - len(x)) for x in slots], dtype=object)
            none = p == None  # noqa: E711
            p = np.where(none, 0, p).astype(np.int64)
            low = np.where(none, MOST, -(-p // 2))  # 50 p <= 100 n
            high = np.where(none, NONE, p // 100 * 95 + p % 100 * 95 // 100)  # 100 n <= 95 p
            names = pa.chunked_array([*a["label"].chunks, *c["label"].chunks], type=a.schema.field("label").type)
            codes = names.combine_chunks().dictionary_encode().indices.to_numpy()
            own, others = codes[: len(a)], codes[len(a) :]
            barred = lambda x, y: own[x][:, None] == others[y][None, :]
        tree = DualTree(points[0], low, high, points[1], ids, k, barred, leaf)
        at, slot, place = np.nonzero(tree.score != NONE)
        cols = [pa.array(anchor_ids[at]), pa.array(slot.astype(np.int32)), pa.array(tree.found[at, slot, place]), pa.array(tree.score[at, slot, place])]
        return pa.table(cols, names=["anchor_id", "slot", "vec_id", "score"])

    return rows.groupBy(*by, "shard", "block").applyInArrow(run, _FOUND)


def mine(
    rows: DataFrame, is_anchor: Column, label: Column | None = None, positives: int = 5, negatives: int = 3, scale: int = 256,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", shard: int = SHARD, block: int = BLOCK, leaf: int = LEAF,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score). `is_anchor`, over column vec_id, names the
    anchors; `label`, over the table's columns, may stand for its label."""
    if label is not None:
        rows = rows.select(F.col(id_col), label.alias(label_col), F.col(vector_col))
    points = usable(rows, scale, id_col, vector_col, label_col)
    points = stored(points.withColumn("dim", F.size("vector")), "points")
    anchors = points.where(is_anchor)

    met = _dealt(points, anchors, ["dim", "label"], shard, block).select("dim", "label", "shard", "block", "anchor", "vec_id", "vector")
    found = _searched(met, ["dim", "label"], positives, True, leaf)
    place = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id"))
    best = found.withColumn("place", place).where(F.col("place") <= positives)
    best = stored(best.select("anchor_id", "vec_id", "score", "place"), "positives")

    scores = F.transform(F.sort_array(F.collect_list(F.struct("place", "score"))), lambda x: x["score"])
    asked = anchors.join(best.groupBy(F.col("anchor_id").alias("vec_id")).agg(scores.alias("scores")), "vec_id")
    met = _dealt(points, asked.select(*points.columns, "scores"), ["dim"], shard, block)
    found = _searched(met.select("dim", "shard", "block", "anchor", "vec_id", "label", "vector", "scores"), ["dim"], negatives, False, leaf)
    place = F.row_number().over(Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "vec_id"))
    found = found.withColumn("rank", place).where(F.col("rank") <= negatives)
    named = best.select("anchor_id", (F.col("place") - 1).alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    found = found.join(named, ["anchor_id", "slot"])
    return found.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
