import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from textlake.llm import hard_negatives
from textlake.llm.hard_negatives import BallTree, DualTree, products


def brute(rows, is_anchor, positives=5, negatives=3):
    one = {}
    for i, v, k in rows:
        if i is None or k is None or v is None or not all(x is not None and math.isfinite(x) for x in v):
            continue
        one[i] = min(one.get(i, (k, v)), (k, v))
    points = {i: (k, [math.floor(256 * x) for x in v]) for i, (k, v) in one.items()}
    out = set()
    for a, (ka, va) in points.items():
        if not is_anchor(a):
            continue
        same = [(-sum(x * y for x, y in zip(va, v, strict=True)), i, k) for i, (k, v) in points.items() if i != a and len(v) == len(va)]
        for s, p, _ in sorted(x for x in same if x[2] == ka)[:positives]:
            fit = sorted((n, i) for n, i, k in same if k != ka and 50 * -s <= 100 * -n <= 95 * -s)
            out |= {(a, p, r, i, -s, -n) for r, (n, i) in enumerate(fit[:negatives], 1)}
    return out


def table(spark, rows):
    return spark.createDataFrame([(i, v, k, 7, 0.5) for i, v, k in rows], "vec_id long, embedding array<float>, label int, anchor int, score double").repartition(3)


@pytest.mark.parametrize("sizes", [{}, {"shard": 60, "block": 7, "leaf": 8}])
def test_mining_equals_all_pairs(spark, sizes):
    r = np.random.default_rng(3)
    centres = r.normal(size=(6, 12))
    v = centres[r.integers(0, 6, 500)] + 0.5 * r.normal(size=(500, 12))
    v[100:260] = v[100]  # a vector that a third of the rows share: ties
    rows = [(i, [float(np.float32(x)) for x in u], int(r.integers(0, 4))) for i, u in enumerate(v)]
    rows += [(600, None, 1), (601, rows[0][1], None), (None, rows[0][1], 1), (610, [float("nan")] * 12, 2), (620, [None] + [1.0] * 11, 2), (630, [float("inf")] * 12, 2)]
    rows += [(640, [], 1), (641, [], 2), (642, [1.0], 1), (650, [1.0], 1), (651, [0.8], 2), rows[50], (50, rows[9][1], 3)]
    random.Random(2).shuffle(rows)
    got = hard_negatives.mine(table(spark, rows), F.col("vec_id") % 10 == 0, **sizes).collect()
    assert {tuple(x) for x in got} == brute(rows, lambda i: i % 10 == 0)
    assert len({tuple(x) for x in got}) == len(got) > 200


def test_empty_table_and_given_labels(spark):
    empty = table(spark, [(1, [1.0], 1)]).limit(0)
    assert hard_negatives.mine(empty, F.col("vec_id") % 50 == 0).count() == 0
    rows = [(0, [1.0, 0.0], 5), (1, [1.0, 0.0], 5), (7, [0.75, 0.0], 5), (2, [0.75, 9.0], 6), (3, [0.99, 0.0], 6), (4, [0.4, 0.0], 6)]
    label = F.when(F.col("vec_id") == 7, F.lit(6)).otherwise(F.col("label"))
    got = hard_negatives.mine(table(spark, rows), F.col("vec_id") == 0, label=label).collect()
    assert [tuple(x) for x in sorted(got)] == [(0, 1, 1, 2, 65536, 49152), (0, 1, 2, 7, 65536, 49152)]


def test_large_components_are_exact():
    a, b = np.array([[2.0**60, 3.0], [2.0**80, 1.0]]), np.array([[2.0, 5.0], [-(2.0**10), 0.0]])
    assert products(a, b).tolist() == [[2**61 + 15, -(2**63 - 1)], [2**63 - 1, -(2**63 - 1)]]


def test_trees_prune_whole_groups():
    r = np.random.default_rng(1)
    centres = 100 * np.eye(16)
    points = np.floor(256 * (centres[np.arange(4096) % 16] + r.normal(size=(4096, 16))))
    tree = BallTree(points, 64)
    assert sorted(tree.order) == list(range(4096)) and (tree.end - tree.start)[tree.leaves].max() <= 64
    low, high = np.full((512, 1), -(2**63 - 1)), np.full((512, 1), 2**63 - 1)
    found = DualTree(points[:512], low, high, points, np.arange(4096), 5, lambda x, y: x[:, None] == y[None, :], 64)
    every = (points[:512] @ points.T).astype(np.int64)
    every[np.arange(512), np.arange(512)] = -(2**62)
    for i in range(512):
        best = np.lexsort((np.arange(4096), -every[i]))[:5]
        assert found.found[i, 0].tolist() == best.tolist() and found.score[i, 0].tolist() == every[i, best].tolist()
    assert found.scored < every.size / 8  # the rest went as node pairs
