import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from textlake.llm import hnsw, vector_search


def exact(rows, k, is_query):
    """The nearest of each query row, by (id, number among the rows of that id in the order of their vectors)."""
    fine = sorted((i, v) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v))
    own = [(i, sum(j == i for j, _ in fine[:n]), v) for n, (i, v) in enumerate(fine)]
    out = {}
    for i, c, q in own:
        if is_query(i):
            same = [(j, float(np.dot(q, v))) for j, d, v in own if (i, c) != (j, d) and len(v) == len(q)]
            out[i, c] = sorted(same, key=lambda x: (-x[1], x[0]))[:k]
    return out


@pytest.mark.parametrize("shard", [16_384, 300])
def test_recall_and_order(spark, shard):
    r = np.random.default_rng(5)
    centres = r.normal(size=(8, 24))
    v = centres[r.integers(0, 8, 1200)] + 0.4 * r.normal(size=(1200, 24))
    v *= r.uniform(0.5, 2, size=(1200, 1))
    v[300:700] = v[300]  # many copies of one vector
    rows = [(i, [float(np.float32(x)) for x in u]) for i, u in enumerate(v)]
    rows += [(5000, None), (5001, []), (5002, [0.0] * 24), (5003, [float("nan")] * 24), (5004, [None] + [1.0] * 23), (5005, [float("inf")] * 24), (None, [1.0] * 24)]
    rows += [(5020, [1.0, 2.0]), (5021, [2.0, 1.0]), (5040, [3.0]), rows[20], rows[320], (40, rows[9][1])]
    random.Random(1).shuffle(rows)
    table = spark.createDataFrame([(i, u, 3, 0.5) for i, u in rows], "vec_id long, embedding array<float>, rank int, score double").repartition(5)
    got = {}
    for x in vector_search.nearest(table, F.col("vec_id") % 20 == 0, k=20, shard_size=shard).collect():
        got.setdefault((x.query_id, x.copy), []).append((x.rank, x.vec_id, x.score))
    want = exact(rows, 20, lambda i: i % 20 == 0)
    hits = total = 0
    for q, best in want.items():
        own = sorted(got.get(q, []))
        assert [x[0] for x in own] == list(range(1, len(best) + 1))
        assert q[0] in {20, 40, 320} or q[0] not in {x[1] for x in own}
        assert own == sorted(own, key=lambda x: (-x[2], x[1]))
        assert all(abs(x[2] - s) < 1e-9 for x in own for i, s in [(x[1], dict(best).get(x[1], x[2]))])
        hits += len({x[1] for x in own} & {i for i, _ in best})
        total += len(best)
    assert set(got) == {q for q, best in want.items() if best}
    assert hits / total >= 0.97
    copies = next(q for q in want if 320 < q[0] < 700)
    assert [x[1] for x in sorted(got[copies])] == [i for i, _ in want[copies]]
    assert vector_search.nearest(table.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_lengths_of_all_magnitudes(spark):
    r = np.random.default_rng(8)
    v = r.normal(size=(900, 16)) * 10.0 ** r.integers(-6, 5, size=(900, 1))
    v[0] *= 1e30
    rows = [(i, u.tolist()) for i, u in enumerate(v)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for x in vector_search.nearest(table, F.col("vec_id") % 30 == 0, k=10).collect():
        got.setdefault((x.query_id, x.copy), []).append(x.vec_id)
    want = exact(rows, 10, lambda i: i % 30 == 0)
    hits = sum(len(set(got[q]) & {i for i, _ in best}) for q, best in want.items())
    assert hits / sum(map(len, want.values())) >= 0.97


def test_graph_is_the_same_after_reading_back():
    v = np.random.default_rng(1).normal(size=(700, 16))
    g = hnsw.build(v)
    again = hnsw.Graph.from_bytes(g.to_bytes(), v)
    a, b = g.search(v[:9], 30), again.search(v[:9], 30)
    assert (a[0] == b[0]).all() and (a[1] == b[1]).all()
    assert len(g.members[0]) == 700 and all(len(x) > len(y) for x, y in zip(g.members, g.members[1:], strict=False))
