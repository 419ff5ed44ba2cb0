import math
import random

import pytest
from pyspark.sql import functions as F

from textlake.llm import mixing


def test_weights():
    tokens = [600, 100, 100, 50]
    exponent, w = mixing.solve(tokens, repeat=3.0)
    assert 0 < exponent < 1 and abs(sum(w) - 1) < 1e-12
    assert mixing.repetition(tokens, w) == pytest.approx(3.0, abs=1e-9)
    exponent, w = mixing.solve(tokens, repeat=None, target_entropy=1.2)
    assert mixing.entropy(w) == pytest.approx(1.2, abs=1e-9)
    assert mixing.solve(tokens, repeat=100)[0] == 0.0 and mixing.solve(tokens, repeat=100)[1] == [0.25] * 4
    assert mixing.solve(tokens, repeat=1.0)[1] == pytest.approx([t / 850 for t in tokens])
    assert mixing.solve([5])[1] == [1.0]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["big"] * 12 + ["small", "tiny", None]), "w " * rng.randint(0, 40), 1, "q") for i in range(1500)]
    rows += [(9000, "big", None, 1, "q"), (None, "big", "a b", 1, "q"), (7, rows[7][1], rows[7][2], 1, "q"), (9001, "small", "x " * 5000, 1, "q")]
    return spark.createDataFrame(rows, "doc_id long, source string, text string, block long, __n string").repartition(4)


def tokens_of(text):
    return max(1, len((text or "").split()))


def test_schedule_keeps_all_and_meets_the_weights(docs):
    rows = docs.collect()
    sums = {}
    for r in rows:
        sums[r.source] = sums.get(r.source, 0) + tokens_of(r.text)
    plan = mixing.schedule(docs, block_tokens=2000).collect()
    assert {r.doc_id for r in plan} == {r.doc_id for r in rows}
    names = sorted(sums, key=lambda s: (s is not None, s or ""))
    _, w = mixing.solve([sums[s] for s in names])
    budget = max(sums[s] / x for s, x in zip(names, w, strict=True))
    drawn = {}
    for r in plan:
        drawn[r.source] = drawn.get(r.source, 0) + r.n_tokens
    longest = max(tokens_of(r.text) for r in rows)
    for s, x in zip(names, w, strict=True):
        assert drawn[s] == pytest.approx(max(sums[s], x * budget), abs=2 * longest if s == "small" else 100)
    blocks = {}
    for r in plan:
        blocks.setdefault(r.block, []).append(r.position)
    assert len(blocks) == math.ceil(budget / 2000)
    assert all(sorted(p) == list(range(len(p))) for p in blocks.values())
    share = [sum(r.n_tokens for r in plan if r.block == b and r.source == "big") for b in blocks]
    assert max(share) < 1.5 * min(share)
    again = mixing.schedule(docs.repartition(2), block_tokens=2000).collect()
    assert sorted(map(tuple, again), key=repr) == sorted(map(tuple, plan), key=repr)


def test_a_small_budget_takes_the_first_of_each_source(docs):
    plan = mixing.schedule(docs, budget=3000.0, block_tokens=1000, repeat=1.0)
    total = plan.agg(F.sum("n_tokens")).first()[0]
    assert 2000 < total < 9000 and plan.agg(F.max("epoch")).first()[0] == 0


def test_mix_keeps_columns_and_counts(docs):
    plain = docs
    out = mixing.mix(plain, block_tokens=2000)
    assert out.columns == plain.columns
    counts = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert counts == {r.doc_id: r["count"] for r in mixing.schedule(plain, block_tokens=2000).groupBy("doc_id").count().collect()}
    assert mixing.mix(plain.limit(0)).count() == mixing.schedule(plain.limit(0)).count() == 0


def test_schedule_against_a_plain_computation(spark, docs):
    """Every draw, its block and its place, from the same hashes in plain Python."""
    block_tokens = 2000
    rows = docs.select("doc_id", "source", "text", F.xxhash64(F.lit(0), "doc_id", "text").alias("h")).collect()
    sums, fine = {}, {}
    for r in rows:
        n = tokens_of(r.text)
        sums[r.source] = sums.get(r.source, 0) + n
    bits = int(math.log2(mixing.BUCKETS / len(sums)))
    for r in rows:
        b = (r.h & (1 << 64) - 1) >> 64 - bits
        fine.setdefault(r.source, {}).setdefault(b, 0)
        fine[r.source][b] += tokens_of(r.text)
    names = sorted(sums, key=lambda s: (s is not None, s or ""))
    _, w = mixing.solve([sums[s] for s in names])
    budget = max(sums[s] / x for s, x in zip(names, w, strict=True))
    target = {s: max(sums[s], x * budget) for s, x in zip(names, w, strict=True)}
    blocks = max(1, math.ceil(budget / block_tokens))
    start = {s: {b: sum(n for c, n in own.items() if c < b) for b in own} for s, own in fine.items()}
    draws = {}
    for r in rows:
        h = r.h & (1 << 64) - 1
        b, inside = h >> 64 - bits, ((h << bits & (1 << 64) - 1) >> 11) / (1 << 53)
        at = start[r.source][b] + inside * fine[r.source][b]
        for epoch in range(math.ceil((target[r.source] - at) / sums[r.source])):
            block = min(int((at + epoch * sums[r.source]) / target[r.source] * blocks), blocks - 1)
            draws.setdefault((r.doc_id, r.source, tokens_of(r.text), epoch), []).append(block)
    got = {}
    plan = mixing.schedule(docs, block_tokens=block_tokens)
    for r in plan.collect():
        got.setdefault((r.doc_id, r.source, r.n_tokens, r.epoch), []).append(r.block)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in draws.items()}
    keyed = plan.join(docs.select("doc_id", "source", F.xxhash64(F.lit(0), "doc_id", "text").alias("h")).where("doc_id < 7"), ["doc_id", "source"])
    keyed = keyed.withColumn("o", F.xxhash64(F.lit(1), "block", F.col("epoch"), "h"))
    by_block = {}
    for r in keyed.collect():
        by_block.setdefault(r.block, []).append((r.position, r.o))
    assert all([o for _, o in sorted(v)] == sorted(o for _, o in v) for v in by_block.values())


def test_null_ids_spread_over_the_blocks(spark):
    docs = spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("s").alias("source"), F.concat(F.lit("w w w "), "id").alias("text"))
    blocks = [r["count"] for r in mixing.schedule(docs, block_tokens=1000).groupBy("block").count().collect()]
    assert len(blocks) == 16 and max(blocks) < 2 * min(blocks)


def test_many_sources_are_joined_by_shuffle(spark, docs):
    some = mixing.schedule(docs, block_tokens=2000, buckets=4).collect()
    few = mixing.schedule(docs, block_tokens=2000, buckets=1).collect()
    assert {r.doc_id for r in some} == {r.doc_id for r in few}
    assert sum(r.n_tokens for r in few) == pytest.approx(sum(r.n_tokens for r in some), rel=0.05)


def test_exponent_by_aggregates(spark):
    tokens = [600, 100, 100, 50, 7]
    totals = spark.createDataFrame([(str(i), n) for i, n in enumerate(tokens)], "source string, n long")
    assert mixing.solve_table(totals, 3.0) == pytest.approx(mixing.solve(tokens, 3.0)[0], abs=1e-9)
    assert mixing.solve_table(totals, None, 1.1) == pytest.approx(mixing.solve(tokens, None, 1.1)[0], abs=1e-9)
