import random

import numpy as np
import pytest

from textlake.operators import alignments as A


def maximal(left, right, n):
    out = set()
    for i in range(len(left)):
        for j in range(len(right)):
            if left[i] == right[j] and (i == 0 or j == 0 or left[i - 1] != right[j - 1]):
                k = 0
                while i + k < len(left) and j + k < len(right) and left[i + k] == right[j + k]:
                    k += 1
                if k >= n:
                    out.add((i, j, k))
    return out


def edited(r, base, n):
    out = list(base)
    for _ in range(n):
        at = r.randrange(len(out) + 1)
        out[at : at + r.choice([0, 1, 7])] = r.choices("abcdefghé漢 ", k=r.choice([0, 1, 6]))
    return "".join(out)


def pairs_of(seed):
    r = random.Random(seed)
    rows = []
    for i in range(12):
        base = "".join(r.choices("abcdefghé漢 ", k=r.choice([5, 40, 400])))
        rows.append((i, base, edited(r, base, r.choice([0, 1, 5]))))
    return [*rows, (50, None, "only right"), (51, "only left", None), (52, "", ""), (53, None, None), (54, "same", "same"), (55, "xy" * 30, "xy" * 25), (56, "quite other", "nothing alike")]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(pairs_of(1), "pair_id long, left string, right string").repartition(3)


@pytest.mark.parametrize("n", [3, 8])
def test_matches_are_all_maximal_common_strings(table, n):
    got = {(r.pair_id, r.left_at, r.right_at, r.size) for r in A.matches(table.fillna(""), n).collect()}
    assert got == {(p, *m) for p, left, right in pairs_of(1) for m in maximal(left or "", right or "", n)}


def test_shared_spans_are_long_enough(table):
    got = A.shared_spans(table).collect()
    want = {(p, left[i : i + k], i, j, k >= 40) for p, left, right in pairs_of(1) if left and right for i, j, k in maximal(left, right, 12)}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("seed", range(20))
def test_chains_are_heaviest(seed):
    r = np.random.default_rng(seed)
    m = int(r.integers(0, 12))
    left, right, size = r.integers(0, 30, m), r.integers(0, 30, m), r.integers(1, 9, m)
    best = 0
    for mask in range(1 << m):
        own = sorted((left[i], right[i], size[i]) for i in range(m) if mask >> i & 1)
        if all(x[0] + x[2] <= y[0] and x[1] + x[2] <= y[1] for x, y in zip(own, own[1:], strict=False)):
            best = max(best, sum(x[2] for x in own))
    chain = A.heaviest_chain(left, right, size)
    own = [(left[i], right[i], size[i]) for i in chain]
    assert all(x[0] + x[2] <= y[0] and x[1] + x[2] <= y[1] for x, y in zip(own, own[1:], strict=False))
    assert sum(x[2] for x in own) == best


def test_differences_turn_the_left_text_into_the_right_one(table):
    got = {}
    for r in A.diff(table).collect():
        got.setdefault(r.pair_id, []).append(r)
    for p, left, right in pairs_of(1):
        left, right = left or "", right or ""
        out, at, common = [], 0, len(left)
        for r in sorted(got.get(p, []), key=lambda r: (r.position, r.op != "insert")):
            before, after = ("" if r.op == "insert" else r.before), ("" if r.op == "delete" else r.after)
            assert left[r.position - 1 :].startswith(before) and (r.op == "replace") == bool(before and after)
            assert r.left_context == left[max(0, r.position - 6) : r.position - 1]
            assert r.right_context == left[r.position - 1 + len(before) :][:5]
            out += [left[at : r.position - 1], after]
            at, common = r.position - 1 + len(before), common - len(before)
        assert "".join(out) + left[at:] == right
        if p in got:
            assert [r.ratio for r in got[p]] == pytest.approx([2 * common / (len(left) + len(right))] * len(got[p]), abs=1e-4)
    assert not {52, 53, 54} & set(got)


def test_small_edits_are_found_as_they_are(spark):
    base = "the quick brown fox jumps over the lazy dog while 42 cats watch from afar"
    rows = [(1, base, base.replace("quick ", "")), (2, base, base.replace("lazy", "sleepy")), (3, base, base + "!")]
    got = {r.pair_id: (r.op, r.position) for r in A.diff(spark.createDataFrame(rows, "pair_id long, left string, right string")).collect()}
    assert got[1][0] == "delete" and got[3] == ("insert", len(base) + 1) and got[2][0] in ("replace", "insert", "delete")
    assert A.diff(spark.createDataFrame([], "pair_id long, left string, right string")).count() == 0


@pytest.mark.parametrize("n", [1, 3, 8])
def test_both_ways_to_maximal_strings(n, monkeypatch):
    monkeypatch.setattr(A, "MEETINGS", 50)
    for seed in range(4):
        for _, left, right in pairs_of(seed):
            want = maximal(left or "", right or "", n)
            for find in (A.maximal, A._by_table, A._by_arrays):
                if min(len(left or ""), len(right or "")) >= n:
                    got = list(zip(*(x.tolist() for x in find(left, right, n)), strict=True))
                    assert len(got) == len(set(got)) and set(got) == want


def test_a_difference_shuffles_no_characters(spark):
    rows = [(i, "some line of text that goes on " * 40, "some line of a text that went on " * 40) for i in range(3)]
    plan = A.blocks(spark.createDataFrame(rows, "pair_id long, left string, right string"))._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Generate" not in plan
