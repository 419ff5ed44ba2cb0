import random

import numpy as np
import pytest

from textlake.llm import minhash, shingles


def naive(rows, k=3, part=85, whole=100):
    """(doc_id, n_shingles, component_id, kept) of each row, comparing all pairs."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    group = list(range(len(rows)))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if x and y and whole * len(x & y) >= part * len(x | y):
                group[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[top(i)] = min([x for x in (d, least.get(top(i))) if x is not None], default=None)
    found = [(d, len(s), least[top(i)] if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]
    return sorted([(*x, x[0] is not None and x[0] == x[2]) for x in found], key=repr)


def texts(seed):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    out = [None, "", " \t\n", "one", "One", "one two", "one  two", "one two three", "ONE two\vthree", "é è ê", "É è ê"]
    line = " ".join(r.choices(words, k=40))
    for _ in range(25):  # families: chains of edits, so that some links lie just beside the threshold
        base = r.choices(words, k=r.choice([8, 30, 60, 200]))
        for _ in range(r.choice([2, 5, 12])):
            own = list(base)
            for _ in range(r.choice([1, 1, 2, len(base) // 25 + 1])):
                own[r.randrange(len(own))] = r.choice(words)
            out.append(" ".join(own))
            if r.random() < 0.3:
                base = own
    for _ in range(60):  # a passage that many share, in texts that differ
        out.append(line + " " + " ".join(r.choices(words, k=r.choice([5, 60]))))
    base = r.choices(words, k=50)
    for _ in range(120):  # one large family of near copies
        own = list(base)
        own[r.randrange(50)] = r.choice(words)
        own[r.randrange(50)] = r.choice(words)
        out.append(" ".join(own))
    out += [out[20]] * 90  # copies
    out.append(" ".join(r.choices(words, k=20_000)))
    out.append(out[-1] + " more")
    r.shuffle(out)
    return out


@pytest.mark.parametrize("cut", [False, True])
def test_components_equal_all_pairs(spark, monkeypatch, cut):
    if cut:  # long posting lists and large clusters in chunks
        monkeypatch.setattr(minhash, "CHUNK", 20)
        monkeypatch.setattr(shingles, "CROWD", 30)
        monkeypatch.setattr(shingles, "CLUSTER", 2000)
    rows = [(i * 3 if i % 40 else None, t) for i, t in enumerate(texts(4), 1)]
    rows += [rows[5], rows[7], (rows[9][0], "another text of the same id which is alone in the table")]
    table = spark.createDataFrame([(d, t, 1, b"", 0) for d, t in rows], "doc_id long, text string, node int, digest binary, uses int").repartition(3)
    got = [tuple(x) for x in minhash.near_duplicates(table).collect()]
    assert sorted(got, key=repr) == naive(rows)


def test_empty_table(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_signatures_agree_as_sets_do():
    r = np.random.default_rng(1)
    x = r.integers(0, 2**63, 900, dtype=np.uint64)
    agree = [np.mean(minhash.signature(x[:600]) == minhash.signature(np.concatenate([x[a : 600], x[600 : 600 + a]]))) for a in (0, 60, 300)]
    assert agree[0] == 1 and 0.65 < agree[1] < 0.95 and 0.15 < agree[2] < 0.55
    assert minhash.oversight(0.85) < 1e-11
