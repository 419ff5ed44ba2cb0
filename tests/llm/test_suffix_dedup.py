import hashlib
import random

import numpy as np
import pytest

from textlake.llm import difference_cover, suffix_dedup
from textlake.llm.difference_cover import equal_prefixes, suffix_array

W = suffix_dedup.WINDOW


def brute(rows):
    """rows: (doc_id, text). The definition, window by window."""
    first = {}
    for d, t in rows:
        data, own = (t or "").encode(), suffix_dedup._LAST if d is None else d
        for i in range(len(data) - W + 1):
            w = data[i : i + W]
            first[w] = min(own, first.get(w, own))
    out = []
    for d, t in rows:
        data, own = (t or "").encode(), suffix_dedup._LAST if d is None else d
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - W + 1):
            if first[data[i : i + W]] < own:
                gone[i : i + W] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
        out.append((d, len(data), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def result(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()), key=repr)


def corpus(seed, n):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdeé中", k=rng.randint(1, 7))) for _ in range(300)]
    lines = [" ".join(rng.choices(words, k=rng.randint(4, 25))) for _ in range(12)]
    rows = []
    for i in range(n):
        parts = [rng.choice(lines) if rng.random() < 0.4 else " ".join(rng.choices(words, k=rng.randint(1, 20))) for _ in range(rng.randint(1, 8))]
        text = "\n".join(parts)
        if rows and rng.random() < 0.3:  # a near copy
            text = rng.choice(rows)[1] or text
            at = rng.randrange(len(text) + 1)
            text = text[:at] + rng.choice(words) + text[at + 3 :]
        rows.append((i, text))
    rows += [(n, ""), (n + 1, None), (n + 2, "ab" * 3000), (n + 3, "ab" * 40 + "x" + "ab" * 40), (n + 4, rows[3][1]), (3, rows[3][1]), (5, rows[9][1])]
    rows += [(None, rows[7][1] + " tail"), (None, "q" * 49), (n + 5, "q" * 49), (n + 6, "r" * 50), (n + 7, "r" * 50), (n + 8, "z" * 300), (n + 9, "z" * 70)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "crowd", "limits"), [(1, 1 << 17, {}), (2, 3, {}), (3, 1 << 17, {"PIECE": 64, "HELD": 40, "SORTED": 200})])
def test_against_the_definition(spark, monkeypatch, seed, crowd, limits):
    monkeypatch.setattr(suffix_dedup, "CROWD", crowd)
    for k, v in limits.items():
        monkeypatch.setattr(suffix_dedup, k, v)
    rows = corpus(seed, 120)
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, doc string, row int").repartition(5)
    got = result(suffix_dedup.remove_repeats(docs))
    assert got == brute(rows)
    assert sum(r[2] for r in got) > 1000


def test_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_pieces_do_not_change_segments_windows(monkeypatch):
    data = np.random.default_rng(1).integers(97, 100, 3000).astype(np.uint8)

    def anchors():
        h, first, n = suffix_dedup.segments(data)
        assert (np.cumsum(n) - n == first).all() and n.sum() == len(data) - W + 1
        return np.repeat(h, n)

    whole = anchors()
    monkeypatch.setattr(suffix_dedup, "PIECE", 37)
    assert (anchors() == whole).all()


def test_suffix_arrays():
    rng = random.Random(2)
    for _ in range(500):
        a = np.array([rng.randint(0, rng.choice([1, 2, 200])) for _ in range(rng.randint(0, 60))], np.uint8)
        assert suffix_array(a).tolist() == sorted(range(len(a)), key=lambda i: a[i:].tolist())
    a = np.frombuffer(b"abcabcabdabc\xff", np.uint8)
    order, group = equal_prefixes(a, np.arange(10), 3)
    by = {}
    for i, g in zip(order.tolist(), group.tolist(), strict=True):
        by.setdefault(g, set()).add(bytes(a[i : i + 3]))
    assert all(len(v) == 1 for v in by.values()) and len(by) == len({bytes(a[i : i + 3]) for i in range(10)})


@pytest.mark.parametrize("compared", [1 << 18, 7])
def test_anchors_too_long_for_a_suffix_array(monkeypatch, compared):
    monkeypatch.setattr(difference_cover, "MOST", 300)
    monkeypatch.setattr(suffix_dedup, "COMPARED", compared)
    rng = random.Random(4)
    anchor = b"the same phrase "
    texts = sorted({bytes(rng.choices(b"ab\0", k=2)) * 17 + anchor + bytes(rng.choices(b"ab\0", k=2)) * rng.choice([9, 17]) for _ in range(300)})
    h = np.array([1] * len(texts), np.uint64)
    doc = np.array([rng.randrange(50) for _ in texts], np.int64)
    least = {}
    for d, t in zip(doc.tolist(), texts, strict=True):
        for i in range(len(t) - W + 1):
            least[t[i : i + W]] = min(d, least.get(t[i : i + W], d))
    want = [sum(1 << i for i in range(len(t) - W + 1) if least[t[i : i + W]] < d) for d, t in zip(doc.tolist(), texts, strict=True)]
    assert sum(map(len, texts)) > 2 * difference_cover.MOST and any(want)
    assert suffix_dedup._settle(h, doc, texts).tolist() == want


def test_a_phrase_in_many_settings_of_one_text(spark, monkeypatch):
    phrase = "one phrase that comes back in every setting of it, again and again"
    text = " ".join(f"{i * 7919 % 100003:05d} {phrase} {i * 104729 % 99991:05d}" for i in range(400))
    rows = [(1, text), (2, f"so {phrase} so"), (3, text[:5000])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    monkeypatch.setattr(difference_cover, "MOST", 2000)  # without crowding: the whole anchor meets, and is not sorted
    assert result(suffix_dedup.remove_repeats(docs)) == brute(rows)
    monkeypatch.setattr(suffix_dedup, "CROWD", 50)  # three documents, many segments: cut to single windows
    encoded = docs.selectExpr("doc_id as doc", "encode(text, 'UTF-8') as text")
    assert suffix_dedup._filters(suffix_dedup._anchor_counts(encoded, 4), 4)[1].any()
    assert result(suffix_dedup.remove_repeats(docs)) == brute(rows)
