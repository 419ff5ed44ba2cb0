import random

import numpy as np
import pytest

from textlake.operators.located import in_order, rising_chain, surest_chain


@pytest.mark.parametrize("seed", range(10))
def test_chains_are_longest(seed):
    r = np.random.default_rng(seed)
    x = r.integers(0, 12, int(r.integers(0, 14)))
    best = [1] * len(x)
    for i in range(len(x)):
        best[i] = 1 + max([best[j] for j in range(i) if x[j] < x[i]], default=0)
    chain = x[rising_chain(x)]
    assert len(chain) == max(best, default=0) and (np.diff(chain) > 0).all()


def test_repeated_lines_are_resolved_by_order(spark):
    paras = ["the refrain of the song", "first verse begins here", "the refrain of the song", "second verse is different", "the refrain of the song", "short", "a long last paragraph with much text inside it"]
    rows = [(1, i, p) for i, p in enumerate(paras)] + [(2, 0, "the refrain of the song"), (2, 1, None)]
    chunks = [(1, 0, "the refrain of  the song\nfirst verse begins here"), (1, 1, "the refrain of the song"), (1, 2, "second verse is different\nthe refrain of the song"), (1, 3, "paragraph with much\nshort"), (1, 4, "nothing like that"), (1, 5, None), (2, 0, "x\nthe refrain of the song"), (3, 0, "the refrain of the song")]
    got = {(r.doc_id, r.seq): (r.para, r.method) for r in in_order(spark.createDataFrame(chunks, "doc_id long, seq int, content string"), spark.createDataFrame(rows, "doc_id long, para int, paragraph string")).collect()}
    assert got == {(1, 0): (0, "chain"), (1, 1): (2, "chain"), (1, 2): (3, "chain"), (1, 3): (6, "chain"), (1, 4): (-1, "none"), (1, 5): (-1, "none"), (2, 0): (0, "chain"), (3, 0): (-1, "none")}


def test_lines_out_of_order_keep_their_first_place(spark):
    paras = [(1, i, f"paragraph number {i} of many") for i in range(6)]
    chunks = [(1, s, f"paragraph number {i} of many") for s, i in enumerate([1, 2, 0, 3])]
    got = {r.seq: (r.para, r.method) for r in in_order(spark.createDataFrame(chunks, "doc_id long, seq int, content string"), spark.createDataFrame(paras, "doc_id long, para int, paragraph string")).collect()}
    assert got == {0: (1, "chain"), 1: (2, "chain"), 2: (0, "single"), 3: (3, "chain")}


def test_shuffled_copies_of_a_long_text(spark):
    r = random.Random(1)
    lines = [r.choice(["chorus line goes on", f"own line {i} of the text"]) for i in range(80)]
    paras = [(7, i, t) for i, t in enumerate(lines)]
    chunks = [(7, k, "\n".join(lines[k * 4 : k * 4 + 4])) for k in range(20)]
    got = {x.seq: x.para for x in in_order(spark.createDataFrame(chunks, "doc_id long, seq int, content string"), spark.createDataFrame(paras, "doc_id long, para int, paragraph string")).collect()}
    assert got == {k: k * 4 for k in range(20)}


def test_a_whole_paragraph_goes_before_a_part_of_one(spark):
    text = ["first of all", "an end and a paragraph", "a paragraph", "more text here"]
    paras = [(1, i, p) for i, p in enumerate(text)]
    chunks = [(1, 0, "first of all\nan end and a paragraph"), (1, 1, "a paragraph\nmore text here")]
    got = {r.seq: (r.para, r.method) for r in in_order(spark.createDataFrame(chunks, "doc_id long, seq int, content string"), spark.createDataFrame(paras, "doc_id long, para int, paragraph string")).collect()}
    assert got == {0: (0, "chain"), 1: (2, "chain")}


@pytest.mark.parametrize("seed", range(10))
def test_surest_chains(seed):
    r = np.random.default_rng(seed)
    x, sure = r.integers(0, 8, 10), r.integers(0, 2, 10).astype(bool)
    want = (0, 0)
    for mask in range(1 << len(x)):
        own = [i for i in range(len(x)) if mask >> i & 1]
        if (np.diff(x[own]) > 0).all():
            want = max(want, (len(own), int(sure[own].sum())))
    chain = surest_chain(x, sure)
    assert (np.diff(x[chain]) > 0).all() and (len(chain), int(sure[chain].sum())) == want
