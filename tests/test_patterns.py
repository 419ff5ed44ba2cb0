import random

import pytest

from textlake.operators import patterns
from textlake.operators.patterns import Automaton


def naive(text, entries):
    return sorted((e, s) for e in set(entries) if e for s in range(len(text) - len(e) + 1) if text.startswith(e, s))


def greedy(text, entries):
    taken, out = set(), []
    for e, s in sorted(naive(text, entries), key=lambda x: (-len(x[0]), x)):
        if not taken & set(range(s, s + len(e))):
            taken |= set(range(s, s + len(e)))
            out.append((e, s))
    return sorted(out)


def made(seed):
    r = random.Random(seed)
    alphabet = "abcé漢😀 "
    entries = ["".join(r.choices(alphabet, k=r.randint(1, 6))) for _ in range(60)] + ["a" * 40, "abc", "bc", "c"]
    texts = ["".join(r.choices(alphabet, k=r.choice([0, 3, 50, 1500]))) for _ in range(30)] + ["a" * 1200, "abcabc"]
    return entries, texts


@pytest.mark.parametrize("seed", range(3))
def test_an_automaton_finds_every_occurrence(seed):
    entries, texts = made(seed)
    a = Automaton.from_bytes(Automaton(sorted(set(entries))).to_bytes())
    of, entry, start = a.matches(texts)
    got = [[] for _ in texts]
    for t, e, s in zip(of, entry, start, strict=True):
        got[t].append((a.entries[e], int(s)))
    assert [sorted(g) for g in got] == [naive(t, entries) for t in texts]
    assert Automaton([]).matches(texts)[0].tolist() == [] and a.matches([])[0].tolist() == []


@pytest.mark.parametrize("part", [patterns.PART, 60])
def test_scans_over_one_and_several_automata(spark, part):
    entries, texts = made(7)
    rows = [(i, t) for i, t in enumerate(texts)] + [(900, None), (None, "xabcx"), (5, texts[5]), (5, "abc again")]
    docs = spark.createDataFrame([(i, t, 0, "k") for i, t in rows], "doc_id long, text string, uid int, entry string").repartition(3)
    table = spark.createDataFrame([(e,) for e in [*entries, None, "", "abc"]], "entry string")
    every = sorted([(d, e, s, s + len(e)) for d, t in rows for e, s in naive(t or "", entries)], key=repr)
    assert sorted([tuple(r) for r in patterns.occurrences(docs, table, part=part).collect()], key=repr) == every
    kept = sorted([(d, e, s, s + len(e)) for d, t in rows for e, s in greedy(t or "", entries)], key=repr)
    assert sorted([tuple(r) for r in patterns.scan(docs, table, part=part).collect()], key=repr) == kept
    assert patterns.scan(docs, table.limit(0)).count() == 0 and patterns.scan(docs.limit(0), table).count() == 0


def test_a_large_dictionary(spark):
    entries = spark.range(100_000).selectExpr("concat('entry', id, '.') as entry")
    docs = spark.range(200).selectExpr("id as doc_id", "concat('see entry', id * 499, '. and entry', id, '; entry') as text")
    got = {(r.doc_id, r.entry) for r in patterns.scan(docs, entries, part=400_000).collect()}
    assert got == {(i, f"entry{i * 499}.") for i in range(200)}


def test_names_and_synonyms(spark):
    docs = spark.createDataFrame([(1, "a license token"), (2, "licensed"), (3, "none"), (4, None)], "doc_id long, text string")
    aliases = spark.createDataFrame([("license", "L"), ("licensed", "D"), ("token", "T")], "alias string, name string")
    assert sorted(tuple(r) for r in patterns.longest_names(docs, aliases).collect()) == [(1, "L"), (2, "D"), (3, None), (4, None)]
    groups = spark.createDataFrame([(0, 0, "license"), (0, 1, "permit"), (1, 0, "token"), (1, 1, "key"), (1, 2, "secret")], "grp int, place int, word string")
    got = {r.doc_id: r.words for r in patterns.missing_synonyms(docs, groups).collect()}
    assert got == {1: ["permit", "key", "secret"], 2: ["permit"], 3: [], 4: []}
