from pyspark.sql import functions as F

from textlake.functions import shaping as H
from textlake.functions import text as T
from textlake.operators import annotations as A
from textlake.operators import matching as M
from textlake.operators import patterns as D
from textlake.operators import retrieval as R
from textlake.operators import upkeep as U


def values(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def test_overlapping_positions_in_any_place(spark):
    rows = [("aaaa", "aa"), ("", "a"), ("xaby", "ab"), ("abab", "ab"), ("AB.*ab.*", ".*"), ("a\\Eb\\E", "\\E"), ("zz", "zzz"), (None, "a"), ("é😀é😀", "😀")]
    df = spark.createDataFrame(rows, "t string, w string").select("t", "w", T.overlapping_positions(F.col("t"), F.col("w")).alias("at"))
    for r in df.collect():
        low, w = (r.t or "").lower(), r.w.lower()
        assert (r["at"] or []) == [i for i in range(len(low) - len(w) + 1) if low[i : i + len(w)] == w], r
    long = spark.createDataFrame([("ab" * 100_000 + "x",)], "t string").select(F.size(T.overlapping_positions(F.col("t"), "bx")))
    assert long.first()[0] == 1


def test_positions_and_chunks_find_their_paragraphs(spark):
    paras = spark.createDataFrame([(1, 0, "first line here"), (1, 1, "second"), (1, 2, "third and last line"), (2, 0, "other")], "doc_id long, para int, paragraph string")
    asked = spark.createDataFrame([(1, 0), (1, 14), (1, 15), (1, 16), (1, 23), (1, 99), (2, 3), (3, 0)], "doc_id long, pos long")
    got = {(r.doc_id, r.pos): (r.para, r.offset) for r in A.paragraph_of(asked, paras).collect()}
    assert got == {(1, 0): (0, 0), (1, 14): (0, 14), (1, 15): (None, None), (1, 16): (1, 0), (1, 23): (2, 0), (1, 99): (None, None), (2, 3): (0, 3), (3, 0): (None, None)}
    chunks = spark.createDataFrame([(1, 7, "third  and last"), (1, 8, "ab"), (1, 9, None), (1, 10, "first line h~~~~~~~~~~~~~~~~~~~~~~"), (4, 1, "nowhere at all")], "doc_id long, chunk int, content string")
    found = {(r.doc_id, r.chunk): (r.level, r.para) for r in A.locate_chunks(chunks, paras).collect()}
    assert found[1, 7] == (1, 2) and found[1, 8] == found[1, 9] == found[4, 1] == (0, -1)


def test_filters_labels_and_changes(spark):
    rows = [(1, 0, "Ada", "person", "user", "note"), (1, 1, "Ada", "place", "agent", None), (2, 0, "Bob", "person", "agent", " "), (None, 0, None, "time", "agent", "x")]
    notes = spark.createDataFrame(rows, "doc_id long, para int, entity string, category string, origin string, note string")
    assert values(A.index_filter(notes, "ADA", ["entity"]), "doc_id", "para") == [(1, 0), (1, 1)]
    assert A.index_filter(notes, has_note=False).count() == 2 and A.index_filter(notes, "", (), ["time"], "agent", True).count() == 1
    assert {r.unique_label for r in A.unique_labels(notes, "entity", ["doc_id", "para"]).collect()} == {"Ada", "Ada#2", "Bob", None}
    kept, children = A.scoped_delete(notes, F.col("doc_id") == 1, notes.select("doc_id", "para"), "doc_id")
    assert kept.count() == 2 and values(children, "doc_id") == [(2,)]
    patch = spark.createDataFrame([(1, "new"), (2, None)], "doc_id long, note string")
    assert values(A.merge_patch(notes, patch, ["doc_id"], "note"), "note") == sorted([("new",), ("new",), (" ",), ("x",)], key=repr)


def test_query_understanding(spark):
    rows = spark.createDataFrame([(1, "the license of der"), (2, "token the"), (3, ""), (4, None)], "doc_id long, t string")
    t = F.col("t")
    out = rows.select(
        R.version_filter(t, [("the", "era", "en"), ("der", "era", "de"), ("token", "genre", "x")]).alias("v"), R.any_of(t, ["token"]).alias("a")
    ).collect()
    names = D.longest_names(rows, spark.createDataFrame([("license", "L"), ("the", "A")], "alias string, name string"), text_col="t")
    assert values(names, "doc_id", "name") == sorted([(1, "L"), (2, "A"), (3, None), (4, None)], key=repr)
    assert [r.v for r in out] == [None, "era=en", None, None]
    assert [r.a for r in out] == [False, True, False, False]
    more = D.missing_synonyms(rows, spark.createDataFrame([(0, 0, "token"), (0, 1, "key")], "grp int, place int, word string"), text_col="t")
    assert {r.doc_id: r.words for r in more.collect()} == {1: [], 2: ["key"], 3: [], 4: []}


def test_upkeep(spark):
    pairs = spark.createDataFrame([(1, 2, 0.9), (2, 3, 0.95), (4, 5, 0.8), (3, 6, 0.7)], "a long, b long, cosine double")
    assert values(M.greedy_pairs(pairs), "a", "b") == [(2, 3), (4, 5)]
    old = spark.createDataFrame([("x", 0.5), ("y", 0.5), ("z", 0.5)], "k string, v double")
    new = spark.createDataFrame([("x", 0.5), ("y", 0.55), ("w", 0.1)], "k string, v double")
    assert values(U.compared(old, new, "k", "v"), "k", "change") == [("w", "added"), ("x", "same"), ("y", "minor"), ("z", "removed")]


def test_shaping(spark):
    rows = spark.createDataFrame([('a {"k": 1,} b',), ('{"k": 2',), ("none",), (None,)], "t string").select(H.repaired_json(F.col("t"), "k long")["k"].alias("k"))
    assert [r.k for r in rows.collect()] == [1, 2, None, None]
    index = spark.createDataFrame([("3.9",), ("-1",), ("-2",), ("x",), (None,), ("NaN",)], "t string").select(H.paragraph_index(F.col("t")).alias("p"))
    assert [r.p for r in index.collect()] == [3, -1, -1, -1, -1, -1]
