from pyspark.sql import functions as F

from textlake.operators import annotations as A
from textlake.operators import chunking as K
from textlake.operators import compare as P
from textlake.operators import search as R


def test_citations_are_kept_relabelled_marked_or_stripped(spark):
    evidence = spark.createDataFrame([("唐-ch1:1", "昔日白蛇出塔而去，众人皆惊。"), ("宋-ch2:3", "许仙借伞与白娘子，同舟而归。"), ("z", None)], "label string, text string")
    answers = [(1, "文中说“白蛇出塔而去”[唐-ch1:1]，又“借伞与白娘子”[唐-ch1:1]。"), (2, "“从未有过的话”[唐-ch1:1] “也没有的话”[元-ch9:9] “！！！！”[z]"), (3, "no citation"), (4, None), (1, "again “借伞与白娘子”[宋-ch2:3]")]
    got = sorted(tuple(r) for r in P.repair_citations(spark.createDataFrame(answers, "id long, text string"), evidence).collect())
    assert got == sorted([
        (1, "白蛇出塔而去", "唐-ch1:1", "keep", "唐-ch1:1"), (1, "借伞与白娘子", "唐-ch1:1", "relabel", "宋-ch2:3"), (1, "借伞与白娘子", "宋-ch2:3", "keep", "宋-ch2:3"),
        (2, "从未有过的话", "唐-ch1:1", "mark", "唐-ch1:1"), (2, "也没有的话", "元-ch9:9", "strip", None), (2, "！！！！", "z", "mark", "z"),
    ], key=lambda r: r[:4])


def test_spans_are_found_level_by_level(spark):
    text = "白素贞 与 许仙相遇于西湖断桥之上，小青随行。"
    rows = [(1, text, "许仙", 6, 8), (2, text, "西湖", 0, 2), (3, text, "白素贞与许仙", 0, 6), (4, text, "西湖断桥之下", 3, 9), (5, text, "法海", 0, 2), (6, text, "小青", -1, -1)]
    got = {r.id: (r.start, r.end, r.level, r.confidence) for r in P.repair_spans(spark.createDataFrame(rows, "id long, text string, entity string, start int, end int")).collect()}
    assert got == {1: (6, 8, "exact", "high"), 2: (11, 13, "window", "medium"), 3: (0, 8, "compact", "low"), 4: (10, 16, "fuzzy", "low"), 5: (-1, -1, "not_found", "none"), 6: (18, 20, "global", "low")}


def test_new_labels_go_round_those_that_are_there(spark):
    labels = ["x", "x", "x", "x#2", "x", "x#4", "x#4", "y", None, None, "x#02"]
    rows = spark.createDataFrame(list(enumerate(labels)), "i int, l string").repartition(3)
    got = {r.i: r.unique_label for r in A.unique_labels(rows, "l", ["i"]).collect()}
    assert [got[i] for i in range(8)] == ["x", "x#3", "x#5", "x#2", "x#6", "x#4", "x#4#2", "y"]
    named = [v for v in got.values() if v is not None]
    assert len(named) == len(set(named)) and got[10] == "x#02"


def test_more_queries_than_a_task_holds_meet_all_rows(spark, monkeypatch):
    vectors = spark.range(40).select(F.col("id").alias("vec_id"), F.array(F.cos(F.col("id").cast("double")), F.sin(F.col("id").cast("double"))).alias("embedding"))
    asked = spark.range(25).select(F.col("id").alias("query_id"), F.array(F.cos(F.col("id") * 1.7), F.sin(F.col("id") * 1.7)).alias("vector"))
    one = sorted(tuple(r) for r in R.vector_search(vectors, asked, 3).collect())
    monkeypatch.setattr(R, "HELD", 4)
    monkeypatch.setattr(R, "SPREAD", 3)
    assert sorted(tuple(r) for r in R.vector_search(vectors, asked, 3).collect()) == one and len(one) == 75


def test_rules_of_chunk_tables(spark):
    good = ("primary_huaben_1_00000", 0, "text", 4)
    bad = [("x", 1, "text", 4), ("primary_huaben_1_00001", -1, "text", 4), ("primary_huaben_1_00002", 2, " ", 1), ("primary_huaben_1_00003", 3, "text", 5), good]
    got = sorted((r.chunk_id, r.rule) for r in K.violations(spark.createDataFrame([good, *bad], "chunk_id string, seq int, content string, chars int")).collect())
    assert got == [("primary_huaben_1_00000", "repeated id"), ("primary_huaben_1_00001", "negative position"), ("primary_huaben_1_00002", "empty content"), ("primary_huaben_1_00003", "length differs"), ("x", "bad id")]


def test_metadata_of_chunks(spark):
    import json

    good = {f: "x" for f in K.REQUIRED} | {"chunk_id": "primary_huaben_1_00000", "source_type": "p", "source_file": "f", "paragraph_index": 0, "char_start": 1, "char_end": 2, "strategy": "other"}
    bad = [
        {"chunk_id": "x"}, {"chapter_number": 3}, {"source_file": "g"}, {"char_end": 1}, {"context_prefix": "ab", "context_prefix_length": 3}, {"paragraph_index": -1}, {"strategy": "structural_scene"},
        {"strategy": "structural_scene", "paragraph_index": -1, "scene_index": 0, "context_prefix_length": 0}, {"dynasty": None},
    ]
    rows = [json.dumps(good), *[json.dumps(good | {"chunk_id": f"primary_huaben_1_{i:05}"} | b) for i, b in enumerate(bad, 1)], json.dumps({k: v for k, v in good.items() if k != "dynasty"})]
    got = sorted((r.chunk_id, r.rule) for r in K.metadata_errors(spark.createDataFrame([(r,) for r in rows], "meta string"), {"p": "f"}).collect())
    name = lambda i: f"primary_huaben_1_{i:05}"
    assert got == sorted([
        ("x", "bad id"), (name(2), "chapter is no text"), (name(3), "file of another source"), (name(4), "end before start"), (name(5), "prefix of another length"), (name(6), "negative paragraph"),
        (name(7), "missing field scene_index of structural_scene"), (name(7), "missing field context_prefix_length of structural_scene"), (name(0), "missing field dynasty"), (name(0), "repeated id"),
    ])
    broken = K.metadata_errors(spark.createDataFrame([("no json",), (None,)], "meta string"), {}).collect()
    assert len(broken) == 2 * (len(K.REQUIRED) + 1)
