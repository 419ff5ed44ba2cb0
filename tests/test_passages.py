from pyspark.sql import functions as F

from textlake.operators import passages as P

TEXT = "话说白娘子见了许仙，许仙道：“娘子请坐。”白娘子笑道官人不必客气\n白氏曰：去！" + "前" * 80 + "许仙道x" + "后" * 400


def test_speech_of_named_persons(spark):
    rows = P.spoken(spark.createDataFrame([(1, TEXT), (2, None), (3, "许仙道"), (4, "")], "doc_id long, text string"), ["许仙", "白娘子", "白氏"])
    got = [(r.name, r.mark, r.dialogue, r.context) for r in rows.orderBy("at").collect()]
    assert [g[:3] for g in got[:3]] == [("许仙", "许仙道：", "“娘子请坐。"), ("白娘子", "白娘子笑道", "官人不必客气"), ("白氏", "白氏曰：", "去！")]
    assert got[0][3] == "话说白娘子见了许仙，" and got[3][:2] == ("许仙", "许仙道") and len(got[3][2]) == 150 and got[3][3] == "前" * 50
    assert len(got) == 4
    twice = rows.unionByName(rows.withColumn("doc_id", F.lit(9)))
    assert [r.doc_id for r in P.first_dialogues(twice).collect()] == [1] * 4
    assert [r.mark for r in P.first_dialogues(twice, 2).collect()] == ["许仙道：", "白娘子笑道"]


def test_highlights_fall_back_level_by_level(spark):
    text = "The lake, the LAKE and 白娘子 by 西湖"
    cases = [([(1, 2)], "lake", "lake"), (None, " lake ", None), (None, "x", "…the LAKE and…"), (None, "x", "the LAKE axx yy"), (None, "『白娘子 + 西湖 + x』", None), (None, "『lake』", "ab"), (None, None, None), (None, "zz", "none of this")]
    table = spark.createDataFrame([(i, g, q, e) for i, (g, q, e) in enumerate(cases)], "i int, g array<struct<start:int,end:int>>, q string, e string")
    got = [[tuple(x) for x in r.h] for r in table.select("i", P.highlights(F.lit(text), F.col("g"), F.col("q"), F.col("e")).alias("h")).orderBy("i").collect()]
    assert got == [[(1, 2)], [(4, 8), (14, 18)], [(10, 22)], [(10, 25)], [(23, 26), (30, 32)], [(4, 8)], [], []]
    nothing = spark.range(1).select(P.highlights(F.lit(None).cast("string"), F.lit(None), F.lit("lake"), F.lit(None)).alias("h")).first().h
    assert nothing == []


def test_memories_by_words_and_vectors(spark):
    literal = spark.createDataFrame([("a", 1, 4.0), ("a", 2, 2.0), ("c", 7, 1.0)], "query_id string, doc_id long, score double")
    dense = spark.createDataFrame([("a", 2, 0.9), ("a", 3, 0.5), ("b", 4, 0.5), ("b", 5, 0.01)], "query_id string, doc_id long, score double")
    got = sorted((r.query_id, r["rank"], r.doc_id, r.score) for r in P.remembered(literal, dense, 2, least=0.05).collect())
    assert got == [("a", 1, 1, 0.5), ("a", 2, 2, 0.5), ("b", 1, 4, 0.4)]
