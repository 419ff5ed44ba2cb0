import random

import pytest
from pyspark.sql import functions as F

from textlake.operators import alignments as L
from textlake.operators import chunking as K
from textlake.operators import corpus as C
from textlake.operators import events as E
from textlake.operators import memory as M
from textlake.operators import patterns as D
from textlake.operators import search as R
from textlake.operators import verify as V
from textlake.sources import files as I
from textlake.streaming import keyed, streams


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, "en", "red fox\nblue fox red"), (2, "en", "blue sky\n\nred sun"), (3, None, "fox"), (4, "de", ""), (5, "de", "der fox der")]
    return spark.createDataFrame(rows, "doc_id long, lang string, text string")


def test_counts_add_up(docs):
    got = {r.lang: (r.n, r.share) for r in C.literal_counts(docs, "fox", "lang").collect()}
    assert got == {"en": (2, 0.5), "other": (1, 0.25), "de": (1, 0.25)}


def test_cooccurrence_is_symmetric_and_bounded(docs):
    hits = C.term_hits(C.paragraphs(docs), ["red", "blue", "fox"])
    got = {(r.a, r.b): r.n for r in C.band_cooccurrence(hits, 1).collect()}
    assert all(got[b, a] == n for (a, b), n in got.items())
    assert got["red", "red"] == 3 and got["red", "blue"] == 3 and got["red", "fox"] == 4


@pytest.mark.parametrize("window", [0, 1, 3])
def test_band_join_equals_all_pairs(spark, window):
    rng = random.Random(window)
    hits = [(rng.choice("abc"), rng.randint(0, 2), rng.randint(0, 12)) for _ in range(60)]
    want = {}
    for i, x in enumerate(hits):
        for j, y in enumerate(hits):
            if x[1] == y[1] and x[0] != y[0] and abs(x[2] - y[2]) <= window and i != j:
                want[x[0], y[0]] = want.get((x[0], y[0]), 0) + 1
    got = {(r.a, r.b): r.n for r in C.band_cooccurrence(spark.createDataFrame(hits, "term string, doc_id int, para int"), window).collect() if r.a != r.b}
    assert got == want


def test_bm25_drops_absent_tokens_and_breaks_ties(docs):
    found = R.top_k(R.bm25(docs, R.query_table(docs, {"q": [("fox", 1.0), ("zebra", 1.0)]})), 10).collect()
    assert [r.doc_id for r in sorted(found, key=lambda r: r["rank"])][0] == 3  # the shortest text with the word
    assert all(r.score > 0 for r in found) and len(found) == 3


def test_fusion_with_an_empty_side(spark, docs):
    empty = spark.createDataFrame([], "doc_id long, score double")
    one = spark.createDataFrame([(1, 2.0), (2, 2.0)], "doc_id long, score double")
    assert rows_of(R.fuse_scores(one, empty)) == [(1, 0.25), (2, 0.25)]
    assert R.fuse_scores(empty, empty).count() == 0


def test_changes_and_trend(spark):
    cells = spark.createDataFrame([("t", 0, "a", 0, 0), ("t", 0, "b", 1, 4), ("t", 0, "c", 2, 0), ("t", 0, "d", 3, 0)], "term string, t int, lang string, k int, n long")
    assert [(r.from_key, r.to_key, r.change) for r in C.changes(cells, "lang").orderBy("from_key").collect()] == [("a", "b", "emergence"), ("b", "c", "disappearance"), ("c", "d", "substitution")]
    assert {(r.lang, r.scaled, r.direction) for r in C.trend(cells).collect()} == {("a", 0.0, "stable"), ("b", 1.0, "stable"), ("c", 0.0, "stable"), ("d", 0.0, "stable")}


def test_windows_cover_all_paragraphs(docs):
    paras = C.paragraphs(docs)
    n = {r.doc_id: r["count"] for r in paras.groupBy("doc_id").count().collect()}
    got = rows_of(C.windows(paras).select("doc_id", "start", "n_paras"))
    assert got == sorted((d, 0, k) for d, k in n.items())


def test_exact_duplicates_and_changes(spark, docs):
    twice = docs.unionByName(docs.where("doc_id in (1, 3)").withColumn("doc_id", F.col("doc_id") + 10))
    assert rows_of(V.exact_duplicates(twice)) == [(1, 2), (3, 2)]
    new = docs.where("doc_id < 5").withColumn("text", F.when(F.col("doc_id") == 2, "x").otherwise(F.col("text"))).unionByName(docs.limit(1).withColumn("doc_id", F.lit(99).cast("long")))
    assert rows_of(V.changed(docs, new, "doc_id", "text")) == [(2, "changed"), (5, "removed"), (99, "added")]


def test_quotes_are_verified_word_for_word(spark):
    quotes = spark.createDataFrame([(1, "a b c d e f g h i"), (2, "a b c d e f g h x"), (3, "too short")], "item_id int, text string")
    docs = spark.createDataFrame([(7, "So: A b, c d e f g h i! a b c d e f g h i"), (8, "a b c d e f g h ix")], "doc_id int, text string")
    assert rows_of(V.verify_quotes(quotes, docs)) == [(1, 1, 7, True), (2, 0, None, False)]


def test_quotes_need_no_index_and_one_pass(spark, monkeypatch):
    """The query builds no index of all words, and the plan reads and shuffles no text a second time; a repeated id counts by rows."""
    from textlake.plans import analytics, search

    quotes = spark.createDataFrame([(1, "a b c d e f g h i"), (2, "a b c d e f g h x"), (3, "too short")], "item_id int, text string")
    texts = [(7, "So: A b, c d e f g h i! a b c d e f g h i"), (7, "a b c d e f g h I"), (8, "a b c d e f g h ix"), (9, None), (10, "a b c d e f g")]
    tables = {"benchmark": quotes, "documents": spark.createDataFrame(texts, "doc_id int, text string")}
    monkeypatch.setattr(analytics, "table", lambda spark, sf, name: tables[name])
    monkeypatch.setattr(search, "table", None)  # the index would read it
    found = analytics.quote_verification(spark, "")
    assert rows_of(found) == [(1, 2, 7, True), (2, 0, None, False)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("doc_id#") and plan.count("LogicalRDD [doc_id#") == 1


@pytest.mark.parametrize("seed", range(4))
def test_diff_rebuilds_the_right_side(spark, seed):
    rng = random.Random(seed)
    left, right = ("".join(rng.choices("abc", k=rng.randint(0, 30))) for _ in range(2))
    rows = L.diff(spark.createDataFrame([(1, left, right)], "pair_id long, left string, right string")).collect()
    out, at = "", 0
    for r in sorted(rows, key=lambda r: (r.position, r.op != "insert")):
        before = "" if r.before == L.EMPTY else r.before
        out += left[at : r.position - 1] + ("" if r.after == L.EMPTY else r.after)
        at = r.position - 1 + len(before)
    assert out + left[at:] == right


def test_dictionary_prefers_longer_entries(spark):
    docs = spark.createDataFrame([(1, "白娘子与白蛇、白"), (2, None)], "doc_id long, text string")
    assert rows_of(D.scan(docs, spark.createDataFrame([("白",), ("白蛇",), ("白娘子",)], "entry string"))) == [(1, "白", 7, 8), (1, "白娘子", 0, 3), (1, "白蛇", 4, 6)]


def test_sentences_and_packing():
    assert K.split_sentences("他说：“走吧。走！”然后走了。是吗？是") == ["他说：“走吧。走！”然后走了。", "是吗？", "是"]
    assert K.split_sentences("他说\"走。\"了。‘是！’）吗？）") == ["他说\"走。\"了。", "‘是！’）吗？）"]
    assert K.split_sentences("a. b! (c. d) e.", K.LATIN_ENDS, straight=False) == ["a.", "b!", "(c. d) e."]
    assert K.split_sentences("") == [] and K.split_sentences("no end") == ["no end"]
    rng = random.Random(1)
    text = "".join(rng.choices("ab 。，", k=3000))
    assert "".join(K.cut_long(text, 100)) == text and max(map(len, K.cut_long(text, 100))) <= 100
    assert "".join(K.window(text)) == text and all(len(w) <= 660 for w in K.window(text))
    packed = K.pack(K.split_sentences(text), 200, 50)
    assert all(len(c) <= 260 for c in packed)
    merged = K.merge_similar(["aaaa bbbb", "aaaa bbbb", "zzzz yyyy"], 0.9, 100, 0)
    assert merged == ["aaaa bbbb\naaaa bbbb", "zzzz yyyy"]


def test_chunk_ids_parse(spark):
    got = spark.createDataFrame([("primary_imitation_huaben_3_00012",)], "c string").select(*K.parse_chunk_id(F.col("c"))).first()
    assert tuple(got) == ("primary", "imitation_huaben", "3", "00012")


def test_budgets(spark):
    rows = spark.createDataFrame([(1, i, n) for i, n in enumerate([50, 60, 30, 10])], "k int, turn long, n int")
    assert [r.turn for r in M.fits_budget(rows, "k", [F.asc("turn")], F.col("n"), 100).collect()] == [0]
    assert M.fits_budget_skipping(rows, "k", ["turn"], F.col("n"), 100, "turn").first().kept == [0, 2, 3]
    assert [r.turn for r in M.fits_budget(rows, "k", [F.asc("turn")], F.col("n"), 110).collect()] == [0, 1]  # exactly full


def test_expiry_boundaries(spark):
    rows = [("Entity", 0.59, 180, False), ("Entity", 0.59, 181, True), ("Entity", 0.60, 999, False), ("System", 0.0, 9999, False), ("Working", 0.29, 8, True), ("Other", 0.0, 9999, False)]
    got = spark.createDataFrame(rows, "t string, i double, d int, want boolean").select(M.expired(F.col("t"), F.col("i"), F.col("d")).alias("got"), "want").collect()
    assert all(r.got == r.want for r in got)


def test_sessions_start_after_the_gap(spark):
    rows = [(i, 1, f"2024-01-01 00:{m:02d}:00") for i, m in enumerate([0, 30, 59])] + [(9, 1, "2024-01-01 01:29:01"), (10, 2, "2024-01-01 00:00:00")]
    ev = spark.createDataFrame(rows, "event_id long, user_id long, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    assert sorted((r.user_id, r.session, r.n) for r in E.sessions(ev, "user_id", "ts", 30).collect()) == [(1, 1, 3), (1, 2, 1), (2, 1, 1)]


def test_files_round_trips(spark, docs, tmp_path):
    I.write_json_lines(docs, str(tmp_path / "j"))
    back = I.read_json_lines(spark, str(tmp_path / "j"), "doc_id long, lang string, text string", "doc_id")
    assert rows_of(back) == rows_of(docs)
    (tmp_path / "sheet.csv").write_text('n,s\n12,"a ""b"", c"\nx,\n,\n')
    assert rows_of(I.read_sheet(spark, str(tmp_path / "sheet.csv"), ("n",))) == [(0, ""), (12, 'a "b", c')]
    (tmp_path / "log.txt").write_text('INFO {"a": 1}\nnothing\nWARN x {"a": 2}\n')
    assert rows_of(I.read_log(spark, str(tmp_path / "log.txt"), "a int")) == [(1,), (2,)]
    assert rows_of(I.read_texts(spark, str(tmp_path / "log.txt")).select("text")) == [('INFO {"a": 1}\nnothing\nWARN x {"a": 2}\n',)]
    folder = str(tmp_path / "versions")
    I.write_version(docs, folder, 1), I.write_version(docs.limit(1), folder, 2)
    assert I.read_version(spark, folder).count() == 1 and I.read_version(spark, folder, 1).count() == 5
    I.append_changes(docs.select("doc_id"), str(tmp_path / "log"), 1), I.append_changes(docs.select("doc_id"), str(tmp_path / "log"), 2)
    latest = I.current(spark.read.parquet(str(tmp_path / "log")), "doc_id", F.desc("batch_id"))
    assert rows_of(latest) == [(d, 2) for d in range(1, 6)]


def test_evictions_equal_the_batch_fold(spark, tmp_path):
    rng = random.Random(4)
    rows = [(c, t, "user", "x" * rng.randint(0, 200)) for c in range(5) for t in range(12)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    stream = streams.stream(spark, str(tmp_path), "conversations").withColumn("tokens", F.floor(F.length("text") / 4))
    out = keyed.keyed(stream, "conv_id", F.timestamp_seconds(F.col("turn") + 1), F.lit(0), ["turn", "tokens"], keyed.Evictions(60), "0 seconds", 30)
    got = rows_of(streams.run(out, "append").select("conv_id", "turn", "tokens"))
    want = []
    for c in range(5):
        held = []
        for _, t, _, x in [r for r in rows if r[0] == c]:
            held.append((c, t, len(x) // 4))
            while sum(h[2] for h in held) > 60 and len(held) > 1:
                want.append(held.pop(0))
    assert got == sorted(want, key=repr)
