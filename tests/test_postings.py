import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from textlake.functions import text as T
from textlake.operators import postings
from textlake.operators import search as R
from textlake.operators.postings import Index, counted


def texts(seed, n):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    return [(i, r.choice(["en", "de"]), " ".join(r.choices(words, weights=[60 - k for k in range(60)], k=r.randint(0, 40)))) for i in range(n)]


def naive(rows, query, where=lambda lang: True):
    docs = [(i, lang, (t or "").split()) for i, lang, t in rows]
    n, average = len(docs), max(1.0, sum(len(t) for *_, t in docs) / len(docs))
    df = Counter(w for *_, t in docs for w in set(t))
    out = {}
    for i, lang, t in docs:
        tf, score = Counter(t), 0.0
        for w, weight in query:
            if tf[w]:
                score += math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(t) / average)) * weight
        if score > 0 and where(lang):
            out[i] = score
    return out


def index_of(spark, path, *parts):
    index = Index(spark, str(path), ["doc_id"])
    for rows in parts:
        docs = spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(2)
        index.append(docs, T.words(F.col("text")), ["lang"])
    return index


QUERIES = {"a": [("w0", 1.0), ("w59", 1.0)], "b": [("w3", 1.0), ("w3", 1.0), ("w40", 0.5)], "c": [("none", 1.0)]}


@pytest.mark.parametrize("block", [4096, 16])
def test_scores_equal_a_naive_search_before_and_after_a_merge(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(postings, "BLOCK", block)
    monkeypatch.setattr(postings, "PER_PART", 60)
    monkeypatch.setattr(postings, "SEEDS", 2)
    rows = [*texts(1, 150), (900, "en", None), (901, "de", "")]
    more = [(i + 1000, k, t) for i, k, t in texts(2, 70)]
    index = index_of(spark, tmp_path / "i", rows, more)
    asked = R.query_table(index.log(), QUERIES)
    for merged in (False, True):
        if merged:
            index.merge()
            assert index.log().count() == 1
        for name, where in ((None, lambda k: True), ("de", lambda k: k == "de")):
            got = {(r.query_id, r.doc_id): r.score for r in index.bm25(asked, where=None if name is None else F.col("lang") == name, columns=["lang"]).collect()}
            want = {(q, i): s for q, terms in QUERIES.items() for i, s in naive(rows + more, [(t, w) for t, w in terms], where).items()}
            assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
            best = index.bm25(asked, k=5, where=None if name is None else F.col("lang") == name, columns=["lang"]).collect()
            for q in QUERIES:
                top = sorted((-s, i) for (p, i), s in want.items() if p == q)[:5]
                assert [r.doc_id for r in sorted((r for r in best if r.query_id == q), key=lambda r: r["rank"])] == [i for _, i in top]


def test_only_blocks_of_the_tokens_that_can_win_are_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "BLOCK", 16)
    index = index_of(spark, tmp_path / "i", texts(3, 200))
    tokens = spark.createDataFrame([("w5",), ("absent",), (None,)], "token string")
    found = index.blocks(tokens)
    assert {r.token for r in found.collect()} == {"w5"} and found.agg(F.max("n")).first()[0] <= 16
    plan = found._jdf.queryExecution().toString()
    assert "PushedFilters: [Or" in plan or "In(token" in plan or "EqualTo(token" in plan
    ids = {i: t for i, _, t in texts(3, 200)}
    matched = {r.doc_id: r.matched for r in index.matched(spark.createDataFrame([("w1",), ("w2",)], "token string")).collect()}
    assert matched == {i: n for i, t in ids.items() if (n := len({"w1", "w2"} & set(t.split())))}


def test_segments_count_once_they_are_in_the_log(spark, tmp_path, monkeypatch):
    index = index_of(spark, tmp_path / "i", texts(4, 30))
    before = index.statistics()
    monkeypatch.setattr(Index, "_commit", lambda *_: (_ for _ in ()).throw(OSError("lost")))
    docs = spark.createDataFrame(texts(5, 30), "doc_id long, lang string, text string")
    with pytest.raises(OSError, match="lost"):
        index.append(docs, T.words(F.col("text")), ["lang"])
    assert index.statistics() == before
    monkeypatch.undo()
    index.append(docs, T.words(F.col("text")), ["lang"])
    assert index.statistics()[0] == 60


def test_empty_tables(spark, tmp_path):
    index = index_of(spark, tmp_path / "i", [])
    asked = R.query_table(index.log(), QUERIES)
    assert index.bm25(asked).count() == 0 and index.bm25(asked, k=3).count() == 0
    assert index.matched(asked.select("token")).count() == 0


def test_counts_of_tokens(spark):
    rows = [(["b", "a", "b", None, "b"],), ([],), (None,), (["x"],)]
    got = [{t.token: t.tf for t in r.c} for r in spark.createDataFrame(rows, "t array<string>").select(counted(F.col("t")).alias("c")).collect()]
    assert got == [{"a": 1, "b": 3}, {}, {}, {"x": 1}]


def test_keywords_and_documents_with_all_tokens(spark, tmp_path):
    rows = [*texts(6, 60), (900, "en", None), (901, "en", "w1 w2 w3 rare")]
    index = index_of(spark, tmp_path / "i", rows[:30], rows[30:])
    sets = {i: set((t or "").split()) for i, _, t in rows}
    asked = {"a": ["w1", "w2", "w3"], "b": ["rare", "w1"], "c": ["none", "w1"], "d": ["w0"]}
    found = index.with_all(spark.createDataFrame([(q, t) for q, ts in asked.items() for t in ts] + [("a", None)], "query_id string, token string"), rarest=3).collect()
    assert sorted((r.query_id, r.doc_id) for r in found) == sorted((q, i) for q, ts in asked.items() for i, s in sets.items() if set(ts) <= s)
    n, df = len(rows), Counter(w for s in sets.values() for w in s)
    got = {}
    for r in R.tf_idf(index, 3).collect():
        got.setdefault(r.doc_id, []).append((r.place, r.word, r.tf, r.df))
    for i, _, t in rows:
        tf = Counter(w for w in (t or "").split() if len(w) >= 2)
        best = sorted(tf, key=lambda w: (-round(tf[w] * math.log(n / df[w]), 6), w))[:3]
        assert sorted(got.get(i, [])) == [(k, w, tf[w], df[w]) for k, w in enumerate(best, 1)]
