"""The registered queries on the smallest tables, and language ID against a naive computation."""

import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from textlake.llm import language_id
from textlake.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = {"op4": "pages", "op7": "conversations", "op10": "embeddings", "op12": "embeddings"}


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", list(QUERIES))
def test_query_covers_its_table(spark, name):
    out = QUERIES[name](spark, FOLDER)
    rows = spark.read.parquet(f"{FOLDER}/{TABLES.get(name.split('_')[0], 'documents')}.parquet")
    if name.startswith("op7"):
        assert out.count() == rows.select("conv_id").distinct().count() + 1
    elif name.startswith("op10"):
        assert out.select("query_id").distinct().count() == rows.where("vec_id % 20 = 0").count()
    elif name.startswith("op12"):
        assert out.select("anchor_id").distinct().count() <= rows.where("vec_id % 50 = 0").count()
    elif name.startswith("op3"):
        assert out.select("doc_id").distinct().count() == rows.select("doc_id").distinct().count()
    else:
        assert out.count() == rows.count()


def test_chat_orders_are_judged_by_the_query(spark, tmp_path):
    turns = {1: "user assistant", 2: "system user assistant user assistant", 3: "user user assistant", 4: "user", 5: "assistant user", 6: "user assistant system assistant", 7: "user other assistant"}
    rows = [(c, i, r, f"{r} {i} <&>") for c, roles in turns.items() for i, r in enumerate(roles.split())]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    out = {r.conv_id: r for r in QUERIES["op7_chat_format"](spark, str(tmp_path)).collect()}
    assert {c for c, r in out.items() if r.valid} == {-1, 1, 2}
    assert out[7].n_turns == 3 and out[6].loss_chars == len("assistant 1 <&>") + len("assistant 3 <&>")


def grams(text):
    line = "".join(c if c.isalpha() else " " for c in text.lower())
    line = " " + " ".join(line.split()) + " "
    return Counter(line[i : i + n] for n in (1, 2, 3) for i in range(len(line) - n + 1) if n > 1 or line[i] != " ") if line.strip() else Counter()


def ranks(counts):
    order = sorted(counts, key=lambda g: (-counts[g], int("".join(f"{ord(c):021b}" for c in g), 2)))[: language_id.TOP]
    return {g: i for i, g in enumerate(order)}


def test_language_by_naive_profiles(spark):
    texts = {"aa": ["the thing and other", "with which the end", "and then there"], "bb": ["der und nicht über", "wald und wiesen schön", "das ist der ort"], "cc": ["le chien et la", "une très été", "où est la rue"]}
    rows = [(i, t, k) for i, (k, t) in enumerate((k, t) for k, own in texts.items() for t in own)]
    asked = [(100, "the other end"), (101, "wald ist schön"), (102, "la rue très"), (103, "xyz"), (104, None), (105, "12 !?"), (106, "Ünd THE rue" * 50)]
    profiles = {}
    for k, own in texts.items():
        total = Counter()
        for t in own:
            total += grams(t)
        profiles[k] = ranks(total)
    want = {}
    for i, t in asked:
        own = ranks(grams(t or ""))
        if not own:
            want[i] = ("und", 0.0)
            continue
        apart = {k: sum(abs(p[g] - r) if g in p else language_id.TOP for g, r in own.items()) for k, p in profiles.items()}
        best = min(sorted(apart), key=apart.get)
        want[i] = (best, 1 - apart[best] / (language_id.TOP * len(own)))
    trained = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(spark.createDataFrame(asked, "doc_id long, text string"), trained).collect()}
    assert {i: x[0] for i, x in got.items()} == {i: x[0] for i, x in want.items()}
    assert all(got[i][1] == pytest.approx(want[i][1]) for i in want)


def test_language_names_are_found_on_held_out_texts(spark):
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables")
    out = QUERIES["op8_language_id"](spark, FOLDER).where("held_out").join(spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang"), "doc_id")
    right, n = out.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("double")), F.count("*")).first()
    assert n > 20 and right >= 0.97
