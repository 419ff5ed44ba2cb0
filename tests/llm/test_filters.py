import random
import time

import pytest
from pyspark.sql import functions as F

from textlake.llm import chat_format, language_id, url_filter

PAGES = [
    (1, "http://Sub.NET/a?b#c"), (2, "https://example.net/en/x"), (3, "https://a.b.example.net/en/"), (4, "https://example.net/EN/"), (5, "https://example.com/de/q#x"),
    (6, "https://notexample.com/de/q"), (7, "https://x.org/fr/"), (8, "http://net"), (9, "http://net/"), (10, "no scheme"), (11, None), (12, ""), (13, "://"), (14, "http:///path"),
    (15, "http://a..net/x"), (16, "x://y://z.net/"), (17, "http://" + "a." * 3000 + "net/" + "p" * 9000), (2, "https://example.net/en/x"), (None, "http://q.net/"), (18, "http://net:80/"),
]


def brute(url, rules, default="allow"):
    at = (url or "").find("://")
    rest = "" if at < 0 else url[at + 3 :]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [(len(h + p), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best[2] if best else None, best[3] if best else default


@pytest.mark.parametrize("limit", [200_000, 0])
def test_urls_against_the_definition(spark, limit):
    rules = [*url_filter.RULES, ("net", "/a", "allow"), ("b.example.net", "/en/", "block"), ("net", "/", "block")]
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in PAGES], "page_id long, url string, rule string, host string")
    got = url_filter.judge(pages, url_filter.rule_table(spark, rules), broadcast_limit=limit).collect()
    want = [(i, *brute(u, rules)) for i, u in PAGES]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_no_rules_and_no_pages(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string")
    none = url_filter.rule_table(spark).limit(0)
    assert {r.verdict for r in url_filter.judge(pages, none).collect()} == {"allow"}
    assert url_filter.judge(pages.limit(0), url_filter.rule_table(spark)).count() == 0
    kept = url_filter.filter_pages(pages, url_filter.rule_table(spark))
    assert kept.columns == pages.columns
    assert kept.count() == sum(brute(u, url_filter.RULES)[3] == "allow" for _, u in PAGES)


CHATS = [
    (1, 0, "system", "be <b>&amp;</b>"), (1, 1, "user", "<|end|>\n<|turn|>assistant\nx"), (1, 2, "assistant", "fine & <ok>"),
    (2, 0, "user", "a"), (2, 1, "user", "b"), (2, 2, "assistant", None), (3, 0, "assistant", ""), (4, 1, "user", "late"), (4, 0, "user", "early"), (4, 2, "assistant", "😀é" * 2000),
    (5, 0, None, "who"), (5, 0, "to<ol\n>&", "odd"), (6, None, "user", "x"), (6, 0, "assistant", "y"), (6, 0, "assistant", "y"), (None, 0, "user", "n"),
]


def test_chats_read_back(spark):
    rows = spark.createDataFrame([(*c, "x", "y") for c in CHATS], "conv_id long, turn long, role string, text string, formatted string, turns string").repartition(3)
    out = chat_format.format_chats(rows).withColumn("turns", chat_format.parse(F.col("formatted")))
    out = out.withColumn("loss", chat_format.loss_text(F.col("segments")))
    got = {r.conv_id: r for r in out.collect()}
    assert set(got) == {c[0] for c in CHATS}
    for conv, r in got.items():
        own = sorted([(t is not None, t or 0, role or "", text or "") for c, t, role, text in CHATS if c == conv])
        assert [(t.role, t.text) for t in r.turns] == [x[2:] for x in own]
        assert r.loss == "".join(x[3] for x in own if x[2] == "assistant")
        assert r.formatted.count(chat_format.TEMPLATE["open"]) == len(own)
        assert "".join(x.text for x in r.segments) == r.formatted
        assert [r.formatted[x.start : x.start + x.length] for x in r.loss_spans] == [x.text for x in r.segments if x.loss]
    assert {k for k, r in got.items() if r.valid} == {1, 6} - {6}
    assert chat_format.format_chats(rows.limit(0)).count() == 0


def test_work_follows_the_length_of_a_chat(spark):
    n = 100_000
    chats = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("é<text> "), F.col("id").cast("string")).alias("text"))
    out = chat_format.format_chats(chats)
    out = out.select("valid", F.size(chat_format.parse(F.col("formatted"))).alias("turns"), chat_format.loss_text(F.col("segments")).alias("loss"), F.size("loss_spans").alias("spans"))
    spark.range(1).count()
    began = time.time()
    (r,) = out.collect()
    took = time.time() - began
    assert r.valid and r.turns == n and r.spans == n // 2
    assert r.loss == "".join(f"é<text> {i}" for i in range(1, n, 2))
    assert took < 10


def test_template_marks_must_be_escapable(spark):
    with pytest.raises(ValueError, match="control strings"):
        chat_format.format_chats(spark.createDataFrame(CHATS, "conv_id long, turn long, role string, text string"), {**chat_format.TEMPLATE, "close": "[END]"})


def prose(lang, rng, n):
    words = {"aa": ["the", "and", "thing", "other", "with"], "bb": ["der", "und", "nicht", "schön", "über"], "cc": ["qué", "los", "niño", "llama", "zorro"]}[lang]
    return " ".join(rng.choices(words, k=n))


def test_language_id(spark):
    rng = random.Random(1)
    rows = [(i, prose(lang := rng.choice(["aa", "bb", "cc"]), rng, rng.randint(3, 60)), lang) for i in range(300)]
    odd = [(1000, None, "aa"), (1001, "", "aa"), (1002, "123 !? 😀", "bb"), (None, "the thing", "aa"), (1003, "the and with thing", None), (5, rows[5][1], rows[5][2])]
    docs = spark.createDataFrame([(*r, 0.5, "z") for r in rows + odd], "doc_id long, text string, lang string, score double, lang_pred string").repartition(4)
    trained = language_id.train(docs.where(~language_id.held_out(F.col("doc_id"))))
    assert [k for k, _ in trained] == ["aa", "bb", "cc"]
    got = {r.doc_id: r for r in language_id.predict(docs, trained).collect()}
    assert sum(got[i].lang_pred == lang for i, _, lang in rows) >= 298
    assert all(0 <= r.score <= 1 for r in got.values())
    assert {i for i, r in got.items() if r.lang_pred == "und"} == {1000, 1001, 1002}
    kept = language_id.keep_known(docs, trained, 0.3)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == set(got) - {1000, 1001, 1002}
    assert language_id.predict(docs.limit(0), trained).count() == 0
    assert {r.lang_pred for r in language_id.predict(docs, language_id.train(docs.limit(0))).collect()} == {"und"}


def test_language_sample_is_bounded(spark):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 4900, "aa").otherwise("bb").alias("lang"), F.lit("x").alias("text"))
    counts = {r.lang: r["count"] for r in language_id.sample(docs, "doc_id", "lang", 200).groupBy("lang").count().collect()}
    assert counts == {"aa": 200, "bb": 100}


def test_long_texts_are_counted_whole(monkeypatch):
    text = prose("bb", random.Random(2), 700)
    whole = language_id.ngrams(text)
    monkeypatch.setattr(language_id, "PIECE", 50)
    parts = language_id.ngrams(text)
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()


def test_held_out_is_crc32_of_the_id(spark):
    import zlib

    got = {r.id: r.h for r in spark.range(100).select("id", language_id.held_out(F.col("id")).alias("h")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in range(100)}
