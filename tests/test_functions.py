import math
import random

import pytest
from pyspark.sql import functions as F

from textlake.functions import scoring as S
from textlake.functions import text as T


def values(spark, columns, *rows, schema="text string"):
    df = spark.createDataFrame(rows, schema)
    return [tuple(r) for r in df.select(*columns).collect()]


def test_cleaning(spark):
    col = F.col("text")
    got = values(spark, [T.clean(col)], ("﻿a\r\nb　  c\n\n\n\nd  e \n",), (None,), ("",))
    assert got == [("a\nb c\n\nd e",), (None,), ("",)]
    assert values(spark, [T.without_space(col), T.letters_and_digits(col), T.unify_marks(col)], ("A b　“C”1！",)) == [("Ab“C”1！", "abc1", 'Ab"C"1！')]


def test_paragraphs_join_back(spark):
    rng = random.Random(1)
    for _ in range(5):
        parts = ["".join(rng.choices("ab c.", k=rng.randint(1, 9))).strip() for _ in range(6)]
        parts = [p for p in parts if p]
        ((got,),) = values(spark, [T.paragraphs(F.col("text"))], (" \r\n\r\n".join(parts) + "\n\n\n\n",))
        assert got == parts


@pytest.mark.parametrize(("text", "word", "overlap", "apart"), [("aaaa", "aa", [0, 1, 2], [0, 2]), ("xabAB", "ab", [1, 3], [1]), ("ab", "abc", [], []), ("", "a", [], []), ("a.b.c", ".", [1, 3], [1, 3])])
def test_positions(spark, text, word, overlap, apart):
    got = values(spark, [T.overlapping_positions(F.col("text"), word), T.positions(F.col("text"), word), T.count_literal(F.col("text"), word)], (text,))
    assert got == [(overlap, apart, len(apart))]


def test_ngrams_and_sets(spark):
    assert values(spark, [T.char_ngrams(F.col("text"), 2)], ("abc",), ("a",), ("",)) == [(["ab", "bc"],), ([],), ([],)]
    assert values(spark, [T.word_ngrams(T.words(F.col("text")), 2)], ("One two, THREE",), ("x",)) == [(["one two", "two three"],), ([],)]
    assert values(spark, [T.fts_tokens(F.col("text"))], ("白蛇传 Ab1",)) == [(["白蛇", "蛇传", "ab1"],)]
    a, b = F.array(F.lit("x"), F.lit("y")), F.array(F.lit("y"), F.lit("z"), F.lit("z"))
    assert values(spark, [T.jaccard(a, b), T.coverage(a, b)], ("",)) == [(1 / 3, 0.5)]


def test_excerpt(spark):
    start = F.lit(5)
    assert values(spark, [T.excerpt(F.col("text"), start, start + 2, 2, 3)], ("0123456789ab",), ("01234ab",)) == [("…3456789…",), ("…34ab",)]


def test_repetition_marks_and_samples(spark):
    assert values(spark, [T.expand_repeats(F.col("text"))], ("悠七水匕十七",)) == [("悠悠水水十七",)]
    ((cut, short),) = values(spark, [T.sample(F.col("text"), 30), T.sample(F.col("text"), 900)], ("x" * 100 + "y" * 100,))
    assert cut == "x" * 10 + "\n…\n" + "x" * 5 + "y" * 5 + "\n…\n" + "y" * 10 and len(short) == 200


def test_vectors(spark):
    a, b = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(0.0), F.lit(0.0))
    ((n, c, z, u),) = values(spark, [S.norm(a), S.cosine(a, a), S.cosine(a, b), S.unit(a)], ("",))
    assert (n, round(c, 12), z, u) == (5.0, 1.0, 0.0, [0.6, 0.8])


def test_min_max_is_within_bounds(spark):
    rng = random.Random(2)
    rows = [(float(rng.randint(-5, 5)), k % 3) for k in range(60)] + [(7.0, 9), (7.0, 9), (None, 9)]
    from pyspark.sql import Window

    got = spark.createDataFrame(rows, "x double, k int").select("k", "x", S.min_max(F.col("x"), Window.partitionBy("k")).alias("y")).collect()
    assert all(0 <= r.y <= 1 for r in got if r.y is not None)
    assert {r.y for r in got if r.k == 9} == {0.5, None}


def test_recency_halves_each_half_period(spark):
    got = spark.createDataFrame([(0,), (45,), (90,), (None,)], "d int").select(S.recency(F.col("d"), F.lit(90))).collect()
    assert [r[0] for r in got] == [1.0, 0.5, 0.25, 0.5]


def test_reciprocal_ranks_fall(spark):
    got = [r[0] for r in spark.range(1, 30).orderBy("id").select(S.reciprocal_rank(F.col("id"), 0.5)).collect()]
    assert got == sorted(got, reverse=True) and math.isclose(got[0], 0.5 / 21)


def test_verbatim_quotes_in_capitals(spark):
    got = values(spark, [T.verbatim(F.col("q"), F.col("text"))], ("GROẞE STRAẞE", "die große Straße"), ("GROSSE STRASSE", "die große Straße"), ("GROSSE GASSE", "die große Straße"), schema="q string, text string")
    assert got == [(True,), (True,), (False,)]
