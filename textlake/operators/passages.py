"""What a reader is shown: speech of a person, places to mark in a paragraph, memories for a question.

Defined cases
    null text, query or excerpt: nothing found.    names and marks: taken as they are (marks are patterns).     ties: by id and place.
    a question without literal hits: its nearest vectors, at a discount.     scores of one question that are all equal: 0.
    empty tables: no rows.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textlake.functions import text as T
from textlake.operators.genres import pieces

# What follows a name before speech; the end of a sentence; the sizes of speech and context.
SPEAKS = r"(?:笑道|说道|怒道|叹道|叫道|喊道|问道|答道|道|说|曰|云|言)[：:]?"
MOST, CUT, LEAST, BEFORE, SAME, SHOWN = 300, 150, 2, 50, 30, 25


def spoken(texts: DataFrame, names: Sequence[str], marks: str = SPEAKS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, at, name, mark, dialogue, context) for each name followed by a mark of speech: the first sentence after it within MOST
    characters (else CUT of them), of LEAST characters at least, and up to BEFORE characters before."""
    pattern = "(?:" + "|".join(re.escape(n) for n in sorted(names, key=lambda n: (-len(n), n))) + ")" + marks
    found = pieces(texts.select(F.col(id_col), F.col(text_col).alias("__text")), [id_col, "__text"], "__text", pattern).where("mark is not null")
    raw = F.substring("__text", F.col("at") + F.length("mark") + 1, F.lit(MOST))
    sentence = F.regexp_extract(raw, r"^([^。！？\n]*[。！？\n])", 1)
    said = F.when(sentence != "", T.strip(sentence)).otherwise(F.substring(T.strip(raw), 1, CUT))
    start = F.greatest(F.col("at") - BEFORE, F.lit(0))
    name = F.coalesce(*[F.when(F.col("mark").startswith(n), F.lit(n)) for n in sorted(names, key=lambda n: (-len(n), n))])
    rows = found.select(id_col, "at", name.alias("name"), "mark", said.alias("dialogue"), F.substring("__text", start + 1, F.col("at") - start).alias("context"))
    return rows.where(F.length("dialogue") >= LEAST)


def first_dialogues(rows: DataFrame, most: int = SHOWN, id_col: str = "doc_id") -> DataFrame:
    """The first `most` rows of `spoken` in the order of the texts, once for each beginning of SAME characters."""
    once = rows.groupBy(F.substring("dialogue", 1, SAME).alias("begin")).agg(F.min(F.struct(id_col, "at", "name", "mark", "dialogue", "context")).alias("r"))
    return once.select("r.*").orderBy(id_col, "at").limit(most)


def highlights(text: Column, given: Column, query: Column, excerpt: Column) -> Column:
    """array<struct<start, end>> to mark in a paragraph: the ranges given; else where the query stands; else the excerpt without its dots,
    or its first ten characters; else the entities that the query names in 『』, parted by ' + '."""
    kind = "array<struct<start:int,end:int>>"
    none = F.array().cast(kind)
    ranges = lambda starts, size: F.transform(starts, lambda s: F.struct(s.cast("int").alias("start"), (s + size).cast("int").alias("end")))
    asked = F.trim(F.coalesce(query, F.lit("")))
    by_query = F.when(F.length(asked) >= 2, ranges(T.overlapping_positions(text, asked), F.length(asked))).otherwise(none)
    own = F.trim(F.regexp_replace(F.trim(F.coalesce(excerpt, F.lit(""))), "^[…⋯]+|[…⋯]+$", ""))
    head = F.substring(own, 1, 10)
    place = lambda w: F.instr(text, w) - 1
    whole = F.array(F.struct(place(own).cast("int").alias("start"), (place(own) + F.length(own)).cast("int").alias("end")))
    begin = F.array(F.struct(place(head).cast("int").alias("start"), (place(head) + F.least(F.length(own), F.length(text) - place(head))).cast("int").alias("end")))
    by_excerpt = F.when(F.length(own) < 4, none).when(place(own) >= 0, whole).when(place(head) >= 0, begin).otherwise(none)
    named = F.split(F.regexp_extract(F.coalesce(query, F.lit("")), "『([^』]+)』", 1), r" \+ ")
    entities = F.filter(F.transform(named, F.trim), lambda e: F.length(e) >= 2)
    exact = lambda e: F.filter(ranges(T.overlapping_positions(text, e), F.length(e)), lambda r: F.substring(text, r["start"] + 1, F.length(e)) == e)
    by_entity = F.flatten(F.transform(entities, exact))
    known = F.coalesce(given.cast(kind), none)
    first = F.when(F.size(known) > 0, known).when(F.size(by_query) > 0, by_query).when(F.size(by_excerpt) > 0, by_excerpt).otherwise(by_entity)
    return F.when(text.isNull(), none).otherwise(first)


def _scaled(rows: DataFrame, name: str) -> DataFrame:
    ends = rows.groupBy("query_id").agg(F.min("score").alias("low"), F.max("score").alias("high"))
    value = F.when(F.col("high") > F.col("low"), (F.col("score") - F.col("low")) / (F.col("high") - F.col("low"))).otherwise(0.0)
    return rows.join(ends, "query_id").select("query_id", "doc_id", value.alias(name))


def remembered(literal: DataFrame, dense: DataFrame, k: int, weight: float = 0.5, least: float = 0.0, alone: float = 0.8) -> DataFrame:
    """(query_id, doc_id, score, rank): memories by words and by vectors (both: query_id, doc_id, score), each scaled to [0, 1] within
    its question and weighed, a missing side 0. Questions without literal hits get their vectors' own scores times `alone`."""
    hit = literal.select("query_id").distinct()
    both = _scaled(literal, "l").join(_scaled(dense.join(hit, "query_id", "left_semi"), "d"), ["query_id", "doc_id"], "full")
    fused = both.select("query_id", "doc_id", (F.coalesce("l", F.lit(0.0)) * weight + F.coalesce("d", F.lit(0.0)) * (1 - weight)).alias("score"))
    only = dense.join(hit, "query_id", "left_anti").select("query_id", "doc_id", (F.col("score") * alone).alias("score"))
    rows = fused.unionByName(only).withColumn("score", F.round("score", 6)).where(F.col("score") >= least)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    return rows.withColumn("rank", place).where(F.col("rank") <= k)
