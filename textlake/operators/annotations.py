"""Annotated passages: filters, duplicates, locating, statistics, timelines, labels, scoped changes and exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textlake.functions import text as T


def index_filter(notes: DataFrame, query: str = "", fields: Sequence[str] = (), categories: Sequence[str] = (), origin: str | None = None, has_note: bool | None = None) -> DataFrame:
    """Rows with the query in any field (without regard to case), of the categories and origin, with or without a note."""
    hit = F.lit(not query)
    for f in fields:
        hit = hit | F.coalesce(F.lower(f).contains(query.lower()), F.lit(False))
    rows = notes.where(hit)
    rows = rows.where(F.col("category").isin(*categories)) if categories else rows
    rows = rows.where(F.col("origin") == origin) if origin else rows
    noted = F.coalesce(F.length(F.trim("note")) > 0, F.lit(False))
    return rows if has_note is None else rows.where(noted if has_note else ~noted)


def first_of(rows: DataFrame, key: Sequence[str | Column], order: Sequence[Column | str]) -> DataFrame:
    """One row of each key, the first in an order; each task keeps one row of a key, so a hot key is no one's burden."""
    place = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return rows.withColumn("__place", place).where("__place = 1").drop("__place")


def longest_fields(rows: DataFrame, key: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """One row per key with the longest value of each field (equal lengths: the greatest) and the number of rows merged."""
    best = [F.max(F.struct(F.length(f).alias("n"), F.col(f).alias("v")))["v"].alias(f) for f in fields]
    return rows.groupBy(*key).agg(*best, F.count("*").alias("merged"))


def cross_share(rows: DataFrame, key: str, by: str, values: Sequence[str]) -> DataFrame:
    """Per key: rows in all, rows of each value of `by`, and the key's percentage of all."""
    counts = rows.groupBy(key).agg(F.count("*").alias("total"), *[F.count_if(F.col(by) == v).alias(v) for v in values])
    whole = F.sum("total").over(Window.partitionBy())  # over a row for each key
    return counts.withColumn("percent", F.round(F.col("total") * 100 / whole, 2))


def timeline(notes: DataFrame, era: str, years: DataFrame) -> DataFrame:
    """Events, one per (entity, document, paragraph, category), with the years of their era (`years`: era, first_year,
    last_year, a small dimension); eras without years come last."""
    events = notes.dropDuplicates(["entity", "doc_id", "para", "category"])
    return events.join(years, era, "left").withColumn("era_order", F.coalesce("first_year", F.lit(9999)))


def era_summary(events: DataFrame, era: str, top: int = 10) -> DataFrame:
    """Per era: events, distinct entities, and the `top` most frequent entities."""
    each = events.groupBy(era, "entity").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy(era).orderBy(F.desc("n"), "entity"))
    best = each.withColumn("place", place)
    return best.groupBy(era).agg(
        F.sum("n").alias("events"), F.count("*").alias("entities"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("place") <= top, F.struct("place", "entity")))), lambda x: x["entity"]), ",").alias("top"),
    )


def unique_labels(rows: DataFrame, label: str, order: Sequence[str]) -> DataFrame:
    """Labels made unique: the first row of a label keeps it, each other gets the next number from 2 on that no label has with it."""
    place = F.row_number().over(Window.partitionBy(label).orderBy(*order))
    numbered = rows.select(F.regexp_extract(label, "^(.*)#([0-9]{1,9})$", 1).alias("__base"), F.regexp_extract(label, "^(.*)#([0-9]{1,9})$", 2).alias("n")).where("n <> '' and n not like '0%'")
    taken = numbered.groupBy("__base").agg(F.sort_array(F.collect_set(F.col("n").cast("int"))).alias("__taken"))
    met = rows.withColumn("__place", place).join(taken, F.col(label) == F.col("__base"), "left")
    used = F.filter(F.coalesce("__taken", F.array().cast("array<int>")), lambda x: x >= 2)
    free = F.aggregate(used, F.col("__place"), lambda m, x: F.when(x <= m, m + 1).otherwise(m))
    out = met.withColumn("unique_label", F.when(F.col("__place") == 1, F.col(label)).otherwise(F.concat(label, F.lit("#"), free.cast("string"))))
    return out.drop("__place", "__base", "__taken")


def paragraph_of(positions: DataFrame, paras: DataFrame, gap: int = 1) -> DataFrame:
    """(doc_id, pos) with the paragraph whose stretch of the document (paragraphs end to end, `gap` characters between) holds it.

    Paragraphs and positions of a document are put in one order, and each position takes the last paragraph that starts before
    it: one shuffle by document, no range join.
    """
    before = Window.partitionBy("doc_id").orderBy("para").rowsBetween(Window.unboundedPreceding, -1)
    size = F.length("paragraph").cast("bigint")
    spans = paras.select("doc_id", "para", F.coalesce(F.sum(size + gap).over(before), F.lit(0)).alias("start"), size.alias("size"))
    marks = spans.select("doc_id", F.col("start").alias("pos"), F.lit(0).alias("kind"), F.struct("para", "start", "size").alias("span"))
    asked = positions.select("doc_id", F.col("pos").cast("bigint"), F.lit(1).alias("kind"))
    order = Window.partitionBy("doc_id").orderBy("pos", "kind").rowsBetween(Window.unboundedPreceding, 0)
    met = marks.unionByName(asked, allowMissingColumns=True).withColumn("at", F.last("span", ignorenulls=True).over(order)).where("kind = 1")
    inside = F.col("pos") < F.col("at.start") + F.col("at.size")
    return met.select("doc_id", "pos", F.when(inside, F.col("at.para")).alias("para"), F.when(inside, F.col("pos") - F.col("at.start")).alias("offset"))


def locate_chunks(chunks: DataFrame, paras: DataFrame, least: int = 6) -> DataFrame:
    """(doc_id, chunk, level, para): the first paragraph of the document that holds the chunk whole (level 1), its middle 20
    (2) or its first 12 characters (3), all without white space; level 0 and paragraph -1 if none does."""
    own = chunks.select("doc_id", "chunk", T.without_space(F.col("content")).alias("c"))
    text = paras.select("doc_id", "para", T.without_space(F.col("paragraph")).alias("t"))
    keys = [F.col("c"), F.substring("c", F.greatest(F.lit(1), F.floor((F.length("c") - 20) / 2) + 1).cast("int"), F.lit(20)), F.substring("c", 1, 12)]
    level = F.coalesce(*[F.when((F.length(k) >= least) & F.contains(F.col("t"), k), F.lit(i + 1)) for i, k in enumerate(keys)])
    met = own.join(text, "doc_id", "left").withColumn("level", level)
    best = met.groupBy("doc_id", "chunk").agg(F.min(F.when(F.col("level").isNotNull(), F.struct("level", "para"))).alias("best"))
    return best.select("doc_id", "chunk", F.coalesce("best.level", F.lit(0)).alias("level"), F.coalesce("best.para", F.lit(-1)).alias("para"))


def scoped_delete(rows: DataFrame, scope: Column, children: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """`rows` outside the scope, and `children` whose row is still there (a null key has none)."""
    kept = rows.where(~F.coalesce(scope, F.lit(False)))
    return kept, children.join(kept.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_semi")


def cascade_delete(tables: dict[str, DataFrame], gone: DataFrame, key: str) -> dict[str, DataFrame]:
    """Every table without the rows of the keys in `gone`."""
    return {name: t.join(gone.select(key).distinct(), key, "left_anti") for name, t in tables.items()}


def merge_patch(rows: DataFrame, patch: DataFrame, key: Sequence[str], field: str) -> DataFrame:
    """`rows` with `field` replaced where the patch (one row per key) has a value."""
    new = patch.select(*key, F.col(field).alias("__new"))
    return rows.join(new, list(key), "left").withColumn(field, F.coalesce("__new", field)).select(*rows.columns)


def html_lines(notes: DataFrame) -> DataFrame:
    """A list item per note, escaped."""
    e = lambda c: T.html_escape(F.coalesce(F.col(c), F.lit("")))
    return notes.select("doc_id", "para", F.concat(F.lit('<li class="'), e("category"), F.lit('"><mark>'), e("entity"), F.lit("</mark> "), e("note"), F.lit("</li>")).alias("line"))


def plain_lines(notes: DataFrame) -> DataFrame:
    line = F.concat(F.lit("["), F.col("category"), F.lit("] "), F.col("entity"), F.when(F.col("note").isNotNull(), F.concat(F.lit(": "), F.col("note"))).otherwise(""))
    return notes.select("doc_id", "para", line.alias("line"))


def inline_marks(notes: DataFrame, paras: DataFrame) -> DataFrame:
    """Per paragraph with a note, its text with the first mention of the entity (the paragraph's least one) marked, escaped."""
    one = first_of(notes.select("doc_id", "para", "entity", "category"), ["doc_id", "para"], ["entity"])
    met = paras.join(one, ["doc_id", "para"])
    at = F.instr(F.col("paragraph"), F.col("entity"))
    before, after = F.substring("paragraph", F.lit(1), at - 1), F.substring("paragraph", at + F.length("entity"), F.length("paragraph"))
    marked = F.concat(T.html_escape(before), F.lit('<seg type="'), F.col("category"), F.lit('">'), T.html_escape(F.col("entity")), F.lit("</seg>"), T.html_escape(after))
    return met.select("doc_id", "para", marked.alias("line"))
