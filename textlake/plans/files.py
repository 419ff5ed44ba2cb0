"""Queries through sources and sinks: what is written is read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from textlake.plans.search import PARAS, STRIP, paras
from textlake.sources import files as I
from textlake.sources.tables import table


def json_lines_round_trip(spark, sf):
    path = I.shared_folder(spark)
    docs = table(spark, sf, "documents")
    I.write_json_lines(docs, path)
    back = I.read_json_lines(spark, path, "doc_id long, text string, lang string, source string, n_chars long", "doc_id")
    return back.select("doc_id", F.md5("text").alias("digest"), "lang", "source", "n_chars")


DIGESTS = "SELECT doc_id, md5(text) AS digest, lang, source, n_chars FROM documents"


def csv_round_trip(spark, sf):
    path = I.shared_folder(spark)
    rows = table(spark, sf, "documents").select("doc_id", F.replace("text", F.lit("\r"), F.lit("")).alias("text"))
    I.write_csv(rows, path)
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').schema("doc_id long, text string").csv(path)
    return back.groupBy((F.col("doc_id") % 10).alias("digit")).agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


CSV = "SELECT doc_id % 10 AS digit, count(*) AS n, sum(length(replace(text, chr(13), '')))::BIGINT AS chars FROM documents GROUP BY 1"


def versions_latest(spark, sf):
    folder = I.shared_folder(spark)
    rows = table(spark, sf, "supplier")
    I.write_version(rows.withColumn("s_acctbal", F.lit(0.0)), folder, 1)
    I.write_version(rows, folder, 2)
    return I.read_version(spark, folder)


VERSIONS = "SELECT * FROM supplier"


def csv_export_lines(spark, sf):
    return I.csv_lines(table(spark, sf, "nation").withColumn("note", F.concat(F.lit('a "'), "n_name", F.lit('", b'))))


EXPORT = """SELECT n_nationkey || ',' || n_name || ',' || n_regionkey || ',"a ""' || n_name || '"", b"' AS line FROM nation"""


def stand_off_export(spark, sf):
    """A mark in each paragraph, as spans of its document."""
    rows = paras(spark, sf).select("doc_id", (F.col("para") * 10).alias("start_char"), (F.col("para") * 10 + 5).alias("end_char"), F.concat(F.lit("in "), "lang").alias("category"), F.concat("source", F.lit(" <&>")).alias("label"))
    return I.stand_off_xml(rows, "doc_id").select("doc_id", F.md5("xml").alias("xml"), F.length("xml").alias("chars"))


STAND_OFF = f"""WITH {PARAS}, x AS (SELECT doc_id, string_agg('<span from="' || para * 10 || '" to="' || para * 10 + 5 || '" type="in ' || lang || '">' || source || ' &lt;&amp;&gt;</span>', '' ORDER BY para) AS x FROM paras GROUP BY 1)
SELECT doc_id, md5('<spanGrp>' || x || '</spanGrp>') AS xml, length('<spanGrp>' || x || '</spanGrp>')::INT AS chars FROM x"""


def chapters_split(spark, sf):
    """Documents set as two chapters, and every fifth without headings."""
    own = F.concat(F.lit("一、 "), "source", F.lit("\n"), "text", F.lit("\n二、"), "lang", F.lit("\nthe end of "), "source")
    rows = table(spark, sf, "documents").where("text <> ''").select(F.col("doc_id").cast("string").alias("path"), F.when(F.col("doc_id") % 5 == 0, F.col("text")).otherwise(own).alias("text"))
    return I.read_chapters(rows).select("path", "chapter", "number", "title", F.md5("content").alias("content"))


CHAPTERS = rf"""WITH d AS (SELECT doc_id::VARCHAR AS path, doc_id, source, lang, regexp_replace(text, {STRIP}, '', 'g') AS t FROM documents WHERE text <> '')
SELECT path, 1 AS chapter, '' AS number, '全文' AS title, md5(t) AS content FROM d WHERE doc_id % 5 = 0 UNION ALL SELECT path, 1, '一', source, md5(t) FROM d WHERE doc_id % 5 <> 0
UNION ALL SELECT path, 2, '二', lang, md5('the end of ' || source) FROM d WHERE doc_id % 5 <> 0"""

QUERIES = {"json_lines_round_trip": json_lines_round_trip, "csv_round_trip": csv_round_trip, "versions_latest": versions_latest, "csv_export_lines": csv_export_lines, "stand_off_export": stand_off_export, "chapters_split": chapters_split}
ORACLE_SQL = {"json_lines_round_trip": DIGESTS, "csv_round_trip": CSV, "versions_latest": VERSIONS, "csv_export_lines": EXPORT, "stand_off_export": STAND_OFF, "chapters_split": CHAPTERS}
