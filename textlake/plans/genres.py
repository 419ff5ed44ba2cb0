"""Chunks by layout. The test tables hold no plays: conversations are set as such (a conversation an act or scene, a turn a tune or a
speaker's lines), documents as papers with a title."""

from __future__ import annotations

from pyspark.sql import functions as F

from textlake.operators import chunking as K
from textlake.operators import genres as G
from textlake.operators import located as L
from textlake.plans.search import PARAS, paras
from textlake.sources.tables import table


def _set(spark, sf, title: str, turn):
    """(conv_id, text): a heading line, then all turns in order."""
    t = table(spark, sf, "conversations").select("conv_id", F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    turns = F.array_join(F.transform(F.sort_array(F.collect_list("t")), turn), "\n")
    return t.groupBy("conv_id").agg(F.concat(F.lit("第"), F.pmod("conv_id", F.lit(90)).cast("string"), F.lit(title), turns).alias("text"))


def play_chunks(spark, sf):
    plays = _set(spark, sf, "出 a talk\n", lambda t: F.concat(F.lit("【"), t["role"], F.lit("】\n"), t["text"]))
    rows = G.acts(plays, most=1_000_000, id_col="conv_id").join(plays, "conv_id")  # turns stay whole: SQL does not cut by sentences
    back = F.substring("text", F.col("char_start") + 1, F.col("chars")) == F.col("body")
    return rows.select("conv_id", "seq", "act_index", "act", "tune", F.md5("content").alias("content"), "chars", back.alias("in_place"))


PLAYS = r"""WITH t AS (SELECT conv_id, turn, role, regexp_replace(regexp_replace(coalesce(text, ''), '^[\s\x0b\x{3000}]+', ''), '[\s\x0b\x{3000}]+$', '') AS body FROM conversations),
x AS (SELECT conv_id, turn, role, body, '第' || conv_id % 90 || '出 a talk' AS act FROM t WHERE length(body) BETWEEN 60 AND 1000000)
SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, body) - 1)::INT AS seq, 0 AS act_index, act, role AS tune, md5(act || ' · 【' || role || '】' || chr(10) || body) AS content, length(body)::INT AS chars, true AS in_place FROM x"""


def _script(spark, sf):
    return _set(spark, sf, "场 a talk\n", lambda t: F.concat(F.when(t["role"] == "user", "客").otherwise("答"), F.lit("（白）"), t["text"]))


def script_parts(spark, sf):
    rows = G.spoken_lines(_script(spark, sf), id_col="conv_id")
    return rows.select("conv_id", "scene_index", "scene", "kind", "speaker", "mode", F.md5("text").alias("text"))


SCRIPT = r"""SELECT conv_id, 0 AS scene_index, '第' || conv_id % 90 || '场 a talk' AS scene, 'dialogue' AS kind, CASE WHEN role = 'user' THEN '客' ELSE '答' END AS speaker, '白' AS mode,
md5(array_to_string(list_filter(list_transform(string_split(CASE WHEN role = 'user' THEN '客' ELSE '答' END || '（白）' || coalesce(text, ''), chr(10)), lambda l: regexp_replace(regexp_replace(l, '^[\s\x0b\x{3000}]+', ''), '[\s\x0b\x{3000}]+$', '')), lambda l: l <> ''), chr(10))) AS text
FROM conversations"""


def script_chunks(spark, sf):
    return G.scenes(_script(spark, sf), id_col="conv_id").select("conv_id", "seq", "kind", F.size("speakers").alias("speakers"), "chars", F.md5("content").alias("content"))


def _papers(spark, sf):
    return table(spark, sf, "documents").where("text is not null").select("doc_id", F.concat(F.lit("1. "), "source", F.lit("\n"), F.col("text")).alias("text"))


def paper_layout(spark, sf):
    return G.typed_paragraphs(_papers(spark, sf), separator="\n").groupBy("kind").agg(F.count("*").alias("n"), F.sum(F.length("paragraph")).alias("chars"))


LAYOUT = r"""WITH d AS (SELECT list_filter(list_transform(string_split(replace('1. ' || source || chr(10) || text, chr(13) || chr(10), chr(10)), chr(10)), lambda x: regexp_replace(x, '^[ \t\n\r\x{3000}]+|[ \t\n\r\x{3000}]+$', '', 'g')), lambda x: x <> '') AS ps FROM documents WHERE text IS NOT NULL),
p AS (SELECT unnest(ps) AS p FROM d)
SELECT CASE WHEN regexp_matches(p, '^\s*(前\s*言|绪\s*论|结\s*[语论]|参考\s*文献|附\s*录|[（(][一二三四五六七八九十]+[）)]|[（(]\d+[）)]|\d+(?:\.\d+)*[\.、]|第[一二三四五六七八九十\d]+[章节]|[一二三四五六七八九十]{1,3}\s{1,3}[^\n]{1,80})') THEN 'section'
 WHEN regexp_matches(p, '^图\s*\d+') THEN 'figure' WHEN regexp_matches(p, '^表\s*\d+') THEN 'table' ELSE 'text' END AS kind, count(*) AS n, sum(length(p))::BIGINT AS chars FROM p GROUP BY 1"""


def paper_chunks(spark, sf):
    return G.papers(_papers(spark, sf), separator="\n").select("doc_id", "seq", "path", "first_para", "last_para", "chars", F.md5("content").alias("content"))


def paper_coverage(spark, sf):
    """Every paragraph of a paper is in one chunk, in order; long ones in several pieces of a chunk's group."""
    rows = G.papers(_papers(spark, sf), separator="\n")
    one = rows.select("doc_id", "path", "first_para", "last_para").distinct()
    return one.groupBy("path").agg(F.sum(F.col("last_para") - F.col("first_para") + 1).alias("paras"), F.min("first_para").alias("first"))


COVERAGE = r"""WITH d AS (SELECT '1. ' || source AS path, list_filter(list_transform(string_split(replace('1. ' || source || chr(10) || text, chr(13) || chr(10), chr(10)), chr(10)), lambda x: regexp_replace(x, '^[ \t\n\r\x{3000}]+|[ \t\n\r\x{3000}]+$', '', 'g')), lambda x: x <> '') AS ps FROM documents WHERE text IS NOT NULL)
SELECT path, sum(len(ps))::BIGINT AS paras, 0 AS first FROM d WHERE len(ps) > 1 GROUP BY 1"""


def _triples(rows):
    """Paragraphs by threes, as chunks whose places are to be found again."""
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("para", "paragraph"))), lambda x: x["paragraph"]), "\n")
    return rows.groupBy("doc_id", F.floor(F.col("para") / 3).cast("int").alias("seq")).agg(joined.alias("content"))


def ordered_places(spark, sf):
    """The paragraph at which each chunk begins, found by its lines and their order."""
    rows = paras(spark, sf)
    return L.in_order(_triples(rows), rows)


PLACES = rf"""WITH {PARAS}, n AS (SELECT doc_id, para, para // 3 AS seq, length(regexp_replace(p, '[\s\x0b\x{{3000}}\x{{00A0}}]+', '', 'g')) AS n FROM paras)
SELECT doc_id, seq::INT AS seq, coalesce(min(para) FILTER (n >= 6), -1)::INT AS para, CASE WHEN max(n) >= 6 THEN 'chain' ELSE 'none' END AS method FROM n GROUP BY 1, 2"""

def chunk_metadata_errors(spark, sf):
    """Which rules the metadata of the chunks by threes break; every ninth document's chapter is a number."""
    rows = paras(spark, sf)
    places = L.in_order(_triples(rows), rows)
    chapter = F.col("doc_id").cast("string")
    head = F.struct(F.concat(F.lit("primary_huaben_"), chapter, F.lit("_"), F.lpad(F.col("seq").cast("string"), 5, "0")).alias("chunk_id"), F.lit("t").alias("chapter_title"), F.lit("d").alias("dynasty"), F.lit("huaben").alias("genre"),
        F.lit("primary_literature").alias("source_type"), F.lit("paragraph_semantic_merge").alias("strategy"), F.col("para").alias("paragraph_index"), F.array("para").alias("paragraph_range"), F.lit("").alias("sentence_range"),
        F.lit(-1).alias("char_start"), F.lit(-1).alias("char_end"), F.lit("").alias("structural_unit"), F.lit("documents").alias("source_file"))
    number = F.when(F.col("doc_id") % 9 == 0, chapter).otherwise(F.concat(F.lit('"'), chapter, F.lit('"')))
    meta = F.concat(F.lit('{"chapter_number":'), number, F.lit(","), F.substring(F.to_json(head), F.lit(2), F.length(F.to_json(head))))
    return K.metadata_errors(places.select(meta.alias("meta")), {"primary_literature": "documents"}).groupBy("rule").agg(F.count("*").alias("n"))


METADATA = f"""WITH p AS ({PLACES}) SELECT 'negative paragraph' AS rule, count(*) AS n FROM p WHERE para < 0 HAVING count(*) > 0 UNION ALL SELECT 'chapter is no text', count(*) FROM p WHERE doc_id % 9 = 0 HAVING count(*) > 0"""

QUERIES = {
    "chunk_metadata_errors": chunk_metadata_errors, "play_chunks": play_chunks, "script_parts": script_parts, "script_chunks": script_chunks, "paper_layout": paper_layout, "paper_chunks": paper_chunks, "paper_coverage": paper_coverage,
    "ordered_places": ordered_places,
}
ORACLE_SQL = {"chunk_metadata_errors": METADATA, "play_chunks": PLAYS, "script_parts": SCRIPT, "paper_layout": LAYOUT, "paper_coverage": COVERAGE, "ordered_places": PLACES}
