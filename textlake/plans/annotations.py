"""Queries over annotated passages: filters, duplicates, places, statistics, timelines, labels, changes, exports.

The test tables hold no annotations, so each paragraph gives one: its first word as entity, a category by its length, agent or
user by its document, a note for every other paragraph.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from textlake.functions import text as T
from textlake.operators import annotations as A
from textlake.plans.search import PARAS, paras
from textlake.sources.tables import table

CATEGORIES = ["person", "place", "time", "object"]
YEARS = [("en", 618, 907), ("de", 960, 1279), ("fr", 1368, 1644)]
NOTES = (
    PARAS
    + r""", notes AS (SELECT doc_id, para, source, lang, regexp_extract(p, '[\p{L}]+') AS entity, ['person','place','time','object'][length(p) % 4 + 1] AS category,
    CASE WHEN doc_id % 3 = 0 THEN 'user' ELSE 'agent' END AS origin, (length(p) % 100) / 100.0::DOUBLE AS confidence, CASE WHEN para % 2 = 0 THEN substr(p, 1, 40) END AS note
    FROM paras WHERE regexp_matches(p, '[\p{L}]'))"""
)


def notes(spark, sf):
    p, size = F.col("paragraph"), F.length("paragraph")
    rows = paras(spark, sf).where(p.rlike(r"\p{L}"))
    return rows.select(
        "doc_id", "para", "source", "lang", F.regexp_extract(p, r"\p{L}+", 0).alias("entity"), F.element_at(F.array(*map(F.lit, CATEGORIES)), size % 4 + 1).alias("category"),
        F.when(F.col("doc_id") % 3 == 0, "user").otherwise("agent").alias("origin"), (size % 100 / F.lit(100.0)).alias("confidence"),
        F.when(F.col("para") % 2 == 0, F.substring(p, 1, 40)).alias("note"),
    )


def note_index_filter(spark, sf):
    rows = A.index_filter(notes(spark, sf), "tion", ["entity", "note", "source", "lang"], ["person", "time"], "agent", True)
    return rows.select("doc_id", "para", "entity", "category")


NOTE_INDEX = f"""WITH {NOTES} SELECT doc_id, para, entity, category FROM notes WHERE (contains(lower(entity), 'tion') OR contains(lower(coalesce(note, '')), 'tion') OR contains(lower(source), 'tion')
OR contains(lower(coalesce(lang, '')), 'tion')) AND category IN ('person', 'time') AND origin = 'agent' AND trim(coalesce(note, '')) <> ''"""


def note_best_confidence(spark, sf):
    rows = A.first_of(notes(spark, sf), ["entity", "category"], [F.desc("confidence"), "doc_id", "para"])
    return rows.select("entity", "category", "confidence", "doc_id", "para")


BEST_CONFIDENCE = f"""WITH {NOTES} SELECT entity, category, confidence, doc_id, para FROM notes
QUALIFY row_number() OVER (PARTITION BY entity, category ORDER BY confidence DESC, doc_id, para) = 1"""


def note_longest_fields(spark, sf):
    return A.longest_fields(notes(spark, sf), ["entity"], ["note", "source"])


LONGEST = f"""WITH {NOTES} SELECT entity, (max({{'n': length(note), 'v': note}}) FILTER (note IS NOT NULL)).v AS note, max({{'n': length(source), 'v': source}}).v AS source, count(*) AS merged
FROM (SELECT entity, note, source FROM notes) GROUP BY entity"""


def longest_paragraph_per_source(spark, sf):
    rows = A.first_of(paras(spark, sf).withColumn("n", F.length("paragraph")), ["source"], [F.desc("n"), "doc_id", "para"])
    return rows.select("source", "doc_id", "para", "n")


LONGEST_PARAGRAPH = f"""WITH {PARAS} SELECT source, doc_id, para, length(p)::INT AS n FROM paras QUALIFY row_number() OVER (PARTITION BY source ORDER BY length(p) DESC, doc_id, para) = 1"""


def paragraphs_by_prefix(spark, sf):
    rows = A.first_of(paras(spark, sf).withColumn("prefix", F.substring("paragraph", 1, 80)), ["prefix"], ["doc_id", "para"])
    return rows.select("doc_id", "para", "prefix")


BY_PREFIX = f"""WITH {PARAS} SELECT doc_id, para, substr(p, 1, 80) AS prefix FROM paras QUALIFY row_number() OVER (PARTITION BY substr(p, 1, 80) ORDER BY doc_id, para) = 1"""


def note_statistics(spark, sf):
    return A.cross_share(notes(spark, sf), "category", "origin", ["user", "agent"])


STATISTICS = f"""WITH {NOTES} SELECT category, count(*) AS total, count(*) FILTER (origin = 'user') AS user, count(*) FILTER (origin = 'agent') AS agent,
round(count(*) * 100 / sum(count(*)) OVER (), 2) AS percent FROM notes GROUP BY category"""


def note_density(spark, sf):
    rows = notes(spark, sf).groupBy("doc_id").agg(F.count("*").alias("notes"), F.count_distinct("entity").alias("entities"), F.count_if(F.col("note").isNotNull()).alias("noted"))
    return rows.withColumn("density", F.round(F.col("noted") / F.col("notes"), 3))


DENSITY = f"""WITH {NOTES} SELECT doc_id, count(*) AS notes, count(DISTINCT entity) AS entities, count(note) AS noted, round(count(note) / count(*), 3) AS density FROM notes GROUP BY 1"""


def _years(spark):
    return spark.createDataFrame(YEARS, "lang string, first_year int, last_year int")


YEARS_SQL = "years(lang, first_year, last_year) AS (VALUES ('en', 618, 907), ('de', 960, 1279), ('fr', 1368, 1644))"


def timeline_events(spark, sf):
    return A.timeline(notes(spark, sf), "lang", _years(spark)).select("doc_id", "para", "entity", "category", "lang", "first_year", "last_year", "era_order")


EVENTS = f"""WITH {NOTES}, {YEARS_SQL}, e AS (SELECT DISTINCT entity, doc_id, para, category, lang FROM notes)
SELECT doc_id, para, entity, category, e.lang, first_year, last_year, coalesce(first_year, 9999) AS era_order FROM e LEFT JOIN years y ON e.lang = y.lang"""


def timeline_summary(spark, sf):
    return A.era_summary(A.timeline(notes(spark, sf), "lang", _years(spark)), "lang", 10)


SUMMARY = f"""WITH {NOTES}, e AS (SELECT DISTINCT entity, doc_id, para, category, lang FROM notes), c AS (SELECT lang, entity, count(*) AS n FROM e GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, entity) AS place FROM c)
SELECT lang, sum(n)::BIGINT AS events, count(*) AS entities, string_agg(entity, ',' ORDER BY place) FILTER (place <= 10) AS top FROM r GROUP BY lang"""


def unique_note_labels(spark, sf):
    labelled = notes(spark, sf).withColumn("label", F.concat("lang", F.lit("-"), "entity"))
    return A.unique_labels(labelled, "label", ["doc_id", "para"]).select("doc_id", "para", "unique_label")


UNIQUE_LABELS = f"""WITH {NOTES}, x AS (SELECT doc_id, para, lang || '-' || entity AS label, row_number() OVER (PARTITION BY lang || '-' || entity ORDER BY doc_id, para) AS k FROM notes)
SELECT doc_id, para, CASE WHEN k = 1 THEN label ELSE label || '#' || k END AS unique_label FROM x"""


def marginalia_candidates(spark, sf):
    rank = F.when(F.col("category") == "person", 0).when(F.col("category") == "place", 1).otherwise(2)
    rows = A.first_of(notes(spark, sf).where(F.length("entity") >= 2).withColumn("priority", rank), ["entity"], ["doc_id", "para"])
    return rows.orderBy("priority", "entity").limit(15).select("entity", "priority", "doc_id", "para")


MARGINALIA = f"""WITH {NOTES}, f AS (SELECT *, CASE category WHEN 'person' THEN 0 WHEN 'place' THEN 1 ELSE 2 END AS priority FROM notes WHERE length(entity) >= 2
QUALIFY row_number() OVER (PARTITION BY entity ORDER BY doc_id, para) = 1) SELECT entity, priority, doc_id, para FROM f ORDER BY priority, entity LIMIT 15"""


def first_mentions(spark, sf):
    """The first paragraph of each document that mentions an entity of its notes, with an excerpt."""
    rows = A.first_of(notes(spark, sf), ["doc_id", "entity"], ["para"])
    return rows.select("doc_id", "entity", F.col("para").alias("first_para"), "category")


FIRST_MENTIONS = f"""WITH {NOTES} SELECT doc_id, entity, para AS first_para, category FROM notes QUALIFY row_number() OVER (PARTITION BY doc_id, entity ORDER BY para) = 1"""


def category_histogram(spark, sf):
    """How often each category is in the lists that paragraphs carry: each note's category, and its origin beside it."""
    nested = notes(spark, sf).select(F.array("category", "origin").alias("cats"))
    return nested.select(F.explode("cats").alias("category")).groupBy("category").agg(F.count("*").alias("n"))


HISTOGRAM = f"""WITH {NOTES}, d AS (SELECT [category, origin] AS cats FROM notes) SELECT category, count(*) AS n FROM (SELECT unnest(cats) AS category FROM d) GROUP BY 1"""


def position_paragraphs(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.explode(F.sequence(F.lit(0), F.length("text"), F.lit(97))).alias("pos"))
    return A.paragraph_of(docs, paras(spark, sf))


POSITIONS = f"""WITH {PARAS}, s AS (SELECT doc_id, para, length(p) AS size, coalesce(sum(length(p) + 1) OVER (PARTITION BY doc_id ORDER BY para ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM paras),
q AS (SELECT doc_id, unnest(generate_series(0, length(text), 97)) AS pos FROM documents)
SELECT q.doc_id, q.pos, s.para, (q.pos - s.start)::BIGINT AS "offset" FROM q LEFT JOIN s ON q.doc_id = s.doc_id AND q.pos >= s.start AND q.pos < s.start + s.size"""


def located_chunks(spark, sf):
    p = paras(spark, sf)
    cut = F.when(F.col("para") % 3 == 0, F.col("paragraph")).when(F.col("para") % 3 == 1, F.concat(F.lit("~"), F.substring("paragraph", 2, 200))).otherwise(F.concat(F.substring("paragraph", 1, 14), F.lit("~~~~~~~~~~~~~~~~~~~~~~")))
    return A.locate_chunks(p.select("doc_id", F.col("para").alias("chunk"), cut.alias("content")), p)


WS = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
LOCATED = f"""WITH {PARAS}, t AS (SELECT doc_id, para, regexp_replace(p, '{WS}', '', 'g') AS t FROM paras),
c AS (SELECT doc_id, para AS chunk, regexp_replace(CASE para % 3 WHEN 0 THEN p WHEN 1 THEN '~' || substr(p, 2, 200) ELSE substr(p, 1, 14) || '~~~~~~~~~~~~~~~~~~~~~~' END, '{WS}', '', 'g') AS c FROM paras),
m AS (SELECT c.doc_id, chunk, para, CASE WHEN length(c) >= 6 AND contains(t, c) THEN 1
 WHEN length(substr(c, greatest(1, (floor((length(c) - 20) / 2) + 1)::INT), 20)) >= 6 AND contains(t, substr(c, greatest(1, (floor((length(c) - 20) / 2) + 1)::INT), 20)) THEN 2
 WHEN length(substr(c, 1, 12)) >= 6 AND contains(t, substr(c, 1, 12)) THEN 3 END AS level FROM c JOIN t ON c.doc_id = t.doc_id)
SELECT doc_id, chunk, coalesce(min({{'level': level, 'para': para}}) FILTER (level IS NOT NULL), {{'level': 0, 'para': -1}}).level AS level,
 coalesce(min({{'level': level, 'para': para}}) FILTER (level IS NOT NULL), {{'level': 0, 'para': -1}}).para AS para FROM m GROUP BY 1, 2"""


def scoped_note_delete(spark, sf):
    n = notes(spark, sf).withColumn("key", F.concat_ws(":", "doc_id", "para"))
    kept, children = A.scoped_delete(n, (F.col("category") == "time") & (F.col("origin") == "agent"), n.select("key", F.col("note").alias("comment")), "key")
    return kept.groupBy("category", "origin").agg(F.count("*").alias("n")).unionByName(children.select(F.lit("comments").alias("category"), F.lit("all").alias("origin")).groupBy("category", "origin").agg(F.count("*").alias("n")))


SCOPED = f"""WITH {NOTES}, k AS (SELECT * FROM notes WHERE NOT (category = 'time' AND origin = 'agent')) SELECT category, origin, count(*) AS n FROM k GROUP BY ALL UNION ALL SELECT 'comments', 'all', count(*) FROM k"""


def cascade_thread_delete(spark, sf):
    tables = {n: table(spark, sf, n).select("doc_id") for n in ("documents", "labels")}
    gone = table(spark, sf, "labels").where("toxic = 1").select("doc_id")
    left = A.cascade_delete(tables, gone, "doc_id")
    counts = [t.agg(F.lit(n).alias("name"), F.count("*").alias("n"), F.sum("doc_id").alias("ids")) for n, t in left.items()]
    return counts[0].unionByName(counts[1])


CASCADE = """WITH g AS (SELECT doc_id FROM labels WHERE toxic = 1) SELECT 'documents' AS name, count(*) AS n, sum(doc_id)::BIGINT AS ids FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM g)
UNION ALL SELECT 'labels', count(*), sum(doc_id)::BIGINT FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM g)"""


def merged_patch(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source", "n_chars")
    patch = table(spark, sf, "labels").where("quality = 1").select("doc_id", F.lit("reviewed").alias("source")).distinct()
    return A.merge_patch(docs, patch, ["doc_id"], "source")


PATCH = """SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL THEN 'reviewed' ELSE source END AS source, n_chars FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE quality = 1) l ON d.doc_id = l.doc_id"""


def html_export(spark, sf):
    return A.html_lines(notes(spark, sf))


ESC = "replace(replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), chr(39), '&#39;')"
HTML = f"""WITH {NOTES} SELECT doc_id, para, '<li class="' || category || '"><mark>' || entity || '</mark> ' || {ESC.format("coalesce(note, '')")} || '</li>' AS line FROM notes"""


def plain_export(spark, sf):
    return A.plain_lines(notes(spark, sf))


PLAIN = f"""WITH {NOTES} SELECT doc_id, para, '[' || category || '] ' || entity || CASE WHEN note IS NOT NULL THEN ': ' || note ELSE '' END AS line FROM notes"""


def inline_export(spark, sf):
    return A.inline_marks(notes(spark, sf), paras(spark, sf))


INLINE = f"""WITH {NOTES} SELECT n.doc_id, n.para, {ESC.format("substr(p, 1, instr(p, entity) - 1)")} || '<seg type="' || category || '">' || entity || '</seg>' || {ESC.format("substr(p, instr(p, entity) + length(entity))")} AS line
FROM notes n JOIN paras q ON n.doc_id = q.doc_id AND n.para = q.para"""


def source_rollup(spark, sf):
    """Per place: matches (none counts as one), words, and the names of its languages."""
    hits = T.count_literal(F.col("text"), "license")
    docs = table(spark, sf, "documents").select("source", "lang", F.when(hits == 0, 1).otherwise(hits).alias("m"), F.size(F.split("text", " ")).alias("w"))
    return docs.groupBy("source").agg(F.sum("m").alias("matches"), F.sum("w").alias("words"), F.array_join(F.sort_array(F.collect_set("lang")), ",").alias("langs"))


ROLLUP = """SELECT source, sum(CASE WHEN h = 0 THEN 1 ELSE h END)::BIGINT AS matches, sum(w)::BIGINT AS words, string_agg(DISTINCT lang, ',' ORDER BY lang) AS langs
FROM (SELECT source, lang, (length(text) - length(replace(text, 'license', ''))) // 7 AS h, len(string_split(text, ' ')) AS w FROM documents) GROUP BY source"""


def keyword_edges(spark, sf):
    """Edges from places to keywords; a keyword that is also a place's name gets a suffix."""
    words = ["license", "token", "src1", "the"]
    docs = table(spark, sf, "documents").select("source", F.explode(F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(F.col("text"), w))).alias("word"))
    edges = docs.groupBy("source", "word").agg(F.count("*").alias("weight"))
    names = table(spark, sf, "documents").select(F.col("source").alias("word")).distinct().withColumn("clash", F.lit(True))
    return edges.join(names, "word", "left").select("source", F.when(F.col("clash"), F.concat("word", F.lit("(keyword)"))).otherwise(F.col("word")).alias("target"), "weight")


EDGES = """WITH k(word) AS (VALUES ('license'), ('token'), ('src1'), ('the')) SELECT source, CASE WHEN word IN (SELECT source FROM documents) THEN word || '(keyword)' ELSE word END AS target, count(*) AS weight
FROM documents, k WHERE contains(text, word) GROUP BY ALL"""


QUERIES = {
    "note_index_filter": note_index_filter, "note_best_confidence": note_best_confidence, "note_longest_fields": note_longest_fields, "longest_paragraph_per_source": longest_paragraph_per_source,
    "paragraphs_by_prefix": paragraphs_by_prefix, "note_statistics": note_statistics, "note_density": note_density, "timeline_events": timeline_events, "timeline_summary": timeline_summary,
    "unique_note_labels": unique_note_labels, "marginalia_candidates": marginalia_candidates, "first_mentions": first_mentions, "category_histogram": category_histogram,
    "position_paragraphs": position_paragraphs, "located_chunks": located_chunks, "scoped_note_delete": scoped_note_delete, "cascade_thread_delete": cascade_thread_delete, "merged_patch": merged_patch,
    "html_export": html_export, "plain_export": plain_export, "inline_export": inline_export, "source_rollup": source_rollup, "keyword_edges": keyword_edges,
}
ORACLE_SQL = {
    "note_index_filter": NOTE_INDEX, "note_best_confidence": BEST_CONFIDENCE, "note_longest_fields": LONGEST, "longest_paragraph_per_source": LONGEST_PARAGRAPH,
    "paragraphs_by_prefix": BY_PREFIX, "note_statistics": STATISTICS, "note_density": DENSITY, "timeline_events": EVENTS, "timeline_summary": SUMMARY,
    "unique_note_labels": UNIQUE_LABELS, "marginalia_candidates": MARGINALIA, "first_mentions": FIRST_MENTIONS, "category_histogram": HISTOGRAM,
    "position_paragraphs": POSITIONS, "located_chunks": LOCATED, "scoped_note_delete": SCOPED, "cascade_thread_delete": CASCADE, "merged_patch": PATCH,
    "html_export": HTML, "plain_export": PLAIN, "inline_export": INLINE, "source_rollup": ROLLUP, "keyword_edges": EDGES,
}
