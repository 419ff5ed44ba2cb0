"""Speech, marks in paragraphs and memories, over documents and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from textlake.operators import passages as P
from textlake.operators import search as R
from textlake.plans.search import PARAS, WORDS, paras, words_index
from textlake.sources.tables import table

#: The prose of the test tables has no speakers: words stand for names, and what follows them for a mark of speech.
NAMES, MARKS = ["the", "er", "la"], r"(?: on| of| und| le)[,:]?"


def spoken_passages(spark, sf):
    rows = P.spoken(table(spark, sf, "documents"), NAMES, MARKS)
    return rows.select("doc_id", "at", "name", "mark", F.md5("dialogue").alias("dialogue"), F.md5("context").alias("context"))


_PATTERN = "(?:the|er|la)(?: on| of| und| le)[,:]?"
_STRIP = r"regexp_replace({x}, '^[ \t\n\r\x{{3000}}]+|[ \t\n\r\x{{3000}}]+$', '', 'g')"
SPOKEN = rf"""WITH d AS (SELECT doc_id, text, regexp_extract_all(text, '{_PATTERN}') AS m, string_split_regex(text, '{_PATTERN}') AS b FROM documents WHERE text <> ''),
e AS (SELECT doc_id, text, m[i] AS mark, list_sum([length(x) FOR x IN b[1:i]]) + coalesce(list_sum([length(x) FOR x IN m[1:i - 1]]), 0) AS pos FROM (SELECT doc_id, text, m, b, unnest(range(1, len(m) + 1)) AS i FROM d)),
r AS (SELECT *, substr(text, (pos + length(mark) + 1)::BIGINT, 300) AS raw FROM e),
s AS (SELECT *, regexp_extract(raw, '^([^。！？\n]*[。！？\n])', 1) AS sentence FROM r),
x AS (SELECT *, CASE WHEN sentence <> '' THEN {_STRIP.format(x='sentence')} ELSE substr({_STRIP.format(x='raw')}, 1, 150) END AS dialogue FROM s)
SELECT doc_id, pos::INT AS "at", regexp_extract(mark, '^(the|er|la)', 1) AS name, mark, md5(dialogue) AS dialogue, md5(substr(text, (greatest(pos - 50, 0) + 1)::BIGINT, (pos - greatest(pos - 50, 0))::BIGINT)) AS context FROM x WHERE length(dialogue) >= 2"""


def highlighted_paragraphs(spark, sf):
    """Places to mark in each paragraph for one question; by turns the question, an excerpt of the paragraph, or named entities."""
    rows = paras(spark, sf).withColumn("k", F.pmod("para", F.lit(3)))
    query = F.when(F.col("k") == 0, "TION").when(F.col("k") == 1, "").otherwise("about 『the + and』 here")
    excerpt = F.when(F.col("k") == 1, F.concat(F.lit("…"), F.substring("paragraph", 5, 30), F.lit("…")))
    marks = P.highlights(F.col("paragraph"), F.lit(None), query, excerpt)
    shown = F.array_join(F.transform(marks, lambda m: F.concat(m["start"].cast("string"), F.lit("-"), m["end"].cast("string"))), " ")
    return rows.select("doc_id", "para", shown.alias("marks"))


_ALL = "list_transform(list_filter(range(0, greatest(length(p) - {n} + 1, 0)), lambda i: substr({p}, i + 1, {n}) = '{w}'), lambda i: i || '-' || (i + {n}))"
_X = "regexp_replace(trim(substr(p, 5, 30)), '^[…⋯]+|[…⋯]+$', '', 'g')"
HIGHLIGHTS = f"""WITH {PARAS}, x AS (SELECT doc_id, para, p, para % 3 AS k, trim({_X}) AS own FROM paras)
SELECT doc_id, para, CASE k WHEN 0 THEN array_to_string({_ALL.format(n=4, p='lower(p)', w='tion')}, ' ')
 WHEN 1 THEN CASE WHEN length(own) < 4 THEN '' WHEN instr(p, own) > 0 THEN (instr(p, own) - 1) || '-' || (instr(p, own) - 1 + length(own))
  WHEN instr(p, substr(own, 1, 10)) > 0 THEN (instr(p, substr(own, 1, 10)) - 1) || '-' || (instr(p, substr(own, 1, 10)) - 1 + least(length(own), length(p) - instr(p, substr(own, 1, 10)) + 1)) ELSE '' END
 ELSE array_to_string(list_concat({_ALL.format(n=3, p='p', w='the')}, {_ALL.format(n=3, p='p', w='and')}), ' ') END AS marks FROM x"""

QUESTIONS = {"m1": [("license", 1.0), ("rights", 1.0)], "m2": [("zzzz", 1.0)], "m3": [("public", 1.0), ("the", 0.2)]}


def memory_hybrid(spark, sf):
    """Twenty memories by words and five times as many by vectors; a question that no document answers goes by vectors alone."""
    index, vectors = words_index(spark, sf), table(spark, sf, "embeddings")
    literal = index.bm25(R.query_table(vectors, QUESTIONS), k=20, digits=9)
    asked = vectors.where("vec_id in (1, 2, 3)").select(F.concat(F.lit("m"), F.col("vec_id").cast("string")).alias("query_id"), F.col("embedding").cast("array<double>").alias("vector"))
    dense = R.vector_search(vectors, asked, 100).select("query_id", F.col("vec_id").alias("doc_id"), F.round("score", 9).alias("score"))
    return P.remembered(literal.select("query_id", "doc_id", "score"), dense, 20, least=0.1)


HYBRID = f"""WITH d AS (SELECT doc_id, {WORDS} AS t FROM documents), st AS (SELECT count(*) AS n, avg(len(t)) AS a FROM d),
tf AS (SELECT doc_id, len(t) AS dl, token, count(*) AS tf FROM (SELECT doc_id, t, unnest(t) AS token FROM d) GROUP BY ALL), df AS (SELECT token, count(*) AS df FROM tf GROUP BY 1),
q(query_id, token, w) AS (VALUES ('m1', 'license', 1.0), ('m1', 'rights', 1.0), ('m2', 'zzzz', 1.0), ('m3', 'public', 1.0), ('m3', 'the', 0.2)),
b AS (SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * w * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / greatest(a, 1.0)))), 9) AS score FROM tf JOIN df USING (token) JOIN q USING (token), st GROUP BY 1, 2),
l AS (SELECT * FROM b WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 20),
e AS (SELECT 'm' || x.vec_id AS query_id, y.vec_id AS doc_id, list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) AS c FROM embeddings x, embeddings y WHERE x.vec_id IN (1, 2, 3)),
v AS (SELECT query_id, doc_id, round(c, 9) AS score FROM e QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY c DESC, doc_id) <= 100),
ls AS (SELECT query_id, doc_id, CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 0 END AS l FROM l WINDOW w AS (PARTITION BY query_id)),
vs AS (SELECT query_id, doc_id, CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 0 END AS d FROM v WHERE query_id IN (SELECT query_id FROM l) WINDOW w AS (PARTITION BY query_id)),
f AS (SELECT query_id, doc_id, 0.5 * coalesce(l, 0) + 0.5 * coalesce(d, 0) AS score FROM ls FULL JOIN vs USING (query_id, doc_id) UNION ALL SELECT query_id, doc_id, score * 0.8 FROM v WHERE query_id NOT IN (SELECT query_id FROM l)),
r AS (SELECT query_id, doc_id, round(score, 6) AS score FROM f)
SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM r WHERE score >= 0.1 QUALIFY rank <= 20"""

QUERIES = {"spoken_passages": spoken_passages, "highlighted_paragraphs": highlighted_paragraphs, "memory_hybrid": memory_hybrid}
ORACLE_SQL = {"spoken_passages": SPOKEN, "highlighted_paragraphs": HIGHLIGHTS, "memory_hybrid": HYBRID}
