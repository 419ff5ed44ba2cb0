"""Queries of text comparison and chunking."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from textlake.functions import text as T
from textlake.operators import alignments as A
from textlake.operators import chunking as K
from textlake.operators import compare as P
from textlake.operators import patterns as D
from textlake.plans.search import WORDS
from textlake.sources.tables import table


def _pairs(spark, sf):
    """Benchmark passages and the documents that share eight words with them."""
    items, docs = table(spark, sf, "benchmark"), table(spark, sf, "documents")
    found = P.candidate_pairs(items, docs, "item_id", "doc_id")
    rows = found.join(items.select("item_id", F.col("text").alias("left")), "item_id").join(docs.select("doc_id", F.col("text").alias("right")), "doc_id")
    return rows.withColumn("pair_id", F.col("item_id") * 1_000_000_000 + F.col("doc_id"))


def benchmark_shared_spans(spark, sf):
    found = A.shared_spans(_pairs(spark, sf))
    return found.select("pair_id", F.length("span").alias("chars"), F.md5("span").alias("span"), "left_at", "right_at", "is_long")


SHARED_SPANS = f"""WITH g AS (SELECT k, id, unnest(list_distinct([array_to_string(t[i:i + 7], ' ') FOR i IN range(1, len(t) - 6)])) AS gram FROM (
    SELECT 1 AS k, item_id AS id, {WORDS} AS t FROM benchmark UNION ALL SELECT 2, doc_id, {WORDS} FROM documents)),
p AS (SELECT DISTINCT x.id AS item_id, y.id AS doc_id FROM g x JOIN g y USING (gram) WHERE x.k = 1 AND y.k = 2),
l AS (SELECT item_id, string_split(text, '') AS c FROM benchmark WHERE item_id IN (SELECT item_id FROM p)),
r AS (SELECT doc_id, string_split(text, '') AS c FROM documents WHERE doc_id IN (SELECT doc_id FROM p)),
lg AS (SELECT item_id, i, array_to_string(c[i + 1:i + 8], '') AS s FROM (SELECT item_id, c, unnest(range(0, len(c) - 7)) AS i FROM l)),
rg AS (SELECT doc_id, j, array_to_string(c[j + 1:j + 8], '') AS s FROM (SELECT doc_id, c, unnest(range(0, len(c) - 7)) AS j FROM r)),
met AS (SELECT item_id, doc_id, i, j, i - row_number() OVER (PARTITION BY item_id, doc_id, i - j ORDER BY i) AS run FROM p JOIN lg USING (item_id) JOIN rg USING (doc_id, s)),
spans AS (SELECT item_id, doc_id, min(i) AS a, min(j) AS b, count(*) + 7 AS n FROM met GROUP BY item_id, doc_id, i - j, run HAVING count(*) + 7 >= 12)
SELECT item_id * 1000000000 + doc_id AS pair_id, n::INT AS chars, md5(array_to_string(c[a + 1:a + n], '')) AS span, a::INT AS left_at, b::INT AS right_at, n >= 40 AS is_long
FROM spans JOIN l USING (item_id)"""


def near_copies(spark, sf):
    """(pair_id, left, right): each distinct text that begins with the same eight words as an earlier one, with the last such."""
    texts = table(spark, sf, "documents").where("text is not null")
    one = texts.groupBy(F.sha2("text", 256).alias("digest")).agg(F.min("doc_id").alias("doc_id"))  # copies are one text
    begins = texts.join(one.select("doc_id"), "doc_id").select("doc_id", F.slice(T.words(F.col("text")), 1, 8).alias("w")).where(F.size("w") == 8)
    before = F.lag("doc_id").over(Window.partitionBy("key").orderBy("doc_id"))
    ids = begins.select("doc_id", F.xxhash64("w").alias("key")).withColumn("before", before).where("before is not null")
    ids = ids.join(texts.select("doc_id", F.col("text").alias("right")), "doc_id").join(texts.select(F.col("doc_id").alias("before"), F.col("text").alias("left")), "before")
    return ids.select(F.col("doc_id").alias("pair_id"), "left", "right")


def copy_diffs(spark, sf):
    """What was changed in near copies, whole texts."""
    return A.diff(near_copies(spark, sf))


def line_diffs(spark, sf):
    """Each document's first line against its second."""
    lines = T.paragraphs(F.col("text"), "\n")
    pairs = table(spark, sf, "documents").select(F.col("doc_id").alias("pair_id"), F.try_element_at(lines, F.lit(1)).alias("left"), F.try_element_at(lines, F.lit(2)).alias("right"))
    return A.diff(pairs.where("right is not null"))


def span_repair(spark, sf):
    """Twelve characters of each text, claimed to stand where they do, a little off, nowhere, or not to be there at all."""
    kind = F.pmod("doc_id", F.lit(4))
    start = F.when(kind == 0, 30).when(kind == 1, 37).when(kind == 2, -1).otherwise(5)
    entity = F.when(kind == 3, "☃☃").otherwise(F.substring("text", 31, 12))
    rows = table(spark, sf, "documents").where("length(text) >= 60").select(F.col("doc_id").alias("id"), "text", entity.alias("entity"), start.alias("start"), (start + 12).alias("end"))
    return P.repair_spans(rows).select("id", "start", "end", "level", "confidence")


SPANS = """WITH d AS (SELECT doc_id AS id, doc_id % 4 AS k, text, substr(text, 31, 12) AS e FROM documents WHERE length(text) >= 60),
x AS (SELECT id, k, CASE k WHEN 0 THEN 30 WHEN 1 THEN CASE WHEN substr(text, 38, 12) = e THEN 37 ELSE instr(substr(text, 1, 99), e) - 1 END WHEN 2 THEN instr(text, e) - 1 ELSE -1 END AS s,
 CASE k WHEN 0 THEN 'exact' WHEN 1 THEN CASE WHEN substr(text, 38, 12) = e THEN 'exact' ELSE 'window' END WHEN 2 THEN 'global' ELSE 'not_found' END AS level FROM d)
SELECT id, s::INT AS start, (CASE WHEN k = 3 THEN -1 ELSE s + 12 END)::INT AS "end", level, CASE level WHEN 'exact' THEN 'high' WHEN 'window' THEN 'medium' WHEN 'global' THEN 'low' ELSE 'none' END AS confidence FROM x"""


def citation_repair(spark, sf):
    """Quotes from the benchmark passages with their own label, another's, an unknown one, or with words that nobody wrote."""
    items = table(spark, sf, "benchmark").where("length(text) >= 60")
    evidence = items.select(F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("label"), "text")
    kind = F.pmod("item_id", F.lit(4))
    label = F.concat(F.lit("b"), (F.col("item_id") + F.when(kind == 1, 1).when(kind == 2, 10**6).otherwise(0)).cast("string"))
    quote = F.when(kind == 3, "words of nobody").otherwise(F.regexp_replace(F.substring("text", 11, 40), "[“”]", ""))
    return P.repair_citations(items.select(F.col("item_id").alias("id"), F.concat(F.lit("it says “"), quote, F.lit("” ["), label, F.lit("].")).alias("text")), evidence)


CITATIONS = r"""WITH i AS (SELECT item_id, text, regexp_replace(text, '[^\p{L}\p{N}]+', '', 'g') AS norm FROM benchmark WHERE length(text) >= 60),
q AS (SELECT item_id AS id, item_id % 4 AS k, CASE WHEN item_id % 4 = 3 THEN 'words of nobody' ELSE regexp_replace(substr(text, 11, 40), '[“”]', '', 'g') END AS quote,
 'b' || (item_id + CASE item_id % 4 WHEN 1 THEN 1 WHEN 2 THEN 1000000 ELSE 0 END) AS label FROM i),
f AS (SELECT id, min('b' || item_id) AS best, bool_or('b' || item_id = label) AS own FROM q JOIN i ON contains(norm, regexp_replace(quote, '[^\p{L}\p{N}]+', '', 'g')) GROUP BY 1),
x AS (SELECT q.id, quote, label, coalesce(own, false) AS own, best, label IN (SELECT 'b' || item_id FROM i) AS known FROM q LEFT JOIN f USING (id))
SELECT id, quote, label, CASE WHEN own THEN 'keep' WHEN best IS NOT NULL THEN 'relabel' WHEN known THEN 'mark' ELSE 'strip' END AS action, CASE WHEN own THEN label WHEN best IS NOT NULL THEN best WHEN known THEN label END AS new_label FROM x"""


LEGAL = ["license", "General Public License", "Public", "All rights reserved"]


def _entries(spark, sf):
    """Strings of three words of the benchmark passages, and a few legal terms."""
    own = table(spark, sf, "benchmark").select(F.explode(T.word_ngrams(F.split("text", " "), 3)).alias("entry"))
    return own.unionByName(spark.createDataFrame([(e,) for e in LEGAL], "entry string"))


def dictionary_occurrences(spark, sf):
    return D.occurrences(table(spark, sf, "documents"), _entries(spark, sf))


def dictionary_scan(spark, sf):
    return D.scan(table(spark, sf, "documents"), _entries(spark, sf))


FOUND = f"""w AS (SELECT string_split(text, ' ') AS t FROM benchmark),
e AS (SELECT DISTINCT unnest([array_to_string(t[i:i + 2], ' ') FOR i IN range(1, len(t) - 1)]) AS entry FROM w UNION SELECT unnest({LEGAL!r})),
f(doc_id, text, entry, pos) AS (
    SELECT doc_id, text, entry, instr(text, entry) - 1 FROM documents, e WHERE entry <> '' AND contains(text, entry)
    UNION ALL
    SELECT doc_id, text, entry, pos + instr(substr(text, pos + 2), entry) FROM f WHERE instr(substr(text, pos + 2), entry) > 0),
m AS (SELECT doc_id, entry, pos::INT AS start, (pos + length(entry))::INT AS "end" FROM f)"""
OCCURRENCES = f"WITH RECURSIVE {FOUND} SELECT * FROM m"
LONGEST = f"""WITH RECURSIVE {FOUND},
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length(entry) DESC, entry, start) AS k FROM m),
g(doc_id, k, entry, start, "end", stays, taken) AS (
    SELECT doc_id, k, entry, start, "end", true, [{{'a': start, 'z': "end"}}] FROM o WHERE k = 1
    UNION ALL
    SELECT o.doc_id, o.k, o.entry, o.start, o."end", len(list_filter(taken, lambda t: t.a < o."end" AND o.start < t.z)) = 0,
           CASE WHEN len(list_filter(taken, lambda t: t.a < o."end" AND o.start < t.z)) = 0 THEN list_append(taken, {{'a': o.start, 'z': o."end"}}) ELSE taken END
    FROM g JOIN o ON o.doc_id = g.doc_id AND o.k = g.k + 1)
SELECT doc_id, entry, start, "end" FROM g WHERE stays"""


def sentence_chunks(spark, sf):
    return K.chunk(table(spark, sf, "documents"), lambda t: K.pack(K.split_sentences(t, K.LATIN_ENDS, straight=False), 600, 60), "sentence")


def similar_paragraph_chunks(spark, sf):
    cut = lambda t: K.merge_similar([p for p in t.split("\n") if p.strip()], 0.75, 600, 150)
    return K.chunk(table(spark, sf, "documents"), cut, "similar")


def window_chunks(spark, sf):
    return K.chunk(table(spark, sf, "documents"), K.window, "window")


def _nearest(marks: str) -> str:
    """The end, nearest to 100 and of two the smaller, of a character of `marks` in the 200 characters where a window may end."""
    return f"list_min(list_transform(list_filter(range(1, 201), lambda e: substr(seg, e, 1) <> '' AND contains({marks}, substr(seg, e, 1))), lambda e: abs(e - 100) * 1000 + e)) % 1000"


WINDOWS = f"""WITH RECURSIVE w(doc_id, text, k, start, stop) AS (
    SELECT doc_id, text, -1, 0::BIGINT, 0::BIGINT FROM documents WHERE text <> ''
    UNION ALL
    SELECT doc_id, text, k + 1, stop, CASE WHEN length(text) - stop > 600 THEN stop + coalesce(400 + {_nearest("'。！？.!?' || chr(10)")}, 400 + {_nearest("'；，;,'")}, 500) ELSE length(text) END
    FROM (SELECT doc_id, text, k, stop, substr(text, stop + 401, 200) AS seg FROM w) WHERE stop < length(text)),
p AS (SELECT doc_id, k, start, stop, text, count(*) OVER (PARTITION BY doc_id) AS n FROM w WHERE k >= 0),
m AS (SELECT doc_id, CASE WHEN n > 1 AND k = n - 1 AND stop - start < 60 THEN k - 1 ELSE k END AS seq, start, stop, text FROM p),
g AS (SELECT doc_id, seq, min(start) AS a, max(stop) AS z, any_value(text) AS text FROM m GROUP BY 1, 2)
SELECT doc_id, seq::INT AS seq, 'primary_window_' || doc_id || '_' || lpad(seq::VARCHAR, 5, '0') AS chunk_id, substr(text, a + 1, z - a) AS content, (z - a)::INT AS chars FROM g"""


def chunk_statistics(spark, sf):
    """Chunks by length must give every document back; statistics of their sizes."""
    chunks = window_chunks(spark, sf)
    back = chunks.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "content"))), lambda x: x["content"]), "").alias("back"))
    joined = table(spark, sf, "documents").join(back, "doc_id")
    return joined.agg(F.count("*").alias("docs"), F.count_if(F.col("text") == F.col("back")).alias("whole"))


CHUNK_STATISTICS = "SELECT count(*) AS docs, count(*) AS whole FROM documents WHERE text <> ''"


def chunk_violations(spark, sf):
    chunks = sentence_chunks(spark, sf)
    bad = chunks.where("seq = 0").withColumns({"chars": F.col("chars") + 1})
    return K.violations(bad).groupBy("rule").agg(F.count("*").alias("n"))


VIOLATIONS = "SELECT 'length differs' AS rule, count(*) AS n FROM documents WHERE text <> ''"


def sentence_counts(spark, sf):
    per = table(spark, sf, "documents").select("source", F.size(T.sentences(F.col("text"))).alias("n"))
    return per.groupBy("source").agg(F.sum("n").alias("sentences"), F.max("n").alias("most"))


SENTENCES = r"""WITH s AS (SELECT source, len(list_filter(list_transform(regexp_extract_all(text, '[^.!?。！？\n]+[.!?。！？]*'), lambda x: regexp_replace(x, '^[ \t\n\r\x{3000}]+|[ \t\n\r\x{3000}]+$', '', 'g')), lambda x: x <> '')) AS n FROM documents)
SELECT source, sum(n)::BIGINT AS sentences, max(n) AS most FROM s GROUP BY 1"""

QUERIES = {
    "benchmark_shared_spans": benchmark_shared_spans, "line_diffs": line_diffs, "copy_diffs": copy_diffs, "dictionary_occurrences": dictionary_occurrences, "span_repair": span_repair, "citation_repair": citation_repair, "dictionary_scan": dictionary_scan,
    "sentence_chunks": sentence_chunks, "similar_paragraph_chunks": similar_paragraph_chunks, "window_chunks": window_chunks, "chunk_statistics": chunk_statistics, "chunk_violations": chunk_violations,
    "sentence_counts": sentence_counts,
}
ORACLE_SQL = {
    "benchmark_shared_spans": SHARED_SPANS, "dictionary_occurrences": OCCURRENCES, "dictionary_scan": LONGEST, "span_repair": SPANS, "citation_repair": CITATIONS, "chunk_statistics": CHUNK_STATISTICS, "window_chunks": WINDOWS, "chunk_violations": VIOLATIONS, "sentence_counts": SENTENCES,
}
