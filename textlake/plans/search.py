"""Queries of literal, keyword, vector and fused search over documents, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlake.functions import scoring as S
from textlake.operators import corpus as C
from textlake.functions import text as T
from textlake.operators import search as R
from textlake.operators.postings import Index
from textlake.plans._indexes import index_of
from textlake.sources.files import stored
from textlake.sources.tables import table

STRIP = r"'^[ \t\n\r\x{3000}]+|[ \t\n\r\x{3000}]+$'"
PARAS = f"""paras AS (
    SELECT doc_id, source, lang, generate_subscripts(ps, 1) - 1 AS para, unnest(ps) AS p FROM (
        SELECT doc_id, source, lang, list_filter(list_transform(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)),
            lambda x: regexp_replace(x, {STRIP}, '', 'g')), lambda x: x <> '') AS ps FROM documents) WHERE len(ps) > 0)"""
WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"


def paras(spark: SparkSession, sf: str) -> DataFrame:
    return C.paragraphs(table(spark, sf, "documents").select("doc_id", "source", "lang", "text"))


def literal_search_ranked(spark, sf):
    return C.literal_search(paras(spark, sf), "tion", 20)


LITERAL_SEARCH = f"""WITH {PARAS},
hits AS (SELECT doc_id, para, p, list_filter(range(0, length(p) - 3), lambda i: substr(lower(p), i + 1, 4) = 'tion') AS ps FROM paras WHERE contains(lower(p), 'tion')),
s AS (SELECT doc_id, para, len(ps) AS hits, round(len(ps) / pow(length(p), 0.3), 6) AS score, ps[1] AS f, p FROM hits)
SELECT doc_id, para, hits, score,
       CASE WHEN greatest(f - 20, 0) > 0 THEN '…' ELSE '' END || substr(p, greatest(f - 20, 0) + 1, least(f + 44, length(p)) - greatest(f - 20, 0))
           || CASE WHEN least(f + 44, length(p)) < length(p) THEN '…' ELSE '' END AS excerpt,
       row_number() OVER (ORDER BY score DESC, doc_id, para) AS rank
FROM s ORDER BY rank LIMIT 20"""


def literal_count_by_lang(spark, sf):
    return C.literal_counts(table(spark, sf, "documents"), "the", "lang")


LITERAL_COUNT = """WITH c AS (SELECT coalesce(lang, 'other') AS lang, sum((length(text) - length(replace(text, 'the', ''))) // 3)::BIGINT AS n FROM documents GROUP BY 1)
SELECT lang, n, round(n / sum(n) OVER (), 3) AS share FROM c"""


def appearances_capped(spark, sf):
    return C.appearances(table(spark, sf, "documents"), "license", "source", 15)


APPEARANCES = """WITH RECURSIVE f(doc_id, source, text, pos) AS (
    SELECT doc_id, source, text, instr(text, 'license') - 1 FROM documents WHERE contains(text, 'license')
    UNION ALL
    SELECT doc_id, source, text, pos + 7 + instr(substr(text, pos + 8), 'license') - 1 FROM f WHERE instr(substr(text, pos + 8), 'license') > 0),
n AS (SELECT doc_id, source, pos, text, row_number() OVER (PARTITION BY source ORDER BY doc_id, pos) AS place, count(*) OVER (PARTITION BY source) AS total FROM f)
SELECT doc_id, source, pos, place, total, total > 15 AS truncated,
       CASE WHEN greatest(pos - 60, 0) > 0 THEN '…' ELSE '' END || substr(text, greatest(pos - 60, 0) + 1, least(pos + 67, length(text)) - greatest(pos - 60, 0))
           || CASE WHEN least(pos + 67, length(text)) < length(text) THEN '…' ELSE '' END AS excerpt
FROM n WHERE place <= 15"""

TERMS = ["the", "tion", "ing"]


def multi_term_paragraphs(spark, sf):
    return C.with_all_terms(paras(spark, sf), TERMS)


MULTI_TERM = f"""WITH {PARAS} SELECT doc_id, para, (length(p) - length(replace(p, 'the', ''))) // 3 AS n_0, (length(p) - length(replace(p, 'tion', ''))) // 4 AS n_1,
(length(p) - length(replace(p, 'ing', ''))) // 3 AS n_2 FROM paras WHERE contains(p, 'the') AND contains(p, 'tion') AND contains(p, 'ing')"""

BAND = ["license", "rights", "token", "der "]


def term_band_cooccurrence(spark, sf):
    return C.band_cooccurrence(C.term_hits(paras(spark, sf), BAND), 2)


BAND_SQL = f"""WITH {PARAS}, h AS (SELECT term, doc_id, para FROM paras, (VALUES ('license'), ('rights'), ('token'), ('der ')) t(term) WHERE contains(p, term))
SELECT x.term AS a, y.term AS b, count(*) AS n FROM h x JOIN h y ON x.doc_id = y.doc_id AND x.term <> y.term AND abs(x.para - y.para) <= 2 GROUP BY 1, 2
UNION ALL SELECT term, term, count(*) FROM h GROUP BY 1"""


def keyword_top10_per_source(spark, sf):
    return C.top_words(table(spark, sf, "documents"), "source", 10, stop=("the", "of", "and"))


TOP_WORDS = f"""WITH w AS (SELECT source, unnest({WORDS}) AS word FROM documents),
c AS (SELECT source, word, count(*) AS n FROM w WHERE length(word) >= 2 AND NOT regexp_matches(word, '^[0-9]+$') AND word NOT IN ('the', 'of', 'and') GROUP BY 1, 2)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, word) AS place FROM c) WHERE place <= 10"""

QUERY = {"q1": [("license", 1.0), ("public", 1.0)], "q2": [("rights", 1.0), ("rights", 1.0), ("reserved", 0.5)]}


def words_index(spark, sf) -> Index:
    """The stored index of the documents' words."""
    return index_of(spark, table(spark, sf, "documents"), "words", T.words(F.col("text")), ["doc_id"], ["lang", "source"])


def bm25_search(spark, sf):
    index = words_index(spark, sf)
    return index.bm25(R.query_table(index.log(), QUERY), k=10, digits=6)


def bm25_filtered_weighted(spark, sf):
    index = words_index(spark, sf)
    return index.bm25(R.query_table(index.log(), QUERY), k=10, digits=6, where=F.col("lang").isin("en", "de"), columns=["lang"])


def _bm25_sql(where: str) -> str:
    return f"""WITH d AS (SELECT doc_id, lang, {WORDS} AS t FROM documents), st AS (SELECT count(*) AS n, avg(len(t)) AS a FROM d),
q(query_id, token, weight) AS (VALUES ('q1', 'license', 1.0), ('q1', 'public', 1.0), ('q2', 'rights', 2.0), ('q2', 'reserved', 0.5)),
tf AS (SELECT doc_id, lang, len(t) AS dl, token, count(*) AS tf FROM (SELECT doc_id, lang, t, unnest(t) AS token FROM d) GROUP BY ALL),
df AS (SELECT token, count(*) AS df FROM tf GROUP BY 1),
s AS (SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / greatest(a, 1.0))) * weight), 6) AS score
      FROM tf JOIN df USING (token) JOIN q USING (token), st WHERE {where} GROUP BY 1, 2)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 10"""


def fts_bigram_rank(spark, sf):
    messages = table(spark, sf, "conversations").withColumn("tokens", T.token_estimate(F.col("text")))
    index = index_of(spark, messages, "messages", T.fts_tokens(F.col("text")), ["conv_id", "turn"], ["tokens"])
    found = R.bigram_ranked(index, "the tion license 白蛇传")
    return C.ranked(found, 50, F.desc("score"), F.asc("conv_id"), F.asc("turn"))


FTS = """WITH m AS (SELECT conv_id, turn, text, len(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda t: t IN ('the', 'tion', 'license')))) AS matched FROM conversations)
SELECT conv_id, turn, matched, floor(length(text) / 4.0)::BIGINT AS tokens, round(matched / 5, 6) AS score, row_number() OVER (ORDER BY matched DESC, conv_id, turn) AS rank
FROM m WHERE matched > 0 ORDER BY rank LIMIT 50"""


def like_fallback_rank(spark, sf):
    return C.ranked(R.like_search(table(spark, sf, "conversations"), "thion", ["conv_id", "turn"]), 50, F.desc("score"), F.asc("conv_id"), F.asc("turn"))


LIKE = """WITH m AS (SELECT conv_id, turn, round((contains(text, 'th')::INT + contains(text, 'hi')::INT + contains(text, 'io')::INT + contains(text, 'on')::INT) / 4, 6) AS score FROM conversations)
SELECT *, row_number() OVER (ORDER BY score DESC, conv_id, turn) AS rank FROM m WHERE score > 0 ORDER BY rank LIMIT 50"""


def _centroids(spark, sf):
    return R.centroids(table(spark, sf, "embeddings"), "label").select(F.col("label").alias("query_id"), "vector")


def vector_topk(spark, sf):
    found = R.vector_search(table(spark, sf, "embeddings"), _centroids(spark, sf), 10)
    return found.withColumn("score", F.round("score", 6))


VECTOR_TOPK = """WITH c AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS x FROM embeddings, range(1, 65) r(i) GROUP BY 1, 2),
q AS (SELECT label AS query_id, list(x ORDER BY i) AS v FROM c GROUP BY 1),
s AS (SELECT query_id, vec_id, list_cosine_similarity(embedding::DOUBLE[], v) AS score FROM embeddings, q)
SELECT query_id, vec_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10"""


def vector_near_duplicate_check(spark, sf):
    """For each new vector (here: each label's mean): the nearest stored one, and whether it is near enough to be the same."""
    best = R.vector_search(table(spark, sf, "embeddings"), _centroids(spark, sf), 1)
    distance = 1 - F.col("score")
    return best.select("query_id", "vec_id", F.round(distance, 6).alias("distance"), (distance < 0.05).alias("duplicate"))


NEAR_DUPLICATE = """WITH c AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS x FROM embeddings, range(1, 65) r(i) GROUP BY 1, 2),
q AS (SELECT label AS query_id, list(x ORDER BY i) AS v FROM c GROUP BY 1),
s AS (SELECT query_id, vec_id, 1 - list_cosine_similarity(embedding::DOUBLE[], v) AS d FROM embeddings, q)
SELECT query_id, vec_id, round(d, 6) AS distance, d < 0.05 AS duplicate FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS r FROM s) WHERE r = 1"""


def vector_norms(spark, sf):
    v = table(spark, sf, "embeddings")
    return v.select("vec_id", F.round(S.norm(F.col("embedding")), 5).alias("norm"), F.round(F.element_at(S.unit(F.col("embedding")), 1), 5).alias("first"))


NORMS = """SELECT vec_id, round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 5) AS norm,
round(embedding[1]::DOUBLE / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 5) AS first FROM embeddings"""


def _channels(spark, sf):
    index, vectors = words_index(spark, sf), table(spark, sf, "embeddings")
    sparse = index.bm25(R.query_table(vectors, {"q": [("license", 1.0), ("rights", 1.0)]}), k=100, digits=9).select("doc_id", "score")
    zero = _centroids(spark, sf).where("query_id = 0")
    dense = R.vector_search(vectors, zero, 100).select(F.col("vec_id").alias("doc_id"), F.round("score", 9).alias("score"))
    return stored(dense), stored(sparse)  # a hundred rows each, which scaling reads twice


CHANNELS = f"""d AS (SELECT doc_id, {WORDS} AS t FROM documents), st AS (SELECT count(*) AS n, avg(len(t)) AS a FROM d),
tf AS (SELECT doc_id, len(t) AS dl, token, count(*) AS tf FROM (SELECT doc_id, t, unnest(t) AS token FROM d) GROUP BY ALL),
df AS (SELECT token, count(*) AS df FROM tf GROUP BY 1),
sp AS (SELECT doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / greatest(a, 1.0)))), 9) AS score
       FROM tf JOIN df USING (token), st WHERE token IN ('license', 'rights') GROUP BY 1 ORDER BY score DESC, doc_id LIMIT 100),
c AS (SELECT i, avg(embedding[i]::DOUBLE) AS x FROM embeddings, range(1, 65) r(i) WHERE label = 0 GROUP BY 1), q AS (SELECT list(x ORDER BY i) AS v FROM c),
de AS (SELECT vec_id AS doc_id, round(list_cosine_similarity(embedding::DOUBLE[], v), 9) AS score FROM embeddings, q ORDER BY list_cosine_similarity(embedding::DOUBLE[], v) DESC, doc_id LIMIT 100)"""


def hybrid_rrf(spark, sf):
    dense, sparse = _channels(spark, sf)
    order = (F.desc("score"), F.asc("doc_id"))
    fused = R.fuse_ranks({"dense": (C.ranked(dense, 100, *order), 0.5), "sparse": (C.ranked(sparse, 100, *order), 0.5)})
    return C.ranked(fused.withColumn("score", F.round("score", 9)), 20, *order)


HYBRID_RRF = f"""WITH {CHANNELS}, r AS (SELECT doc_id, 0.5 / (20 + row_number() OVER (ORDER BY score DESC, doc_id)) AS part FROM de
UNION ALL SELECT doc_id, 0.5 / (20 + row_number() OVER (ORDER BY score DESC, doc_id)) FROM sp),
s AS (SELECT doc_id, round(sum(part), 9) AS score FROM r GROUP BY 1)
SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM s ORDER BY rank LIMIT 20"""


def hybrid_minmax(spark, sf):
    return C.ranked(R.fuse_scores(*_channels(spark, sf)).withColumn("score", F.round("score", 6)), 20, F.desc("score"), F.asc("doc_id"))


FUSED = f"""{CHANNELS}, m AS (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, 0.5 * coalesce(a.s, 0) + 0.5 * coalesce(b.s, 0) AS score FROM
(SELECT doc_id, CASE WHEN max(score) OVER () > min(score) OVER () THEN (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) ELSE 0.5 END AS s FROM de) a FULL JOIN
(SELECT doc_id, CASE WHEN max(score) OVER () > min(score) OVER () THEN (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) ELSE 0.5 END AS s FROM sp) b USING (doc_id))"""
HYBRID_MINMAX = f"WITH {FUSED}, s AS (SELECT doc_id, round(score, 6) AS score FROM m) SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM s ORDER BY rank LIMIT 20"


def hybrid_adjusted(spark, sf):
    """Fused scores, halved for one source and raised for one language."""
    fused = R.fuse_scores(*_channels(spark, sf)).join(table(spark, sf, "documents").select("doc_id", "source", "lang"), "doc_id")
    out = R.adjust(fused, F.col("source") == "src0", F.col("lang") == "de").select("doc_id", F.round("score", 6).alias("score"))
    return C.ranked(out, 20, F.desc("score"), F.asc("doc_id"))


HYBRID_ADJUSTED = f"""WITH {FUSED}, s AS (SELECT doc_id, round(score * CASE WHEN source = 'src0' THEN 0.5 ELSE 1 END * CASE WHEN lang = 'de' THEN 1.2 ELSE 1 END, 6) AS score FROM m JOIN documents USING (doc_id))
SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM s ORDER BY rank LIMIT 20"""


def context_neighbours(spark, sf):
    rows = paras(spark, sf)
    hits = C.literal_search(rows, "license", 20).select("doc_id", "para", "score")
    return C.neighbours(rows, hits, 1)


NEIGHBOURS = f"""WITH {PARAS}, h AS (SELECT doc_id, para, round(len(list_filter(range(0, length(p) - 6), lambda i: substr(lower(p), i + 1, 7) = 'license')) / pow(length(p), 0.3), 6) AS score
FROM paras WHERE contains(lower(p), 'license') ORDER BY score DESC, doc_id, para LIMIT 20),
b AS (SELECT doc_id, para + o AS para, round(max(score * pow(0.9, abs(o))), 6) AS score FROM h, (VALUES (-1), (0), (1)) t(o) GROUP BY 1, 2)
SELECT doc_id, para, score, length(p) AS chars FROM paras JOIN b USING (doc_id, para)"""


def tfidf_keywords(spark, sf):
    return R.tf_idf(words_index(spark, sf), 5)


TFIDF = f"""WITH w AS (SELECT doc_id, unnest({WORDS}) AS word FROM documents), tf AS (SELECT doc_id, word, count(*) AS tf FROM w WHERE length(word) >= 2 GROUP BY 1, 2),
df AS (SELECT word, count(*) AS df FROM tf GROUP BY 1), n AS (SELECT count(*) AS n FROM documents),
s AS (SELECT doc_id, word, tf, df, round(tf * ln(n / df), 6) AS score FROM tf JOIN df USING (word), n)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, word) AS place FROM s) WHERE place <= 5"""


def entity_idf(spark, sf):
    docs = table(spark, sf, "documents")
    found = F.filter(F.array(*[F.lit(t) for t in BAND]), lambda t: F.col("text").contains(t))
    tags = docs.select("doc_id", F.explode(found).alias("entity"))
    return R.entity_idf(tags, docs.count()).withColumn("idf", F.round("idf", 6))


ENTITY_IDF = """WITH t AS (SELECT entity, count(DISTINCT doc_id) AS df FROM documents, (VALUES ('license'), ('rights'), ('token'), ('der ')) v(entity) WHERE contains(text, entity) GROUP BY 1),
r AS (SELECT entity, df, ln(((SELECT count(*) FROM documents) + 1) / (df + 1)) AS x FROM t)
SELECT entity, df, round(greatest(0.3, least(1.5, x / avg(x) OVER ())), 6) AS idf FROM r"""

QUERIES = {
    "literal_search_ranked": literal_search_ranked, "literal_count_by_lang": literal_count_by_lang, "appearances_capped": appearances_capped,
    "multi_term_paragraphs": multi_term_paragraphs, "term_band_cooccurrence": term_band_cooccurrence, "keyword_top10_per_source": keyword_top10_per_source,
    "bm25_search": bm25_search, "bm25_filtered_weighted": bm25_filtered_weighted, "fts_bigram_rank": fts_bigram_rank, "like_fallback_rank": like_fallback_rank,
    "vector_topk": vector_topk, "vector_near_duplicate_check": vector_near_duplicate_check, "vector_norms": vector_norms, "hybrid_rrf": hybrid_rrf,
    "hybrid_minmax": hybrid_minmax, "hybrid_adjusted": hybrid_adjusted, "context_neighbours": context_neighbours, "tfidf_keywords": tfidf_keywords, "entity_idf": entity_idf,
}
ORACLE_SQL = {
    "literal_search_ranked": LITERAL_SEARCH, "literal_count_by_lang": LITERAL_COUNT, "appearances_capped": APPEARANCES, "multi_term_paragraphs": MULTI_TERM,
    "term_band_cooccurrence": BAND_SQL, "keyword_top10_per_source": TOP_WORDS, "bm25_search": _bm25_sql("true"), "bm25_filtered_weighted": _bm25_sql("lang IN ('en', 'de')"),
    "fts_bigram_rank": FTS, "like_fallback_rank": LIKE, "vector_topk": VECTOR_TOPK, "vector_near_duplicate_check": NEAR_DUPLICATE, "vector_norms": NORMS,
    "hybrid_rrf": HYBRID_RRF, "hybrid_minmax": HYBRID_MINMAX, "hybrid_adjusted": HYBRID_ADJUSTED, "context_neighbours": NEIGHBOURS, "tfidf_keywords": TFIDF, "entity_idf": ENTITY_IDF,
}
