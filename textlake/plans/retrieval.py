"""Queries of query understanding and tag retrieval over documents, whose texts also stand for questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from textlake.functions import scoring as S
from textlake.functions import text as T
from textlake.operators import patterns as D
from textlake.operators import retrieval as R
from textlake.operators import search as SE
from textlake.plans._indexes import index_of
from textlake.plans.search import WORDS
from textlake.sources.tables import table

ALIASES = {"license": "Licence", "licensed": "Licence", "token": "Token", "the": "Article", "der": "Article", "copyright": "Rights"}
VERSIONS = [("the", "era", "en"), ("der", "era", "de"), ("license", "genre", "legal"), ("token", "genre", "secret")]
SYNONYMS = [["license", "licence", "permit"], ["token", "secret", "key"]]


def docs_of(spark, sf, *more):
    return table(spark, sf, "documents").select("doc_id", "source", "lang", "text", *more)


def alias_names(spark, sf):
    return D.longest_names(docs_of(spark, sf), spark.createDataFrame(list(ALIASES.items()), "alias string, name string"))


ALIAS = "SELECT doc_id, CASE " + " ".join(f"WHEN contains(text, '{a}') THEN '{ALIASES[a]}'" for a in sorted(ALIASES, key=lambda a: (-len(a), a))) + " END AS name FROM documents"


def canonical_sources(spark, sf):
    d = docs_of(spark, sf)
    mapping = d.select(F.col("source").alias("raw"), F.when(F.col("doc_id") % 7 == 0, "deleted").otherwise(F.concat(F.lit("Place of "), "lang")).alias("canonical"), F.col("doc_id").alias("place"))
    return R.canonical_names(d.select("doc_id", "source"), mapping.where("place % 2 = 0"), "source", "deleted")


CANONICAL = """WITH m AS (SELECT source AS raw, arg_min('Place of ' || lang, doc_id) AS c FROM documents WHERE doc_id % 2 = 0 AND doc_id % 7 <> 0 GROUP BY 1)
SELECT doc_id, source, coalesce(c, source) AS canonical FROM documents LEFT JOIN m ON source = raw"""


def synonym_expansion(spark, sf):
    groups = spark.createDataFrame([(g, i, w) for g, own in enumerate(SYNONYMS) for i, w in enumerate(own)], "grp int, place int, word string")
    docs = docs_of(spark, sf)
    more = D.missing_synonyms(docs, groups).join(docs.select("doc_id", "text"), "doc_id")
    return more.select("doc_id", F.md5(F.concat_ws(" ", "text", F.array_join("words", " "))).alias("digest"))


SYN = (
    "SELECT doc_id, md5(text || ' ' || array_to_string(list_concat("
    + ", ".join(f"CASE WHEN {' OR '.join(f'contains(text, {w!r})' for w in g)} THEN list_filter({g!r}, lambda w: NOT contains(text, w)) ELSE []::VARCHAR[] END" for g in SYNONYMS)
    + "), ' ')) AS digest FROM documents"
)


def version_constraints(spark, sf):
    return docs_of(spark, sf).select("doc_id", R.version_filter(F.col("text"), VERSIONS).alias("constraint_found"))


VERSION = """WITH c AS (SELECT doc_id, contains(text, 'the')::INT + contains(text, 'der')::INT AS e, contains(text, 'license')::INT + contains(text, 'token')::INT AS g, text FROM documents)
SELECT doc_id, CASE WHEN e = 1 THEN CASE WHEN contains(text, 'the') THEN 'era=en' ELSE 'era=de' END WHEN e > 1 THEN NULL
 WHEN g = 1 THEN CASE WHEN contains(text, 'license') THEN 'genre=legal' ELSE 'genre=secret' END END AS constraint_found FROM c"""


def research_intent(spark, sf):
    words = ["according", "study", "license", "copyright", "source", "compare"]
    return docs_of(spark, sf).groupBy("lang", R.any_of(F.lower("text"), words).alias("research")).agg(F.count("*").alias("n"))


INTENT = """SELECT lang, regexp_matches(lower(text), 'according|study|license|copyright|source|compare') AS research, count(*) AS n FROM documents GROUP BY ALL"""


def number_references(spark, sf):
    found = R.references(F.col("text"), r"\b([0-9]{1,3})\b")
    return docs_of(spark, sf).select("doc_id", F.array_join(found.cast("array<string>"), ",").alias("numbers"))


REFERENCES = r"""WITH f AS (SELECT doc_id, list_transform(regexp_extract_all(text, '\b([0-9]{1,3})\b', 1), lambda x: x::INT) AS l FROM documents)
SELECT doc_id, array_to_string(list_transform(list_filter(range(1, len(l) + 1), lambda i: list_position(l, l[i]) = i), lambda i: l[i]::VARCHAR), ',') AS numbers FROM f"""


def query_keywords(spark, sf):
    return docs_of(spark, sf).select("doc_id", F.array_join(R.fallback_keywords(F.substring("text", 1, 200)), "|").alias("keywords"))


KEYWORDS = r"""WITH x AS (SELECT doc_id, substr(text, 1, 200) AS q FROM documents), y AS (SELECT doc_id, q, list_filter(string_split_regex(q, '[\s\x0b,.;:!?，。；：！？、]+'), lambda x: length(x) >= 2)[1:5] AS l FROM x)
SELECT doc_id, CASE WHEN len(l) > 0 THEN array_to_string(l, '|') ELSE q END AS keywords FROM y"""


def keyword_only_search(spark, sf):
    return R.keyword_only(docs_of(spark, sf), ["license", "token", "der", "copyright"], 50)


KEYWORD_ONLY = """WITH s AS (SELECT doc_id, (contains(lower(text), 'license')::INT + contains(lower(text), 'token')::INT + contains(lower(text), 'der')::INT + contains(lower(text), 'copyright')::INT) / 4 AS score FROM documents)
SELECT * FROM s WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 50"""


def tag_augmented_bm25(spark, sf):
    d = docs_of(spark, sf)
    index = index_of(spark, table(spark, sf, "documents"), "tagged words", R.tag_tokens(F.col("text"), F.array("source", "lang")), ["doc_id"])
    found = index.bm25(SE.query_table(d, {"q": [("src3", 1.0), ("license", 1.0), ("the", 0.5)]}), k=20)
    return found.select("doc_id", F.round("score", 6).alias("score"), "rank")


TAG_BM25 = f"""WITH t AS (SELECT doc_id, list_concat({WORDS}, [lower(source), lower(lang)]) AS ws FROM documents), s AS (SELECT count(*) AS n, avg(len(ws)) AS a FROM t),
e AS (SELECT doc_id, len(ws) AS l, unnest(ws) AS w FROM t), f AS (SELECT doc_id, l, w, count(*) AS tf FROM e WHERE w IN ('src3', 'license', 'the') GROUP BY ALL),
d AS (SELECT w, count(*) AS df FROM f GROUP BY 1),
r AS (SELECT doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * l / a)) * CASE w WHEN 'the' THEN 0.5 ELSE 1.0 END) AS score FROM f JOIN d USING (w), s GROUP BY 1)
SELECT doc_id, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM r WHERE score > 0 QUALIFY rank <= 20"""


def _channels(spark, sf):
    d = docs_of(spark, sf, "n_chars")
    count = lambda w: T.count_literal(F.col("text"), w).cast("double")
    rows = d.select("doc_id", count("license").alias("a"), count("der").alias("b"), (F.contains("text", F.lit("token")).cast("double") * F.col("doc_id") % 97).alias("c"))
    return {n: (rows.select("doc_id", F.col(n).alias("score")).where("score > 0"), k) for n, k in (("a", 40), ("b", 60), ("c", 30))}


def channel_candidates(spark, sf):
    return R.candidates(_channels(spark, sf))


CHANNELS = """x AS (SELECT doc_id, ((length(text) - length(replace(text, 'license', ''))) // 7)::DOUBLE AS a, ((length(text) - length(replace(text, 'der', ''))) // 3)::DOUBLE AS b,
 (contains(text, 'token')::DOUBLE * doc_id) % 97 AS c FROM documents),
u AS ((SELECT doc_id, 'a' AS ch, a AS s FROM x WHERE a > 0 ORDER BY a DESC, doc_id LIMIT 40) UNION ALL (SELECT doc_id, 'b', b FROM x WHERE b > 0 ORDER BY b DESC, doc_id LIMIT 60)
 UNION ALL (SELECT doc_id, 'c', c FROM x WHERE c > 0 ORDER BY c DESC, doc_id LIMIT 30)),
g AS (SELECT doc_id, max(s) FILTER (ch = 'a') AS a, max(s) FILTER (ch = 'b') AS b, max(s) FILTER (ch = 'c') AS c, count(*) AS found_by FROM u GROUP BY 1)"""
CANDIDATES = f"WITH {CHANNELS} SELECT * FROM g"


def boosted_candidates(spark, sf):
    rows = R.candidates(_channels(spark, sf)).join(docs_of(spark, sf).drop("text"), "doc_id")
    boost = R.tag_boost("entity", F.col("found_by"), F.col("source") == "src3", F.col("lang") == "de")
    out = R.fused(rows, {"a": 0.4, "b": 0.4, "c": 0.2}, boost, F.col("lang") == "de", F.col("source") == "src7")
    return out.orderBy(F.desc("score"), "doc_id").limit(40).select("doc_id", F.round("score", 6).alias("score"))


BOOSTED = f"""WITH {CHANNELS}, m AS (SELECT min(a) AS la, max(a) AS ha, min(b) AS lb, max(b) AS hb, min(c) AS lc, max(c) AS hc FROM g),
f AS (SELECT g.doc_id, (coalesce(CASE WHEN ha > la THEN (a - la) / (ha - la) ELSE 0.5 END, 0) * 0.4 + coalesce(CASE WHEN hb > lb THEN (b - lb) / (hb - lb) ELSE 0.5 END, 0) * 0.4
 + coalesce(CASE WHEN hc > lc THEN (c - lc) / (hc - lc) ELSE 0.5 END, 0) * 0.2 + least(found_by, 3) * 0.3 / 3 + CASE WHEN source = 'src3' THEN 0.1 ELSE 0 END + CASE WHEN lang = 'de' THEN 0.05 ELSE 0 END)
 * CASE WHEN lang = 'de' THEN 1.2 ELSE 1 END + CASE WHEN source = 'src7' THEN 10 ELSE 0 END AS score FROM g JOIN documents d ON g.doc_id = d.doc_id, m)
SELECT doc_id, round(score, 6) AS score FROM f ORDER BY f.score DESC, doc_id LIMIT 40"""


def tiered_search(spark, sf):
    return R.tiers(docs_of(spark, sf), [["license"], ["zzzz"], ["token"], ["der", "die"]], "source", 30).select("doc_id", "source", "level")


TIERS = """WITH x AS (SELECT doc_id, source, CASE WHEN contains(lower(text), 'license') THEN 0 WHEN contains(lower(text), 'zzzz') THEN 1 WHEN contains(lower(text), 'token') THEN 2
 WHEN contains(lower(text), 'der') AND contains(lower(text), 'die') THEN 3 END AS level FROM documents),
c AS (SELECT source, count(*) FILTER (level = 0) AS n0, count(*) FILTER (level = 1) AS n1, count(*) FILTER (level = 2) AS n2 FROM x WHERE level IS NOT NULL GROUP BY 1),
s AS (SELECT source, CASE WHEN n0 >= 30 THEN 0 WHEN n0 + n1 >= 30 OR (n0 = 0 AND n1 = 0) THEN 1 WHEN n0 + n1 + n2 >= 30 OR (n1 = 0 AND n2 = 0) THEN 2 ELSE 3 END AS last FROM c)
SELECT doc_id, x.source, level FROM x JOIN s ON x.source IS NOT DISTINCT FROM s.source WHERE level <= last"""


def era_quotas(spark, sf):
    rows = docs_of(spark, sf).select("doc_id", "lang", T.count_literal(F.col("text"), "e").alias("score"))
    return R.quotas(rows, "lang", 10, 15).select("doc_id", "lang", "score", "rank")


QUOTAS = """WITH x AS (SELECT doc_id, lang, (length(text) - length(replace(text, 'e', '')))::BIGINT AS score FROM documents), y AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, doc_id) AS place FROM x QUALIFY place <= 10)
SELECT doc_id, lang, score, row_number() OVER (ORDER BY place > 1, score DESC, doc_id) AS rank FROM y QUALIFY rank <= 15"""


def source_passages(spark, sf):
    return R.passages_of(docs_of(spark, sf), "source").select("source", F.md5("passages").alias("digest"), F.length("passages").alias("chars"))


PASSAGES = """WITH x AS (SELECT source, substr(text, 1, 300) AS t, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents QUALIFY k <= 2)
SELECT source, md5(string_agg(t, chr(10) ORDER BY k)) AS digest, length(string_agg(t, chr(10) ORDER BY k))::INT AS chars FROM x GROUP BY 1"""


def cell_values(spark, sf):
    """What a matrix shows for each source and language: the count and the start of a summary, or a dash."""
    cells = docs_of(spark, sf).groupBy("source", "lang").agg(F.count_if(F.contains("text", F.lit("license"))).alias("n"), F.min(F.substring("text", 1, 120)).alias("t"))
    return cells.select("source", "lang", F.when(F.col("n") > 0, F.concat(F.col("n").cast("string"), F.lit(" · "), "t")).otherwise("–").alias("shown"))


CELL_VALUES = """SELECT source, lang, CASE WHEN count(*) FILTER (contains(text, 'license')) > 0 THEN count(*) FILTER (contains(text, 'license')) || ' · ' || min(substr(text, 1, 120)) ELSE '–' END AS shown FROM documents GROUP BY ALL"""


def multi_word_filter(spark, sf):
    words = ["license", "token"]
    rows = docs_of(spark, sf).where(R.any_of(F.lower("text"), words) | R.any_of(F.lower("source"), words))
    total = sum((T.count_literal(F.lower("text"), w) for w in words), F.lit(0))
    return rows.agg(F.count("*").alias("chapters"), F.sum(total).cast("bigint").alias("matches"))


MULTI_WORD = """SELECT count(*) AS chapters, sum((length(text) - length(replace(lower(text), 'license', ''))) // 7 + (length(text) - length(replace(lower(text), 'token', ''))) // 5)::BIGINT AS matches
FROM documents WHERE contains(lower(text), 'license') OR contains(lower(text), 'token') OR contains(lower(source), 'license') OR contains(lower(source), 'token')"""


def guarded_cosines(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    base = e.where("vec_id = 0").select(F.col("v").alias("q"))
    return e.join(F.broadcast(base)).select("vec_id", F.round(R.guarded_cosine(F.col("v"), F.col("q")), 6).alias("likeness"))  # one query vector


GUARDED = """WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0)
SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], q) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(q, q)) + 1e-9), 6) AS likeness FROM embeddings, q"""


def recall_by_label(spark, sf):
    """Of the 50 rows most like a vector, how many each label has."""
    e = table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    base = e.where("vec_id = 0").select(F.col("v").alias("q"))
    best = e.join(F.broadcast(base)).withColumn("score", S.dot(F.col("v"), F.col("q"))).orderBy(F.desc("score"), "vec_id").limit(50)
    return best.groupBy("label").agg(F.count("*").alias("n"))


RECALL = """WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0), b AS (SELECT label FROM embeddings, q ORDER BY list_dot_product(embedding::DOUBLE[], q) DESC, vec_id LIMIT 50)
SELECT label, count(*) AS n FROM b GROUP BY 1"""


QUERIES = {
    "alias_names": alias_names, "canonical_sources": canonical_sources, "synonym_expansion": synonym_expansion, "version_constraints": version_constraints, "research_intent": research_intent,
    "number_references": number_references, "query_keywords": query_keywords, "keyword_only_search": keyword_only_search, "tag_augmented_bm25": tag_augmented_bm25, "channel_candidates": channel_candidates,
    "boosted_candidates": boosted_candidates, "tiered_search": tiered_search, "era_quotas": era_quotas, "source_passages": source_passages, "cell_values": cell_values,
    "multi_word_filter": multi_word_filter, "guarded_cosines": guarded_cosines, "recall_by_label": recall_by_label,
}
ORACLE_SQL = {
    "alias_names": ALIAS, "canonical_sources": CANONICAL, "synonym_expansion": SYN, "version_constraints": VERSION, "research_intent": INTENT,
    "number_references": REFERENCES, "query_keywords": KEYWORDS, "keyword_only_search": KEYWORD_ONLY, "tag_augmented_bm25": TAG_BM25, "channel_candidates": CANDIDATES,
    "boosted_candidates": BOOSTED, "tiered_search": TIERS, "era_quotas": QUOTAS, "source_passages": PASSAGES, "cell_values": CELL_VALUES,
    "multi_word_filter": MULTI_WORD, "guarded_cosines": GUARDED, "recall_by_label": RECALL,
}
