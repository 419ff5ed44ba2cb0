"""Tag retrieval over the documents: labels are derived from text, source and language, vectors are the embeddings of the same numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from textlake.functions import scoring as S
from textlake.functions import text as T
from textlake.operators import search as SE
from textlake.operators import tags as G
from textlake.plans._indexes import index_of
from textlake.plans.search import WORDS
from textlake.sources.files import stored
from textlake.sources.tables import table

PERSONS, RAW, LOCATIONS = ["the", "der", "la", "un", "of"], ["th", "er", "on"], ["and", "und", "et", "les"]
PLOTS, TOPICS = ["license", "token", "rights", "secret"], ["license", "copyright"]
VERSIONS = {"en": ["huaben", "tanci"], "de": ["script"]}
ALIKE = [("license", "rights", 0.8), ("secret", "token", 0.76), ("license", "token", 0.5)]
_NAMES = "query_id string, kind string, genre string, text string, plot_detail string, summary string, persons array<string>, persons_raw array<string>, locations array<string>, plot array<string>, topics array<string>, dims array<struct<dim:string,value:string,listed:boolean>>, vec long"
QUESTIONS = [
    ("q1", "plot", "huaben", "who holds the license", "en of src1", "src1 en", ["the", "la"], [], ["und"], ["license"], [], [], 1),
    ("q2", "person", "script", "der und", "", "src2 de", ["der", "un"], [], ["et"], [], [], [], 2),
    ("q3", "comparison", "", "token of copyright", "", "", ["of", "the"], ["th", "on"], [], ["token"], ["copyright"], [("朝代", "清", False), ("文本", "白蛇传", True), ("体裁", "话本", False), ("称谓", "x", True)], 3),
    ("q4", "research", "research_literature", "rights reserved", "", "src7 fr", ["the"], [], ["les"], ["rights"], ["license"], [], 4),
]


def labels_of(spark, sf):
    d = table(spark, sf, "documents")
    has = lambda words: F.filter(F.array(*map(F.lit, words)), lambda w: F.contains("text", w))
    genres = F.array(*[F.lit(g[0]) for g in G.GENRES])
    versions = F.when(F.col("lang") == "en", F.array(*map(F.lit, VERSIONS["en"]))).when(F.col("lang") == "de", F.array(*map(F.lit, VERSIONS["de"]))).otherwise(F.array().cast("array<string>"))
    return d.select(
        "doc_id", "text", F.get(genres, F.pmod(F.regexp_extract("source", "[0-9]+", 0).cast("int"), F.lit(8))).alias("genre"), F.concat("lang", F.lit(" of "), "source").alias("plot_detail"),
        F.concat("source", F.lit(" "), "lang").alias("summary"), has(PERSONS).alias("persons"), has(RAW).alias("persons_raw"), has(LOCATIONS).alias("locations"), has(PLOTS).alias("plot"),
        has(TOPICS).alias("topics"), versions.alias("versions"),
    )


def _weights(labels):
    named = labels.select("doc_id", F.explode(F.array_distinct(F.concat("persons", "locations"))).alias("entity"))
    return SE.entity_idf(named, labels.count()).select("entity", "idf")


def _candidates(spark, sf):
    """(labels, weights, questions, candidates)."""
    whole = labels_of(spark, sf)
    labels = stored(whole.drop("text"))  # texts are searched for labels once
    weights = stored(_weights(labels))
    questions = spark.createDataFrame(QUESTIONS, _NAMES)
    docs = table(spark, sf, "documents")
    tokens = F.concat(T.words(F.col("text")), "persons", "locations", "plot", "topics")
    index = index_of(spark, docs, "labelled words", tokens, ["doc_id"], ["genre"], rows=whole)

    def asked(tokens_of):
        return questions.select("query_id", F.explode(tokens_of).alias("token"), F.lit(1.0).alias("weight"))

    sparse = index.bm25(asked(F.concat(T.words(F.col("text")), "persons", "locations", "plot", "topics")), k=G.CANDIDATES, digits=9)
    plot = index.bm25(asked(F.col("plot")), k=G.PLOT_CANDIDATES, digits=9)
    topical = asked(F.when(F.col("kind").isin("comparison", "research"), F.concat("topics", "plot")).otherwise(F.array().cast("array<string>")))
    research = index.bm25(topical, k=G.RESEARCH_CANDIDATES, digits=9, where=F.col("genre") == G.RESEARCH, columns=["genre"])
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").cast("array<double>").alias("v"))
    own = questions.select("query_id", "vec").join(vectors.withColumnRenamed("doc_id", "vec"), "vec").select("query_id", F.col("v").alias("q"))
    dense = vectors.join(F.broadcast(own)).select("query_id", "doc_id", F.round(S.dot(F.col("v"), F.col("q")), 9).alias("score"))  # the questions: a few rows
    tag = G.tag_scores(questions, labels, weights).withColumn("score", F.round("score", 9))
    rows = stored(G.candidates(dense, sparse, tag, plot, research))
    return labels, weights, questions, rows


def tag_channels(spark, sf):
    """How many candidates each channel brings to a question, and how many they are together."""
    rows = _candidates(spark, sf)[3]
    return rows.groupBy("query_id").agg(F.count("*").alias("n"), *[F.count(c).alias(f"n_{c}") for c in ("dense", "sparse", "tag")], F.round(F.sum("tag"), 5).alias("tags"))


def tag_retrieval(spark, sf):
    labels, weights, questions, rows = _candidates(spark, sf)
    alike = spark.createDataFrame(ALIKE, "a string, b string, cosine double")
    return G.retrieve(rows, G.prepared(questions, weights, alike), labels, 50)


def version_matches(spark, sf):
    """Documents whose genre, or one of the versions they speak of, a comparison's dimensions fit."""
    questions = spark.createDataFrame(QUESTIONS, _NAMES)
    met = labels_of(spark, sf).select("doc_id", "genre", "versions").join(F.broadcast(G.matching_genres(questions)))  # the questions: a few rows
    return met.where(F.array_contains("matching", F.col("genre")) | F.arrays_overlap("matching", "versions")).select("query_id", "doc_id", "genre")


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]::VARCHAR[]"


def _has(words, name) -> str:
    return f"list_filter({_list(words)}, lambda w: contains(text, w)) AS {name}"


_Q = ",\n".join(
    f"('{q}', '{kind}', '{genre}', '{text}', '{detail}', '{summary}', {_list(p)}, {_list(r)}, {_list(lo)}, {_list(pl)}, {_list(to)}, {vec})"
    for q, kind, genre, text, detail, summary, p, r, lo, pl, to, _, vec in QUESTIONS
)
_D = ", ".join(f"('{q[0]}', '{d}', '{v}', {str(listed).lower()})" for q in QUESTIONS for d, v, listed in q[11])
_G = ", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" for x in g) + ")" for g in G.GENRES)
_BI = "list_distinct(list_transform(range(1, greatest(length({x}), 1)), lambda i: substr({x}, i, 2)))"
_FLAT = "regexp_replace(coalesce({c}, ''), '[\\s\\x{{3000}}\\x{{00A0}}]+', '', 'g')"


def _bigrams(c: str) -> str:
    return _BI.format(x=_FLAT.format(c=c))


def _jaccard(a: str, b: str) -> str:
    """Of two lists of distinct values."""
    both = f"len(list_intersect({a}, {b}))"
    return f"CASE WHEN len({a}) + len({b}) > 0 THEN {both} / (len({a}) + len({b}) - {both}) ELSE 0 END"


_VERSIONS = "".join(f" WHEN '{k}' THEN {_list(v)}" for k, v in VERSIONS.items())
MATCHING = f"""dims(query_id, dim, value, listed) AS (VALUES {_D}), genres(genre, dynasty, txt, author, name) AS (VALUES {_G}),
fits AS (SELECT DISTINCT query_id, genre FROM dims, genres WHERE dim <> '{G.ADDRESS}' AND CASE dim WHEN '朝代' THEN dynasty WHEN '文本' THEN txt WHEN '体裁' THEN name ELSE author END IS NOT NULL AND
 (CASE dim WHEN '朝代' THEN dynasty WHEN '文本' THEN txt WHEN '体裁' THEN name ELSE author END = value OR (NOT listed AND (
  contains(CASE dim WHEN '朝代' THEN dynasty WHEN '文本' THEN txt WHEN '体裁' THEN name ELSE author END, value) OR contains(value, CASE dim WHEN '朝代' THEN dynasty WHEN '文本' THEN txt WHEN '体裁' THEN name ELSE author END))))),
lab AS (SELECT doc_id, text, ({_list(g[0] for g in G.GENRES)})[CAST(nullif(regexp_extract(source, '[0-9]+'), '') AS INT) % 8 + 1] AS genre, lang || ' of ' || source AS plot_detail, source || ' ' || lang AS summary,
 {_has(PERSONS, 'persons')}, {_has(RAW, 'persons_raw')}, {_has(LOCATIONS, 'locations')}, {_has(PLOTS, 'plot')}, {_has(TOPICS, 'topics')}, CASE lang{_VERSIONS} ELSE []::VARCHAR[] END AS versions FROM documents)"""
VERSION_MATCHES = f"""WITH {MATCHING}, m AS (SELECT query_id, list(genre) AS matching FROM fits GROUP BY 1)
SELECT query_id, doc_id, genre FROM lab, m WHERE list_contains(matching, genre) OR list_has_any(matching, versions)"""
CHANNELS = f"""{MATCHING},
q(query_id, kind, genre, text, plot_detail, summary, persons, persons_raw, locations, plot, topics, vec) AS (VALUES {_Q}),
ent AS (SELECT entity, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(list_concat(persons, locations)) AS entity FROM lab) GROUP BY 1),
raw AS (SELECT entity, ln(((SELECT count(*) FROM documents) + 1) / (df + 1)) AS r FROM ent),
idf AS (SELECT entity, greatest(0.3, least(1.5, r / avg(r) OVER ())) AS idf FROM raw),
tok AS (SELECT doc_id, genre, list_concat({WORDS}, persons, locations, plot, topics) AS t FROM lab),
st AS (SELECT count(*) AS n, avg(len(t)) AS a FROM tok),
tf AS (SELECT doc_id, genre, len(t) AS dl, token, count(*) AS tf FROM (SELECT doc_id, genre, t, unnest(t) AS token FROM tok) GROUP BY ALL),
df AS (SELECT token, count(*) AS df FROM tf GROUP BY 1),
asked AS (SELECT query_id, 'sparse' AS ch, unnest(list_concat({WORDS}, persons, locations, plot, topics)) AS token FROM q UNION ALL SELECT query_id, 'plot', unnest(plot) FROM q
 UNION ALL SELECT query_id, 'research', unnest(list_concat(topics, plot)) FROM q WHERE kind IN ('comparison', 'research')),
aw AS (SELECT query_id, ch, token, count(*) AS w FROM asked GROUP BY ALL),
bm AS (SELECT query_id, ch, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * w * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / greatest(a, 1.0)))), 9) AS score
 FROM aw JOIN df USING (token) JOIN tf USING (token), st WHERE ch <> 'research' OR genre = '{G.RESEARCH}' GROUP BY ALL),
bmk AS (SELECT query_id, ch, doc_id, score FROM bm WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY query_id, ch ORDER BY score DESC, doc_id) <= CASE ch WHEN 'sparse' THEN 100 ELSE 50 END),
de AS (SELECT query_id, e.vec_id AS doc_id, round(list_inner_product(e.embedding::DOUBLE[], f.embedding::DOUBLE[]), 9) AS score FROM q JOIN embeddings f ON f.vec_id = q.vec, embeddings e
 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 100),
dtag AS (SELECT doc_id, tag, coalesce(idf, 1.0) AS w FROM (SELECT doc_id, list_concat(plot, topics) AS sure, unnest(list_distinct(list_concat(plot, topics, persons, locations))) AS tag FROM lab) LEFT JOIN idf ON entity = tag
 WHERE coalesce(idf, 1.0) >= 0.8 OR list_contains(sure, tag)),
qtag AS (SELECT query_id, tag, coalesce(idf, 1.0) AS w FROM (SELECT query_id, list_concat(plot, topics) AS sure, unnest(list_distinct(list_concat(plot, topics, persons, locations))) AS tag FROM q) LEFT JOIN idf ON entity = tag
 WHERE coalesce(idf, 1.0) >= 0.8 OR list_contains(sure, tag)),
tg AS (SELECT query_id, doc_id, round(sum(x.w * y.w) / (any_value(a) * any_value(b)), 9) AS score FROM qtag x JOIN dtag y USING (tag) JOIN (SELECT query_id, sqrt(sum(w * w)) AS a FROM qtag GROUP BY 1) USING (query_id)
 JOIN (SELECT doc_id, sqrt(sum(w * w)) AS b FROM dtag GROUP BY 1) USING (doc_id) GROUP BY 1, 2),
every AS (SELECT query_id, doc_id, score AS dense, NULL::DOUBLE AS sparse, NULL::DOUBLE AS tag FROM de UNION ALL SELECT query_id, doc_id, NULL, CASE ch WHEN 'sparse' THEN score END, NULL FROM bmk UNION ALL SELECT query_id, doc_id, NULL, NULL, score FROM tg),
c AS (SELECT query_id, doc_id, max(dense) AS dense, max(sparse) AS sparse, max(tag) AS tag FROM every GROUP BY 1, 2)"""
TAG_CHANNELS = f"WITH {CHANNELS} SELECT query_id, count(*) AS n, count(dense) AS n_dense, count(sparse) AS n_sparse, count(tag) AS n_tag, round(sum(tag), 5) AS tags FROM c GROUP BY 1"


def _scaled(x: str) -> str:
    over = "OVER (PARTITION BY query_id)"
    return f"CASE WHEN {x} IS NULL THEN 0 WHEN max({x}) {over} > min({x}) {over} THEN ({x} - min({x}) {over}) / (max({x}) {over} - min({x}) {over}) ELSE 0.5 END"


def _idf_sum(x: str) -> str:
    return f"coalesce((SELECT sum(coalesce(i.idf, 1.0)) FROM (SELECT unnest(list_intersect(q.{x}, l.{x})) AS e) u LEFT JOIN idf i ON i.entity = u.e), 0)"


def _idf_max(x: str) -> str:
    return f"coalesce((SELECT max(coalesce(i.idf, 1.0)) FROM (SELECT unnest(list_intersect(q.{x}, l.{x})) AS e) u LEFT JOIN idf i ON i.entity = u.e), 0)"


TAG_RETRIEVAL = f"""WITH {CHANNELS},
qb AS (SELECT query_id, {_bigrams('plot_detail')} AS detail, {_bigrams('summary')} AS summary FROM q), lb AS (SELECT doc_id, {_bigrams('plot_detail')} AS detail, {_bigrams('summary')} AS summary FROM lab),
alike(a, b) AS (VALUES {', '.join(f"('{a}', '{b}'), ('{b}', '{a}')" for a, b, s in ALIKE if s >= G.PLOT_ALIKE)}),
near AS (SELECT query_id, list(DISTINCT u) AS near FROM (SELECT query_id, unnest(plot) AS u FROM q UNION ALL SELECT query_id, b FROM (SELECT query_id, unnest(plot) AS p FROM q) JOIN alike ON a = p) GROUP BY 1),
mt AS (SELECT query_id, list(genre) AS matching FROM fits GROUP BY 1), dm AS (SELECT query_id, bool_or(dim <> '{G.ADDRESS}') AS versioned, bool_or(dim = '{G.ADDRESS}') AS addressed FROM dims GROUP BY 1),
base AS (SELECT query_id, doc_id, 0.4 * {_scaled('dense')} + 0.4 * {_scaled('sparse')} + 0.2 * {_scaled('tag')} AS base FROM c),
x AS (SELECT b.query_id, b.doc_id, b.base, q.kind, q.genre AS qg, l.genre AS dg, coalesce(l.genre = '{G.RESEARCH}', false) AS research, coalesce(versioned, false) AS versioned, coalesce(addressed, false) AS addressed,
  coalesce(list_has_any(near, l.plot), false) AS same_plot, coalesce(list_has_any(q.topics, l.topics), false) AS same_topic, coalesce(list_has_any(matching, l.versions), false) AS mv, coalesce(list_contains(matching, l.genre), false) AS mg,
  coalesce(len(list_intersect(q.plot, l.plot)), 0) AS np, coalesce(len(list_intersect(q.persons_raw, l.persons_raw)), 0) AS nr, 0.10 * {_idf_sum('persons')} + 0.09 * {_idf_sum('locations')} AS named,
  {_idf_max('persons')} >= 0.8 OR {_idf_max('locations')} >= 0.8 AS telling, {_jaccard('qb.detail', 'lb.detail')} AS detail, {_jaccard('qb.summary', 'lb.summary')} AS summ
 FROM base b JOIN q USING (query_id) JOIN qb USING (query_id) LEFT JOIN lab l USING (doc_id) LEFT JOIN lb USING (doc_id) LEFT JOIN near USING (query_id) LEFT JOIN mt USING (query_id) LEFT JOIN dm USING (query_id)),
y AS (SELECT *, CASE WHEN research THEN CASE WHEN kind = 'comparison' AND versioned AND mv THEN 0.05 ELSE 0 END + CASE WHEN kind = 'plot' THEN 0.05 * np ELSE 0 END + CASE WHEN kind IN ('plot', 'person', 'place', 'research') THEN named ELSE 0 END
  ELSE CASE WHEN kind = 'plot' THEN 0.20 * detail ELSE 0 END + CASE WHEN kind IN ('plot', 'person', 'place', 'comparison') THEN named ELSE 0 END + CASE WHEN kind = 'comparison' AND addressed THEN 0.05 * nr ELSE 0 END END
  + CASE WHEN kind = 'comparison' AND versioned AND mg THEN 0.05 ELSE 0 END + 0.10 * summ AS added,
  CASE WHEN research THEN kind IN ('comparison', 'research') AND (same_topic OR same_plot) ELSE (kind = 'plot' AND same_plot) OR (kind IN ('person', 'place') AND telling) END AS hard FROM x)
SELECT query_id, doc_id, round((base + added) * CASE WHEN qg = dg AND qg <> '' THEN 1.2 ELSE 1 END + CASE WHEN hard THEN 10 ELSE 0 END, 6) AS score, hard,
 row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM y QUALIFY rank <= 50"""

QUERIES = {"tag_channels": tag_channels, "tag_retrieval": tag_retrieval, "version_matches": version_matches}
ORACLE_SQL = {"tag_channels": TAG_CHANNELS, "tag_retrieval": TAG_RETRIEVAL, "version_matches": VERSION_MATCHES}
