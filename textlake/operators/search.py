"""BM25, bigram search, vector search, fusion, boosts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textlake.functions import scoring as S
from textlake.functions import text as T
from textlake.operators.postings import Index


def bm25(docs: DataFrame, queries: DataFrame, id_col: str = "doc_id", tokens: Column | None = None, where: Column | None = None, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(query_id, id, score) of all documents with a positive score, for queries (query_id, token, weight).

    One pass over texts that have no stored index (`postings.Index`): all tokens are exploded and met with the queries'.
    Document frequencies and lengths cover all documents, also where a filter applies.
    """
    tokens = T.words(F.col("text")) if tokens is None else tokens
    wanted = queries.select("token").distinct()
    base = docs.withColumn("__tokens", tokens)
    keep = [id_col] + (["__keep"] if where is not None else [])
    if where is not None:
        base = base.withColumn("__keep", where)
    base = base.select(*keep, "__tokens", F.size("__tokens").alias("__length"))
    stats = base.agg(F.count("*").alias("__n"), F.avg("__length").alias("__average"))
    terms = base.select(*keep, "__length", F.explode("__tokens").alias("token"))
    terms = terms.join(wanted, "token", "left_semi")  # the queries' tokens; Spark broadcasts them while they are few
    terms = terms.groupBy(*keep, "__length", "token").agg(F.count("*").alias("__tf"))
    df = terms.groupBy("token").agg(F.count("*").alias("__df"))
    terms = terms.where("__keep") if where is not None else terms
    asked = queries.groupBy("query_id", "token").agg((F.count("*") * F.max("weight")).alias("__weight"))
    rows = terms.join(df, "token").join(asked, "token").join(F.broadcast(stats))  # stats: one row
    part = S.bm25_idf(F.col("__n"), F.col("__df")) * S.bm25_tf(F.col("__tf"), F.col("__length"), F.col("__average"), k1, b) * F.col("__weight")
    scored = rows.groupBy("query_id", id_col).agg(F.sum(part).alias("score"))
    return scored.where("score > 0")


def query_table(docs: DataFrame, queries: Mapping[str, Sequence[tuple[str, float]]]) -> DataFrame:
    rows = [(q, t, float(w)) for q, terms in queries.items() for t, w in terms]
    return docs.sparkSession.createDataFrame(rows, "query_id string, token string, weight double")


def top_k(scored: DataFrame, k: int, id_col: str = "doc_id") -> DataFrame:
    """The k best of each query; each task keeps k rows of a query."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), id_col))
    return scored.withColumn("rank", place).where(F.col("rank") <= k)


def bigram_search(messages: DataFrame, query: str, ids: Sequence[str]) -> DataFrame:
    """Messages with any token of the query (Chinese bigrams, words), ranked by how many of the tokens they have."""
    wanted = query_bigrams(query)
    found = F.array_distinct(F.filter(T.fts_tokens(F.col("text")), lambda t: t.isin(*wanted)))
    rows = messages.select(*ids, F.size(found).cast("bigint").alias("matched"), T.token_estimate(F.col("text")).alias("tokens"))
    return rows.where("matched > 0").withColumn("score", F.round(F.col("matched") / len(wanted), 6))


def query_bigrams(query: str, most: int = 60) -> list[str]:
    """The distinct tokens of a query (words of two characters or more, Chinese bigrams) in order, `most` at most: a query's limit."""
    import re

    return sorted({m for m in re.findall("[a-z0-9]{2,}", query.lower())} | {r[i : i + 2] for r in re.findall("[一-鿿]{2,}", query) for i in range(len(r) - 1)})[:most]


def bigram_ranked(index: Index, query: str) -> DataFrame:
    """`bigram_search` from a stored index whose documents keep `tokens`: only the postings of the query's tokens are read."""
    wanted = query_bigrams(query)
    tokens = index.spark.createDataFrame([(t,) for t in wanted], "token string")
    return index.matched(tokens, "tokens").withColumn("score", F.round(F.col("matched") / max(1, len(wanted)), 6))


def like_search(messages: DataFrame, query: str, ids: Sequence[str]) -> DataFrame:
    """Fallback: the share of the query's distinct character pairs that a message contains."""
    pairs = sorted({query[i : i + 2] for i in range(len(query) - 1)})
    hit = sum((F.col("text").contains(p).cast("int") for p in pairs), F.lit(0))
    return messages.select(*ids, F.round(hit / len(pairs), 6).alias("score")).where("score > 0")


def centroids(vectors: DataFrame, key: str, vector_col: str = "embedding") -> DataFrame:
    """(key, vector): mean vectors, position by position; partial sums are combined before the shuffle."""
    parts = vectors.select(key, F.posexplode(vector_col).alias("i", "x")).groupBy(key, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    parts = parts.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v"))
    return parts.select(key, F.transform("v", lambda s: s["x"]).alias("vector"))


#: Queries that every task holds at most, and parts into which the rows that meet one block of queries are dealt.
HELD, SPREAD = 10_000, 64


def vector_search(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k rows nearest by cosine to each query vector (query_id, vector). Up to HELD queries are held by every task; of more, each
    block of HELD meets all rows in a join of its own, dealt over SPREAD parts."""
    blocks = max(1, -(-queries.count() // HELD))
    if blocks == 1:
        met = vectors.join(F.broadcast(queries))
    else:
        each = queries.withColumn("__block", F.pmod(F.xxhash64("query_id"), F.lit(blocks))).withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
        rows = vectors.withColumn("__block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))))
        met = rows.withColumn("__part", F.pmod(F.xxhash64(id_col), F.lit(SPREAD)).cast("int")).join(each, ["__block", "__part"])
    return top_k(met.select("query_id", id_col, S.cosine(F.col(vector_col), F.col("vector")).alias("score")), k, id_col)


def fuse_ranks(channels: Mapping[str, tuple[DataFrame, float]], id_col: str = "doc_id", k: int = 20) -> DataFrame:
    """Reciprocal-rank fusion of channels (id, rank): sum of weight / (k + rank)."""
    parts = [df.select(id_col, S.reciprocal_rank(F.col("rank"), w, k).alias("part")) for df, w in channels.values()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(id_col).agg(F.sum("part").alias("score"))


def fuse_scores(dense: DataFrame, sparse: DataFrame, weight: float = 0.5, id_col: str = "doc_id", flat: float = 0.5) -> DataFrame:
    """Each channel's scores (id, score) to [0, 1], a missing side 0, then weighted."""

    def scaled(rows: DataFrame, name: str) -> DataFrame:
        best = rows.groupBy(id_col).agg(F.max("score").alias("s"))
        ends = best.agg(F.min("s").alias("low"), F.max("s").alias("high"))
        value = F.when(F.col("high") > F.col("low"), (F.col("s") - F.col("low")) / (F.col("high") - F.col("low"))).otherwise(F.lit(flat))
        return best.join(F.broadcast(ends)).select(id_col, value.alias(name))

    both = scaled(dense, "d").join(scaled(sparse, "s"), id_col, "full_outer")
    return both.select(id_col, (F.coalesce("d", F.lit(0.0)) * weight + F.coalesce("s", F.lit(0.0)) * (1 - weight)).alias("score"))


def adjust(scored: DataFrame, penalised: Column, boosted: Column, penalty: float = 0.5, boost: float = 1.2) -> DataFrame:
    """Scores times a penalty, then times a boost, where these hold."""
    score = F.col("score") * F.when(penalised, penalty).otherwise(1.0) * F.when(boosted, boost).otherwise(1.0)
    return scored.withColumn("score", score)


def entity_idf(tags: DataFrame, n_docs: int, low: float = 0.3, high: float = 1.5) -> DataFrame:
    """(entity, df, idf): ln((n + 1) / (df + 1)) over its mean, clamped. `tags`: doc_id, entity."""
    df = tags.select("doc_id", "entity").distinct().groupBy("entity").agg(F.count("*").alias("df"))
    raw = df.withColumn("raw", F.log((F.lit(n_docs) + 1) / (F.col("df") + 1)))
    mean = raw.agg(F.avg("raw").alias("mean"))
    return raw.join(F.broadcast(mean)).select("entity", "df", S.clamped(F.col("raw") / F.col("mean"), low, high).alias("idf"))


#: Words whose document frequency is broadcast: the commonest, so that no other word's rows crowd the join.
COMMON = 1024


def tf_idf(index: Index, k: int, id_col: str = "doc_id") -> DataFrame:
    """The k keywords of each document of an index by tf * ln(n / df). Counts come from its forward table, frequencies from the headers of its
    postings; the commonest words get theirs from a broadcast table of COMMON rows, and are spread in the join for the others."""
    tf = index.terms().select(id_col, F.col("token").alias("word"), F.col("tf").cast("bigint").alias("tf")).where(F.length("word") >= 2)
    df = index.frequencies()
    if df is None:
        return tf.withColumns({"df": F.lit(0).cast("bigint"), "score": F.lit(0.0), "place": F.lit(0)}).limit(0)
    df = df.select(F.col("token").alias("word"), "df")
    top = df.orderBy(F.desc("df"), "word").limit(COMMON).select("word", F.col("df").alias("__top"))
    rows = tf.join(F.broadcast(top), "word", "left")
    rows = rows.withColumn("__spread", F.when(F.col("__top").isNotNull(), F.xxhash64(id_col, "word")).otherwise(F.lit(0).cast("bigint")))
    rows = rows.join(df.withColumn("__spread", F.lit(0).cast("bigint")), ["word", "__spread"], "left").withColumn("df", F.coalesce("__top", "df"))
    n, _ = index.statistics()
    scored = rows.withColumn("score", F.round(F.col("tf") * F.log(F.lit(n) / F.col("df")), 6))
    place = F.row_number().over(Window.partitionBy(id_col).orderBy(F.desc("score"), "word"))
    return scored.withColumn("place", place).where(F.col("place") <= k).select(id_col, "word", "tf", "df", "score", "place")
