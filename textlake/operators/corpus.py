"""Paragraph tables, literal search, appearances, co-occurrence, trends, matrices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textlake.functions import text as T


def paragraphs(docs: DataFrame, separator: str = "\n", text_col: str = "text") -> DataFrame:
    """`docs` without the text, a row for each non-empty paragraph: para (from 0) and paragraph."""
    rest = [c for c in docs.columns if c != text_col]
    return docs.select(*rest, F.posexplode(T.paragraphs(F.col(text_col), separator)).alias("para", "paragraph"))


def ranked(rows: DataFrame, k: int, *order: Column, name: str = "rank") -> DataFrame:
    """The first k rows in an order, numbered. Each task keeps k rows, so only k from each are gathered."""
    return rows.orderBy(*order).limit(k).withColumn(name, F.row_number().over(Window.orderBy(*order)))


def literal_search(paras: DataFrame, word: str, k: int, before: int = 20, after: int = 40) -> DataFrame:
    """Paragraphs with `word`: overlapping hits, relevance, an excerpt around the first; the k best."""
    if len(word) < 2:
        raise ValueError("a query of two characters at least")
    hits = paras.where(F.lower("paragraph").contains(word.lower())).withColumn("at", T.overlapping_positions(F.col("paragraph"), word))
    first = F.element_at("at", 1)
    scored = hits.select(
        "doc_id",
        "para",
        F.size("at").cast("bigint").alias("hits"),
        F.round(T.relevance(F.size("at"), F.length("paragraph")), 6).alias("score"),
        T.excerpt(F.col("paragraph"), first, first + len(word), before, after).alias("excerpt"),
    )
    return ranked(scored, k, F.desc("score"), F.asc("doc_id"), F.asc("para"))


def literal_counts(docs: DataFrame, word: str, key: str) -> DataFrame:
    """Matches that don't overlap by `key`, with each key's share of all; a null key is shown as 'other'."""
    counts = docs.groupBy(F.coalesce(key, F.lit("other")).alias(key)).agg(F.sum(T.count_literal(F.col("text"), word)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())  # over a row for each key
    return counts.withColumn("share", F.when(total > 0, F.round(F.col("n") / total, 3)).otherwise(0.0))


def appearances(docs: DataFrame, word: str, key: str, cap: int, around: int = 60) -> DataFrame:
    """Each match with its surroundings, the first `cap` of each key in document order, and whether there are more."""
    found = docs.where(F.col("text").contains(word)).select("doc_id", key, "text", F.explode(T.positions(F.col("text"), word)).alias("pos"))
    found = found.select("doc_id", key, "pos", T.excerpt(F.col("text"), F.col("pos"), F.col("pos") + len(word), around, around).alias("excerpt"))
    totals = found.groupBy(F.col(key).alias("__key")).agg(F.count("*").alias("total"))
    place = F.row_number().over(Window.partitionBy(key).orderBy("doc_id", "pos"))
    first = found.withColumn("place", place).where(F.col("place") <= cap)  # each task keeps `cap` rows of a key
    joined = first.join(totals, F.col(key).eqNullSafe(F.col("__key"))).drop("__key")
    return joined.withColumn("truncated", F.col("total") > cap)


def with_all_terms(paras: DataFrame, terms: Sequence[str]) -> DataFrame:
    """Paragraphs that contain every term, with the count of each."""
    rows = paras
    for t in terms:
        rows = rows.where(F.col("paragraph").contains(t))
    return rows.select("doc_id", "para", *[T.count_literal(F.col("paragraph"), t).alias(f"n_{i}") for i, t in enumerate(terms)])


def term_hits(paras: DataFrame, terms: Sequence[str]) -> DataFrame:
    """(term, doc_id, para) of each term in each paragraph."""
    found = F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: F.col("paragraph").contains(t))
    return paras.select(F.explode(found).alias("term"), "doc_id", "para")


def band_cooccurrence(hits: DataFrame, window: int) -> DataFrame:
    """(a, b, n): pairs of hits of two terms at most `window` paragraphs apart in one document; symmetric, the diagonal
    holds each term's hits. A band join: by bucket of `window` + 1 paragraphs and its neighbours, then by distance."""
    wide = window + 1
    left = hits.select(F.col("term").alias("a"), "doc_id", F.col("para").alias("pa"), F.floor(F.col("para") / wide).alias("bucket"))
    near = F.explode(F.array(F.floor(F.col("para") / wide) - 1, F.floor(F.col("para") / wide), F.floor(F.col("para") / wide) + 1))
    right = hits.select(F.col("term").alias("b"), "doc_id", F.col("para").alias("pb"), near.alias("bucket"))
    pairs = left.join(right, ["doc_id", "bucket"]).where((F.col("a") != F.col("b")) & (F.abs(F.col("pa") - F.col("pb")) <= window))
    own = hits.groupBy(F.col("term").alias("a"), F.col("term").alias("b")).agg(F.count("*").alias("n"))
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n")).unionByName(own)


def top_words(docs: DataFrame, key: str, k: int, least: int = 2, stop: Sequence[str] = ()) -> DataFrame:
    """The k most frequent words of each key: of `least` characters at least, not all digits, not in `stop`."""
    words = docs.select(key, F.explode(T.words(F.col("text"))).alias("word"))
    words = words.where((F.length("word") >= least) & ~F.col("word").rlike("^[0-9]+$") & ~F.col("word").isin(*stop))
    counts = words.groupBy(key, "word").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), "word"))
    return counts.withColumn("place", place).where(F.col("place") <= k)


def matrix(docs: DataFrame, terms: Sequence[str], key: str, keys: Sequence[str]) -> DataFrame:
    """Dense (term, key, n): documents of each key that contain each term, 0 where there is none."""
    spark = docs.sparkSession
    cells = spark.createDataFrame([(t, i, k, j) for i, t in enumerate(terms) for j, k in enumerate(keys)], f"term string, t int, {key} string, k int")
    found = F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: F.col("text").contains(t))
    counts = docs.select(key, F.explode(found).alias("term")).groupBy(key, "term").agg(F.count("*").alias("n"))
    return F.broadcast(cells).join(counts, [key, "term"], "left").select("term", "t", key, "k", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def changes(cells: DataFrame, key: str) -> DataFrame:
    """Each term from one key to the next: emergence, disappearance or substitution, with a confidence."""
    over = Window.partitionBy("term").orderBy("k")
    rows = cells.withColumns({"was": F.lag("n").over(over), "from_key": F.lag(key).over(over)}).where(F.col("was").isNotNull())
    kind = F.when((F.col("was") == 0) & (F.col("n") > 0), "emergence").when((F.col("was") > 0) & (F.col("n") == 0), "disappearance").otherwise("substitution")
    return rows.select("term", "from_key", F.col(key).alias("to_key"), "was", "n", kind.alias("change"), F.when(kind == "substitution", "low").otherwise("medium").alias("confidence"))


def trend(cells: DataFrame) -> DataFrame:
    """Counts of each term scaled by its largest, and its direction from the first key to the last."""
    over = Window.partitionBy("term")
    first, last = F.min_by("n", "k").over(over), F.max_by("n", "k").over(over)
    top = F.max("n").over(over)
    way = F.when(last > first, "rising").when(last < first, "falling").otherwise("stable")
    return cells.withColumns({"scaled": F.when(top > 0, F.round(F.col("n") / top, 3)).otherwise(0.0), "direction": way})


def neighbours(paras: DataFrame, hits: DataFrame, window: int, decay: float = 0.9) -> DataFrame:
    """Hits (doc_id, para, score) and the paragraphs around them, each with its best score: score * decay^distance."""
    offsets = F.explode(F.sequence(F.lit(-window), F.lit(window))).alias("offset")
    around = hits.select("doc_id", "para", "score", offsets)
    around = around.select("doc_id", (F.col("para") + F.col("offset")).alias("para"), (F.col("score") * F.pow(F.lit(decay), F.abs("offset"))).alias("score"))
    best = around.groupBy("doc_id", "para").agg(F.round(F.max("score"), 6).alias("score"))
    return paras.join(best, ["doc_id", "para"]).select("doc_id", "para", "score", F.length("paragraph").alias("chars"))


def windows(paras: DataFrame, size: int = 3, overlap: int = 1) -> DataFrame:
    """Sliding windows of paragraphs of each document, step size - overlap; the last may be short."""
    step = size - overlap
    starts = paras.groupBy("doc_id").agg((F.max("para") + 1).alias("n"))
    last = F.greatest(F.col("n") - overlap - 1, F.lit(0))
    starts = starts.select("doc_id", "n", F.explode(F.sequence(F.lit(0), last, F.lit(step))).alias("start"))
    spans = starts.select("doc_id", "start", F.explode(F.sequence(F.col("start"), F.least(F.col("start") + size, F.col("n")) - 1)).alias("para"))
    joined = paras.join(spans, ["doc_id", "para"]).groupBy("doc_id", "start")
    return joined.agg(F.count("*").alias("n_paras"), F.sum(F.length("paragraph")).alias("chars"))


#: Words of 64 bits of the table that strings are tried against (128 KB); more strings only let more through.
TABLE = 1 << 14


def with_ngrams(grams: DataFrame, docs: DataFrame, n: int, *columns: str) -> DataFrame:
    """(columns, gram): for each row of `docs` the distinct n-word strings of its text that are in `grams` (gram), and few others. At
    each place, the hash of the first two words is tried against a table of bits in the row, then that of all n; only hits become
    strings and rows, so a text is cut into words once and no word is shuffled."""
    own = F.split("gram", " ")
    at = lambda *x: F.pmod(F.xxhash64(*x), F.lit(64 * TABLE))
    each = F.explode(F.array(at(*[F.get(own, k) for k in range(min(n, 2))]), at(own))).alias("at")
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("at") % 64).cast("int"))
    bits = grams.select(each).groupBy(F.floor(F.col("at") / 64).cast("int").alias("k")).agg(F.bit_or(bit).alias("w"))
    table = [0] * TABLE
    for r in bits.collect():  # TABLE rows at most
        table[r.k] = r.w
    row = docs.sparkSession.createDataFrame([(table,)], "__bits array<bigint>")
    rows = docs.select(*columns, T.words(F.col("text")).alias("__words")).join(F.broadcast(row))  # one row

    def holds(place: Column) -> Column:
        return F.getbit(F.get("__bits", F.shiftright(place, 6).cast("int")), place.bitwiseAND(63).cast("int")) == 1

    def hit(i: Column) -> Column:
        return holds(at(*[F.get("__words", i - 1 + k) for k in range(min(n, 2))])) & holds(at(F.slice("__words", i, n)))

    places = F.when(F.size("__words") >= n, F.filter(F.sequence(F.lit(1), F.greatest(F.size("__words") - n + 1, F.lit(1))), hit))
    return rows.select(*columns, F.explode(F.array_distinct(F.transform(places, lambda i: F.array_join(F.slice("__words", i, n), " ")))).alias("gram"))


def ngram_hits(grams: DataFrame, docs: DataFrame, n: int, id_col: str) -> DataFrame:
    """(id, gram): the distinct n-word strings of `docs` that are in `grams` (gram), and few others."""
    return with_ngrams(grams, docs, n, id_col).distinct()


def shared_ngrams(left: DataFrame, right: DataFrame, n: int, left_id: str, right_id: str) -> DataFrame:
    """(left_id, right_id, shared): distinct n-word strings that two texts share. The left texts are the smaller table."""
    a = left.select(left_id, F.explode(F.array_distinct(T.word_ngrams(T.words(F.col("text")), n))).alias("gram"))
    return a.join(ngram_hits(a.select("gram"), right, n, right_id), "gram").groupBy(left_id, right_id).agg(F.count("*").alias("shared"))
