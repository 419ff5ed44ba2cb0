"""Quote verification, exact duplicates, coverage, change data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlake.functions import text as T
from textlake.operators.corpus import with_ngrams
from textlake.operators.postings import Index


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(first_id, copies) of each text that occurs more than once; the digest is what is shuffled."""
    return docs.groupBy(F.sha2(text_col, 256).alias("digest")).agg(F.min(id_col).alias("first_id"), F.count("*").alias("copies")).where("copies > 1").drop("digest")


def verify_quotes(quotes: DataFrame, docs: DataFrame, anchor: int = 8, quote_id: str = "item_id", index: Index | None = None) -> DataFrame:
    """For each quote of `anchor` words or more: in how many documents it stands word for word, and the first of these.

    Candidates are the documents that share the quote's first `anchor` words, which one pass over the texts finds, or else those that have its
    rarest words in a stored `index`, if there is one already; they are compared word for word then.
    """
    own = quotes.select(quote_id, T.words(F.col("text")).alias("words")).where(F.size("words") >= anchor)
    asked = own.select(F.col(quote_id).alias("query_id"), F.explode("words").alias("token"))
    own = own.select(quote_id, F.array_join("words", " ").alias("quote"), F.array_join(F.slice("words", 1, anchor), " ").alias("gram"))
    candidates = None if index is None else index.with_all(asked)
    if candidates is None:
        met = with_ngrams(own.select("gram"), docs, anchor, "doc_id", "text").join(own, "gram")
    else:
        candidates = candidates.distinct().withColumnRenamed("query_id", quote_id).join(own, quote_id).select("doc_id", quote_id, "quote")
        met = candidates.join(docs.select("doc_id", "text"), "doc_id")
    line = F.concat(F.lit(" "), F.array_join(T.words(F.col("text")), " "), F.lit(" "))
    met = met.where(line.contains(F.concat(F.lit(" "), "quote", F.lit(" "))))
    found = met.groupBy(quote_id).agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"))
    return own.select(quote_id).join(found, quote_id, "left").select(quote_id, F.coalesce("n_docs", F.lit(0)).cast("bigint").alias("n_docs"), "first_doc", F.col("n_docs").isNotNull().alias("verified"))


def coverage(units: DataFrame, marked: DataFrame, unit: str, key: str) -> DataFrame:
    """Share of the units of each key that `marked` holds, and a grade."""
    rows = units.join(marked.select(unit).distinct().withColumn("__marked", F.lit(1)), unit, "left")
    rate = F.round(F.count("__marked") / F.count("*"), 3)
    out = rows.groupBy(key).agg(F.count("*").alias("units"), F.count("__marked").alias("covered"), rate.alias("rate"))
    return out.withColumn("grade", grade(F.col("rate")))


def grade(rate: Column) -> Column:
    return F.when(rate >= 0.9, "excellent").when(rate >= 0.75, "good").when(rate >= 0.5, "fair").otherwise("poor")


def changed(old: DataFrame, new: DataFrame, key: str, content: str) -> DataFrame:
    """(key, change): rows added, removed or with other content, by digest."""
    a = old.select(key, F.sha2(content, 256).alias("was"))
    b = new.select(key, F.sha2(content, 256).alias("now"))
    kind = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").otherwise("changed")
    return a.join(b, key, "full_outer").where(~F.col("was").eqNullSafe(F.col("now"))).select(key, kind.alias("change"))
