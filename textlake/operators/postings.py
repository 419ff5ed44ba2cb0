"""A stored inverted index: term-partitioned blocks of postings on disk, in segments that are appended and merged.

A segment has two tables. `documents`: __ordinal, the id columns, other kept columns, __length, and __terms (each distinct token
with its count). `postings`, partitioned by `part` (a hash of the token) and sorted by token: one row per token and block of
BLOCK ordinals with the first ordinal, the others as differences to it, their counts and lengths, and the block's maxima (greatest
count, least length). So a query reads the rows of its own tokens only (partition and row-group skipping), a row never
outgrows a block however frequent its token is, and headers alone bound what a block can score.

A segment counts once it is in the log, a versioned table: a writer that fails leaves files that no reader looks at, and a
merge is seen whole or not at all.

Defined cases
    null text: no tokens, counted as a document of length 0.     empty table: an index without documents, every search empty.
    repeated ids: each row is a document.      null tokens: left out.     a token that no document has: adds nothing.
    a query whose tokens nobody has: no rows.    equal scores: by id.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textlake.functions import scoring as S
from textlake.functions.text import bind
from textlake.sources.files import read_version, write_version

#: Ordinals of a block; documents for which an index has one more part, up to PARTS; query tokens that are pushed down to the scan
#: as a list at most; blocks whose best documents set a query's threshold.
BLOCK, PER_PART, PARTS, LISTED, SEEDS = 4096, 200_000, 256, 10_000, 4
_LOG = "segment string, parts int, docs bigint, total bigint"


def counted(tokens: Column) -> Column:
    """array<struct<token, tf>>: the distinct tokens of an array with their counts, by sorting and cutting into runs."""

    def runs(t: Column) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.size(t), F.lit(1)))
        starts = F.filter(places, lambda i: (i == 1) | (F.get(t, i - 1) != F.get(t, i - 2)))
        end = lambda s, k: F.coalesce(F.get(s, k + 1), F.size(t) + 1)
        return bind(starts, lambda s: F.transform(s, lambda i, k: F.struct(F.get(t, i - 1).alias("token"), (end(s, k) - i).alias("tf"))))

    own = F.sort_array(F.filter(F.coalesce(tokens, F.array().cast("array<string>")), lambda x: x.isNotNull()))
    return bind(own, lambda t: F.when(F.size(t) > 0, runs(t)).otherwise(F.array().cast("array<struct<token:string,tf:int>>")))


def _part(token: Column, parts: Column) -> Column:
    return F.pmod(F.xxhash64(token), parts).cast("int")


class Index:
    """The index in a folder that all executors share; `ids` name a document."""

    def __init__(self, spark: SparkSession, path: str, ids: Sequence[str]):
        self.spark, self.path, self.ids = spark, path.rstrip("/"), list(ids)

    # --- log of segments ---

    def log(self) -> DataFrame:
        try:
            return read_version(self.spark, f"{self.path}/log")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            return self.spark.createDataFrame([], _LOG)

    def _segments(self) -> list:
        return self.log().collect()  # a row per segment

    def _commit(self, segments: list[tuple], at: int) -> None:
        write_version(self.spark.createDataFrame(segments, _LOG).coalesce(1), f"{self.path}/log", at)

    def _version(self) -> int:
        try:
            return self.spark.read.parquet(f"{self.path}/log").agg(F.max("version")).first()[0]
        except AnalysisException:
            return 0

    # --- writing ---

    def append(self, docs: DataFrame, tokens: Column, keep: Sequence[str] = ()) -> None:
        """Index `docs` as a segment of its own. `tokens`: an array of strings; `keep`: columns for filters and results."""
        live, segment = self._segments(), uuid.uuid4().hex
        rows = docs.select(*self.ids, *keep, tokens.alias("__tokens"))
        rows = rows.select(*self.ids, *keep, F.coalesce(F.size(F.filter("__tokens", lambda x: x.isNotNull())), F.lit(0)).alias("__length"), counted(F.col("__tokens")).alias("__terms"))
        rows.withColumn("__ordinal", F.monotonically_increasing_id()).write.parquet(f"{self.path}/segment={segment}/documents")
        self._finish(segment, [tuple(s) for s in live])

    def _finish(self, segment: str, others: list[tuple]) -> None:
        """Write the postings of a segment whose documents are there, and enter it in the log beside `others`."""
        docs = self.spark.read.parquet(f"{self.path}/segment={segment}/documents")
        n, total = docs.agg(F.count("*"), F.coalesce(F.sum("__length"), F.lit(0)).cast("bigint")).first()
        parts = max(1, min(PARTS, n // PER_PART))
        rows = docs.select(F.col("__ordinal").alias("ordinal"), F.col("__length").alias("length"), F.explode("__terms").alias("t")).select(_part(F.col("t.token"), F.lit(parts)).alias("part"), F.col("t.token").alias("token"), "ordinal", "length", F.col("t.tf").alias("tf"))
        rows = rows.withColumn("block", F.floor(F.col("ordinal") / BLOCK).cast("bigint")).repartition("part", "block")
        entry = F.struct("ordinal", "tf", "length")
        blocks = rows.groupBy("part", "token", "block").agg(F.sort_array(F.collect_list(entry)).alias("ps"))  # BLOCK entries at most
        blocks = blocks.select(
            "part", "token", "block", F.size("ps").alias("n"), F.element_at("ps", 1)["ordinal"].alias("first"),
            F.transform("ps", lambda p: (p["ordinal"] - F.element_at("ps", 1)["ordinal"]).cast("int")).alias("deltas"),
            F.transform("ps", lambda p: p["tf"]).alias("tfs"), F.transform("ps", lambda p: p["length"]).alias("lengths"),
            F.array_max(F.transform("ps", lambda p: p["tf"])).alias("most"), F.array_min(F.transform("ps", lambda p: p["length"])).alias("least"),
        )
        blocks.sortWithinPartitions("part", "token", "block").write.partitionBy("part").parquet(f"{self.path}/segment={segment}/postings")
        self._commit([*others, (segment, parts, n, total)], self._version() + 1)

    def merge(self) -> None:
        """All segments as one, with full blocks; the old files stay for readers that have begun."""
        live = self._segments()
        if len(live) < 2:
            return
        docs = None
        for s in live:
            own = self.spark.read.parquet(f"{self.path}/segment={s.segment}/documents").drop("__ordinal")
            docs = own if docs is None else docs.unionByName(own, allowMissingColumns=True)
        segment, n = uuid.uuid4().hex, sum(s.docs for s in live)
        docs = docs.coalesce(max(1, -(-n // PER_PART)))  # blocks do not go beyond a partition
        docs.withColumn("__ordinal", F.monotonically_increasing_id()).write.parquet(f"{self.path}/segment={segment}/documents")
        self._finish(segment, [])

    # --- reading ---

    def documents(self, *columns: str) -> DataFrame:
        """(__segment, __ordinal, ids and `columns`) of all documents."""
        rows = None
        for s in self._segments():
            own = self.spark.read.parquet(f"{self.path}/segment={s.segment}/documents").withColumn("__segment", F.lit(s.segment))
            own = own.select("__segment", "__ordinal", *self.ids, *[c if c in own.columns else F.lit(None).alias(c) for c in columns])
            rows = own if rows is None else rows.unionByName(own)
        return rows

    def statistics(self) -> tuple[int, float]:
        """Documents and their mean length."""
        n, total = self.log().agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
        return n, total / max(n, 1)

    def blocks(self, tokens: DataFrame) -> DataFrame:
        """(segment, token, block, n, first, deltas, tfs, lengths, most, least) of the blocks of `tokens` (token)."""
        wanted = tokens.select("token").where("token is not null").distinct()
        some = [r.token for r in wanted.limit(LISTED + 1).collect()]
        out = None
        for s in self._segments():
            rows = self.spark.read.parquet(f"{self.path}/segment={s.segment}/postings") if s.docs else None
            if rows is None or "token" not in rows.columns:
                continue
            if len(some) <= LISTED:  # partitions and row groups without them are skipped
                parts = wanted.sparkSession.createDataFrame([(t,) for t in some], "token string").select(_part(F.col("token"), F.lit(s.parts)).alias("p")).distinct()
                rows = rows.where(F.col("part").isin([r.p for r in parts.collect()]) & F.col("token").isin(some)) if s.parts > 1 else rows.where(F.col("token").isin(some))
            else:
                rows = rows.join(wanted, "token", "left_semi")
            rows = rows.withColumn("segment", F.lit(s.segment)).drop("part")
            out = rows if out is None else out.unionByName(rows)
        return out

    def bm25(self, queries: DataFrame, k1: float = 1.5, b: float = 0.75, k: int | None = None, where: Column | None = None, columns: Sequence[str] = (), digits: int | None = None) -> DataFrame:
        """(query_id, ids, score) of all documents with a positive score for queries (query_id, token, weight); with `k`, the best k of
        each with their rank. `where` is a condition on `columns`, which were kept; frequencies and lengths cover all documents.
        With `digits`, scores are rounded before they are ranked."""
        asked = queries.groupBy("query_id", "token").agg((F.count("*") * F.max("weight")).alias("weight"))
        found = self.blocks(asked)
        if found is None:
            kinds = ", ".join(f"{c} string" for c in self.ids)
            return self.spark.createDataFrame([], f"query_id string, {kinds}, score double" + ", rank int" * (k is not None))
        n, average = self.statistics()
        heads = found.select("segment", "token", "block", "n", "most", "least")
        df = heads.groupBy("token").agg(F.sum("n").alias("df"))  # from headers, as counts cover all documents
        asked = asked.join(df, "token").select("query_id", "token", (S.bm25_idf(F.lit(n), F.col("df")) * F.col("weight")).alias("idf"))
        part = lambda tf, length: F.col("idf") * S.bm25_tf(tf, length, F.lit(average), k1, b)
        docs = self.documents(*columns)
        allowed = docs if where is None else docs.where(where)

        def scored(rows: DataFrame) -> DataFrame:
            each = rows.select("query_id", "segment", "first", "idf", F.explode(F.arrays_zip("deltas", "tfs", "lengths")).alias("p"))
            each = each.select("query_id", F.col("segment").alias("__segment"), (F.col("first") + F.col("p.deltas")).alias("__ordinal"), part(F.col("p.tfs"), F.col("p.lengths")).alias("part"))
            sums = each.groupBy("query_id", "__segment", "__ordinal").agg((F.sum("part") if digits is None else F.round(F.sum("part"), digits)).alias("score")).where("score > 0")
            return sums.join(allowed, ["__segment", "__ordinal"]).select("query_id", *self.ids, "score")

        rows = found.join(asked, "token")
        if k is None:
            return scored(rows)
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), *self.ids)
        bound = heads.join(asked, "token").groupBy("query_id", "segment", "block").agg((F.sum(part(F.col("most"), F.col("least"))) * (1 + 1e-9)).alias("bound"))
        if bound.count() <= SEEDS:
            chosen = rows  # as few blocks as the seeds would be
        else:
            seed = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bound"), "segment", "block"))
            first = bound.withColumn("seed", seed).where(F.col("seed") <= SEEDS).select("query_id", "segment", "block")
            least = scored(rows.join(first, ["query_id", "segment", "block"])).withColumn("rank", F.row_number().over(best))
            least = least.where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
            open_ = bound.join(least, "query_id", "left").where(F.col("bound") + (0.0 if digits is None else 10.0**-digits) >= F.coalesce("least", F.lit(0.0))).select("query_id", "segment", "block")
            chosen = rows.join(open_, ["query_id", "segment", "block"])
        return scored(chosen).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    def frequencies(self, tokens: DataFrame | None = None) -> DataFrame | None:
        """(token, df) from block headers, of `tokens` (token) or of all."""
        if tokens is not None:
            found = self.blocks(tokens)
            return None if found is None else found.groupBy("token").agg(F.sum("n").alias("df"))
        rows = None
        for s in self._segments():
            if s.docs and s.total:
                own = self.spark.read.parquet(f"{self.path}/segment={s.segment}/postings").select("token", "n")
                rows = own if rows is None else rows.unionByName(own)
        return None if rows is None else rows.groupBy("token").agg(F.sum("n").alias("df"))

    def with_all(self, wanted: DataFrame, rarest: int = 4) -> DataFrame | None:
        """(query_id, ids): candidates for the documents that have all tokens of a query (query_id, token): those with its `rarest` ones.
        None for an index without postings."""
        asked = wanted.where("token is not null").distinct()
        found = self.blocks(asked)
        if found is None:
            return None
        df = found.select("token", "n").groupBy("token").agg(F.sum("n").alias("df"))
        place = F.row_number().over(Window.partitionBy("query_id").orderBy("df", "token"))
        ranked = asked.join(df, "token", "left").withColumn("df", F.coalesce("df", F.lit(0))).withColumn("place", place).where(F.col("place") <= rarest)
        need = ranked.groupBy("query_id").agg(F.count("*").alias("need"), F.min("df").alias("least")).where("least > 0").select("query_id", "need")
        rows = found.join(ranked.select("query_id", "token"), "token").select("query_id", F.col("segment").alias("__segment"), "first", F.explode("deltas").alias("d"))
        rows = rows.groupBy("query_id", "__segment", (F.col("first") + F.col("d")).alias("__ordinal")).agg(F.count("*").alias("n"))
        rows = rows.join(need, "query_id").where("n = need")
        return rows.join(self.documents(), ["__segment", "__ordinal"]).select("query_id", *self.ids)

    def terms(self) -> DataFrame:
        """(ids, token, tf) of all documents, from the forward table."""
        rows = None
        for s in self._segments():
            own = self.spark.read.parquet(f"{self.path}/segment={s.segment}/documents").select(*self.ids, F.explode("__terms").alias("t")).select(*self.ids, "t.token", "t.tf")
            rows = own if rows is None else rows.unionByName(own)
        return rows

    def matched(self, tokens: DataFrame, *columns: str) -> DataFrame:
        """(ids, columns, matched): how many of `tokens` (token) each document has, if any."""
        found = self.blocks(tokens)
        if found is None:
            return self.documents(*columns).limit(0).drop("__segment", "__ordinal").withColumn("matched", F.lit(0).cast("bigint"))
        each = found.select(F.col("segment").alias("__segment"), "first", F.explode("deltas").alias("d")).groupBy("__segment", (F.col("first") + F.col("d")).alias("__ordinal")).agg(F.count("*").alias("matched"))
        return each.join(self.documents(*columns), ["__segment", "__ordinal"]).drop("__segment", "__ordinal")
