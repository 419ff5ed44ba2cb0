"""Exact dedup with a log-structured merge index of text digests, in DataFrame operations only.

* A *memtable* is a slice of the input: its digests are pre-aggregated (one entry per digest: the identifier that stays and
  the number of rows) and flushed as a *run*, a Parquet folder sorted by digest, with a filter of fixed size beside it.
* *Compaction* merges the runs of a level when there are FANOUT of them, and all at the end. An entry whose digest no other
  run's filter holds goes over as it is; only the others are shuffled and merged: one entry per digest, the identifier that
  stays among all runs, the summed row count.
* *Hits*, rows whose digest the compacted index holds more than once, are verified byte by byte: the least and the
  greatest text of a digest are equal only if all its texts are. A digest with unlike texts (a collision) is settled
  again by (digest, text).

What is shuffled: 32-byte digests, and whole texts only of hits (found with a filter of fixed size), after a map-side
combine which leaves one row per digest and task; a group that holds a third of all rows is a handful of rows.

Defined cases
    null text: an empty text.                  null doc_id: never preferred; a group of null ids keeps null.
    repeated rows (same doc_id, same text): each is reported and counts in group_size; kept is true for each row
    that carries the keep_id; `deduplicate` leaves one of them.
    empty table: empty result.                 extra columns: ignored by `find_duplicates`, kept by `deduplicate`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textlake.llm.common import attach, build_filter, own_prefix, probe_filter, scratch, stored

#: Memtables that a table is cut into; runs of a level that are merged into one of the next.
MEMTABLES, FANOUT = 4, 4
_RUN = "digest binary, keep_id bigint, n bigint"


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(F.encode(text, "UTF-8"), 256))


def _hash(digest: Column) -> Column:
    return F.xxhash64(digest)


def _best(keep: str) -> Column:
    return (F.max if keep == "largest" else F.min)("keep_id").alias("keep_id")


class DigestIndex:
    """The index: levels of runs. `keep` is 'smallest' or 'largest' identifier."""

    def __init__(self, spark: SparkSession, path: str | None = None, keep: str = "smallest"):
        if keep not in ("smallest", "largest"):
            raise ValueError("keep is 'smallest' or 'largest'")
        self.spark, self.keep = spark, keep
        self.path = path or scratch(spark, "digest-index")
        self.levels: list[list[str]] = [[]]
        self.made = 0

    def flush(self, rows: DataFrame) -> None:
        """Flush a memtable of (digest, doc_id) rows as a run, and compact the levels that are full."""
        memtable = rows.select("digest", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("n"))
        self.levels[0].append(self._write(self._merged(memtable)))
        for level in range(len(self.levels)):
            if len(self.levels[level]) >= FANOUT:
                self._compact(level)

    def _merged(self, entries: DataFrame) -> DataFrame:
        return entries.groupBy("digest").agg(_best(self.keep), F.sum("n").alias("n"))

    def _write(self, run: DataFrame) -> str:
        path, self.made = f"{self.path}/run-{self.made}", self.made + 1
        run.sortWithinPartitions("digest").write.parquet(f"{path}/entries")
        build_filter(self._run(path), _hash(F.col("digest"))).write.parquet(f"{path}/filter")
        return path

    def _run(self, path: str) -> DataFrame:
        return self.spark.read.schema(_RUN).parquet(f"{path}/entries")

    def _compact(self, level: int) -> None:
        """Merge the runs of a level into one of the next; their filters tell which entries may have partners."""
        runs, self.levels[level] = self.levels[level], []
        parts, alone = [], []
        for k, path in enumerate(runs):
            entries = self._run(path)
            for j, other in enumerate(runs):
                if j != k:
                    entries = probe_filter(entries, _hash(F.col("digest")), self.spark.read.parquet(f"{other}/filter"), f"in_{j}")
            partner = reduce(Column.__or__, [F.col(f"in_{j}") for j in range(len(runs)) if j != k], F.lit(False))
            parts.append(entries.where(partner).select("digest", "keep_id", "n"))
            alone.append(entries.where(~partner).select("digest", "keep_id", "n"))
        merged = reduce(DataFrame.unionByName, [self._merged(reduce(DataFrame.unionByName, parts)), *alone])
        if level + 1 == len(self.levels):
            self.levels.append([])
        self.levels[level + 1].append(self._write(merged))

    def entries(self) -> DataFrame:
        """All entries of all runs; a digest may occur in several."""
        runs = [f"{r}/entries" for level in self.levels for r in level]
        return self.spark.read.schema(_RUN).parquet(*runs) if runs else self.spark.createDataFrame([], _RUN)

    def compact(self) -> DataFrame:
        """Merge all runs into one with a single entry for each digest, and return it."""
        runs = [r for level in self.levels for r in level]
        if len(runs) > 1:
            self.levels = [runs]
            self._compact(0)
        return self.entries()

    def lookup(self, digest: bytes) -> DataFrame:
        """The entries of one digest; row groups are sorted, so few are read."""
        return self.entries().where(F.col("digest") == F.lit(bytearray(digest)))


def _named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))


def find_duplicates(
    docs: DataFrame, keep: str = "largest", id_col: str = "doc_id", text_col: str = "text", digest=sha256
) -> DataFrame:
    """One row per row of `docs`: doc_id, digest, keep_id, group_size, kept."""
    spark, rows = docs.sparkSession, _named(docs, id_col, text_col)
    digests = stored(rows.select("doc_id", digest(F.col("text")).alias("digest")), "digests")
    index = DigestIndex(spark, keep=keep)
    for k in range(MEMTABLES):
        index.flush(digests.where(F.pmod(F.xxhash64("doc_id"), F.lit(MEMTABLES)) == k))
    repeated = index.compact().where("n > 1")

    seen = build_filter(repeated, _hash(F.col("digest")))
    hits = probe_filter(rows.withColumn("digest", digest(F.col("text"))), _hash(F.col("digest")), seen, "hit").where("hit")
    verified = stored(
        hits.groupBy("digest")
        .agg((F.min("text") == F.max("text")).alias("same"), F.count("*").alias("n"))
        .where("n > 1"),
        "verified",
    )
    settled = repeated.join(verified.where("same").select("digest"), "digest", "left_semi")
    collided = verified.where(~F.col("same")).select("digest")

    flagged = probe_filter(digests, _hash(F.col("digest")), seen, "hit")
    alone = flagged.where(~F.col("hit")).select(
        "doc_id", "digest", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size")
    )
    found = attach(
        flagged.where("hit").drop("hit"), settled.select("digest", "keep_id", F.col("n").alias("group_size"), "n"), "digest", "n"
    )
    if collided.isEmpty():
        parts = alone.unionByName(_alone_if_missing(found))
    else:  # unlike texts under one digest: settle them by their bytes
        clash = build_filter(collided, _hash(F.col("digest")))
        unlike = probe_filter(hits, _hash(F.col("digest")), clash, "unlike").where("unlike").drop("unlike")
        groups = (
            unlike.withColumnRenamed("doc_id", "keep_id").groupBy("digest", "text").agg(_best(keep), F.count("*").alias("group_size"))
        )
        # Texts of a digest are told apart by a second one, so that what is joined with rows is small and no key is one task's.
        second = F.struct("digest", F.sha2(F.reverse("text"), 512).alias("second"))
        groups = stored(groups.select(second.alias("both"), "keep_id", "group_size", F.col("group_size").alias("n")), "collisions")
        exact = attach(unlike.select("doc_id", "digest", second.alias("both")), groups, "both", "n")
        clashing = collided.select("digest", F.lit(True).alias("clashing"), F.lit(1).alias("n"))
        exact = attach(exact, clashing, "digest", "n").where("clashing").select("doc_id", "digest", "keep_id", "group_size")
        found = attach(found, clashing, "digest", "n").where("clashing is null").drop("clashing")
        parts = alone.unionByName(_alone_if_missing(found)).unionByName(exact)
    return parts.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))


def _alone_if_missing(found: DataFrame) -> DataFrame:
    """Rows that only the filter took for hits are groups of one."""
    return found.select(
        "doc_id",
        "digest",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("bigint")).alias("group_size"),
    )


def deduplicate(docs: DataFrame, keep: str = "smallest", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs`, all columns, with one row for each text. Only rows that may be dropped are moved, keyed by id and digest."""
    p = own_prefix(docs)
    marks = find_duplicates(docs, keep, id_col, text_col).where("group_size > 1")
    fate = marks.groupBy(F.struct("doc_id", "digest").alias(p + "key")).agg(F.first("kept").alias(p + "kept"), F.count("*").alias(p + "n"))
    fate = stored(fate.where(f"not {p}kept or {p}n > 1"), "fates")  # rows that go, and rows that are there several times
    hashed = F.xxhash64(F.col(p + "key.doc_id"), F.col(p + "key.digest"))
    tagged = docs.withColumn(p + "key", F.struct(F.col(id_col).alias("doc_id"), sha256(F.coalesce(F.col(text_col), F.lit(""))).alias("digest")))
    tagged = probe_filter(tagged, hashed, build_filter(fate, hashed), p + "hit")
    alone = tagged.where(f"not {p}hit").select(*docs.columns)
    met = attach(tagged.where(p + "hit").drop(p + "hit"), fate, p + "key", p + "n")
    single = met.where(f"{p}kept is null").select(*docs.columns)
    once = met.where(p + "kept").dropDuplicates([p + "key"]).select(*docs.columns)
    return alone.unionByName(single).unionByName(once)
