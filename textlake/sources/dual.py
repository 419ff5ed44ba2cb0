"""A table and what is derived from it, written one after the other and never left half done.

A batch (a number that the caller, or `foreachBatch`, gives) is written in steps, each a version of a commit log: `begun`, with the first
id that its rows get; `primary`, once its rows are in the source of truth; `done`, once its derived rows are there too. Each
step writes a folder of its own batch, so that repeating it replaces what a lost attempt left. A batch that is done is skipped.
Readers see the primary rows of batches that have them, and derived rows of batches that are done; `replay` derives what is
pending, `rebuild` derives everything anew and switches to it in one commit.

Ids are monotone and without gaps: a batch begins where the one before it ended, and a repeated batch gets the ids it had.

Defined cases
    an empty batch: entered in the log without rows.     a batch number again: nothing happens, whatever the rows.
    a failure at any place: the same batch again, or `replay`, completes it.   one writer at a time: a second one fails at the log.
    columns named as the id: refused.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textlake.sources.files import read_version, stored, write_version

_LOG = "batch bigint, state string, first_id bigint, n bigint, derived string"


class DualTable:
    """Tables below a shared `folder`; `derive` makes the derived rows from primary ones (with `id_col`)."""

    def __init__(self, spark: SparkSession, folder: str, derive: Callable[[DataFrame], DataFrame], id_col: str = "id"):
        self.spark, self.folder, self.derive, self.id_col = spark, folder.rstrip("/"), derive, id_col

    # --- the log: a row per batch ---

    def log(self) -> DataFrame:
        try:
            return read_version(self.spark, f"{self.folder}/log")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], _LOG)

    def _enter(self, changed: DataFrame) -> None:
        """One more version of the log: `changed` rows (as in the log) in place of those of the same batches."""
        now = self.log()
        version = 0
        if (at := self._version()) is not None:
            version = at + 1
        rows = now.join(changed.select("batch"), "batch", "left_anti").select(*changed.columns).unionByName(changed)
        write_version(rows.coalesce(1), f"{self.folder}/log", version)

    def _version(self) -> int | None:
        try:
            return self.spark.read.parquet(f"{self.folder}/log").agg(F.max("version")).first()[0]
        except AnalysisException:
            return None

    def _entry(self, batch: int):
        return self.log().where(F.col("batch") == batch).first()

    def _mark(self, batch: int, state: str, first_id: int, n: int, derived: str | None) -> None:
        self._enter(self.spark.createDataFrame([(batch, state, first_id, n, derived)], _LOG))

    # --- writing ---

    def write(self, rows: DataFrame, batch: int, order: Column | None = None, step: Callable[[str], None] = lambda _: None) -> None:
        """Write a batch. `order` numbers its rows; `step` is told what has just been done (tests fail there)."""
        if self.id_col in rows.columns:
            raise ValueError(f"a column {self.id_col} is there already")
        entry = self._entry(batch)
        if entry is not None and entry.state == "done":
            return
        if entry is None or entry.state == "begun":
            ordered = rows if order is None else rows.repartitionByRange(order).sortWithinPartitions(order)
            held = stored(ordered.withColumn("__at", F.monotonically_increasing_id()))  # the partition and the place in it
            part = F.shiftright("__at", 33)
            sizes = held.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()  # a row per partition
            n, offsets = 0, {}
            for r in sizes:
                offsets[r.part], n = n, n + r.n
            first = entry.first_id if entry is not None else self._next()
            if entry is None:
                self._mark(batch, "begun", first, n, None)
                step("begun")
            table = self.spark.createDataFrame(sorted(offsets.items()) or [(0, 0)], "__part bigint, __offset bigint")
            numbered = held.join(F.broadcast(table), part == F.col("__part"))  # a row per partition
            place = F.col("__offset") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + first
            numbered.select(place.alias(self.id_col), *rows.columns).write.mode("overwrite").parquet(f"{self.folder}/primary/batch={batch}")
            step("primary written")
            self._mark(batch, "primary", first, n, None)
            step("primary")
        self._derive(batch, step)

    def _next(self) -> int:
        return self.log().agg(F.coalesce(F.max(F.col("first_id") + F.col("n")), F.lit(0))).first()[0]

    def _derive(self, batch: int, step: Callable[[str], None] = lambda _: None) -> None:
        entry = self._entry(batch)
        own = f"derived/{uuid.uuid4().hex}/batch={batch}"
        if entry.n:
            self.derive(self.spark.read.parquet(f"{self.folder}/primary/batch={batch}")).write.parquet(f"{self.folder}/{own}")
        step("derived written")
        self._mark(batch, "done", entry.first_id, entry.n, own)
        step("done")

    def replay(self) -> int:
        """Derive the rows of batches that have none; how many there were. A batch that has only begun needs its rows again."""
        pending = [r.batch for r in self.log().where("state = 'primary'").orderBy("batch").collect()]
        for batch in pending:
            self._derive(batch)
        return len(pending)

    def rebuild(self) -> None:
        """All derived rows anew from the source of truth; readers see the old ones until the last commit."""
        entries = self.log().where("state <> 'begun'").collect()
        made, fresh = [], uuid.uuid4().hex
        for e in entries:
            own = f"derived/{fresh}/batch={e.batch}"
            if e.n:
                self.derive(self.spark.read.parquet(f"{self.folder}/primary/batch={e.batch}")).write.parquet(f"{self.folder}/{own}")
            made.append((e.batch, "done", e.first_id, e.n, own))
        if made:
            self._enter(self.spark.createDataFrame(made, _LOG))

    # --- reading ---

    def primary(self) -> DataFrame | None:
        """The source of truth; None before the first batch with rows."""
        return self._read([f"primary/batch={r.batch}" for r in self.log().where("state <> 'begun' and n > 0").collect()])

    def derived(self) -> DataFrame | None:
        return self._read([r.derived for r in self.log().where("state = 'done' and n > 0").collect()])

    def _read(self, paths: list[str]) -> DataFrame | None:
        return self.spark.read.parquet(*[f"{self.folder}/{p}" for p in paths]) if paths else None
