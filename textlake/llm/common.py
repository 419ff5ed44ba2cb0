"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys handed to `attach` as heavy: after these, no key holds more than 1/HEAVY of the rows.
HEAVY = 1024


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Only a session on one machine (tests) may leave it unset."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not at:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="textlake-")
        sc.setCheckpointDir(at)
    return at.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, in a folder of the application's own: once its results are written, that one can go."""
    return f"{shared_dir(spark)}/textlake-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}/{name}"


def own_prefix(*tables: DataFrame) -> str:
    """The shortest run of underscores, two at least, that no column of `tables` begins with: names of helper columns."""
    names, prefix = [c for t in tables for c in t.columns], "__"
    while any(n.startswith(prefix) for n in names):
        prefix += "_"
    return prefix


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it back, which cuts its lineage.

    A lost executor loses nothing: later stages reread the files.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release() -> None:
    """What this Python worker has freed goes back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def releasing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """`run` for `mapInArrow`; at a task's end, what it has freed goes back to the system. Spark keeps Python workers for
    later tasks, and an idle one would hold that memory beside the executor's own."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def attach(left: DataFrame, right: DataFrame, key: str, weight: str) -> DataFrame:
    """Left equi-join of `left` with `right` (one row per key) where some keys may hold a large part of `left`.

    `weight` is a column of `right` that says how many rows of `left` a key has; it is dropped. The HEAVY heaviest keys
    are broadcast (a bound by construction: HEAVY rows), and their rows are spread by their other columns in the shuffled
    join that follows, where no other key has more than 1/HEAVY of all rows. Null keys match nothing.
    """
    values, p = [c for c in right.columns if c not in (key, weight)], own_prefix(left, right)
    at, heavy_at, spread_at, rest_at, none_at = (p + n for n in ("key", "heavy", "spread", "rest", "none"))
    right = right.where(F.col(key).isNotNull())
    heavy = right.orderBy(F.desc(weight), key).limit(HEAVY)
    heavy = heavy.select(F.col(key).alias(at), F.struct(F.lit(True), *values).alias(heavy_at))
    rows = left.join(F.broadcast(heavy), F.col(key) == F.col(at), "left").drop(at)
    spread = F.when(F.col(heavy_at).isNotNull() | F.col(key).isNull(), F.xxhash64(*left.columns)).otherwise(F.lit(0))
    rows = rows.withColumn(spread_at, spread)
    rest = right.select(F.col(key).alias(at), F.struct(F.lit(True), *values).alias(rest_at), F.lit(0).cast("bigint").alias(none_at))
    rows = rows.join(rest, (F.col(key) == F.col(at)) & (F.col(spread_at) == F.col(none_at)), "left")
    found = F.coalesce(heavy_at, rest_at)
    return rows.select(*left.columns, *[found[c].alias(c) for c in values])


# --- a filter of fixed size over 64-bit hashes ---------------------------------------------------------------------
# One bit per key, in rows of 32,768 bits (4 KB), built with Spark's bitmap functions. FILTER_BITS bounds the whole
# filter (4 MB), whatever the number of keys: more keys only let more rows through.

FILTER_BITS = 1 << 25


def _position(hash64: Column, bits: int) -> Column:
    return F.pmod(hash64, F.lit(bits))


def build_filter(keys: DataFrame, hash64: Column, bits: int = FILTER_BITS) -> DataFrame:
    """Rows (bucket, bitmap), at most bits / 32,768 of them, with a bit set for each key."""
    at = _position(hash64, bits)
    return keys.groupBy(F.bitmap_bucket_number(at).alias("__bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("__bitmap")
    )


def probe_filter(rows: DataFrame, hash64: Column, filter_rows: DataFrame, flag: str, bits: int = FILTER_BITS) -> DataFrame:
    """`rows` with a boolean `flag`: False only if the key is certainly not in the filter."""
    p = own_prefix(rows, filter_rows)
    table = filter_rows.select(F.col("__bucket").alias(p + "b"), F.col("__bitmap").alias(p + "m"))
    at = _position(hash64, bits)
    bit = F.bitmap_bit_position(at)
    byte = F.conv(F.hex(F.substring(p + "m", F.floor(F.col(p + "bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.expr(f"shiftright({p}byte, cast({p}bit % 8 as int)) & 1") == 1
    return (
        rows.withColumns({p + "bucket": F.bitmap_bucket_number(at), p + "bit": bit})
        .join(F.broadcast(table), F.col(p + "bucket") == F.col(p + "b"), "left")
        .withColumn(p + "byte", byte)
        .withColumn(flag, F.coalesce(hit, F.lit(False)))
        .select(*rows.columns, flag)
    )
