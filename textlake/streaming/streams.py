"""Streams over the event log and conversations: windows with watermarks, sessions. Keyed state is in `keyed`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlake.sources.files import shared_folder


def stream(spark: SparkSession, folder: str, table: str, files_per_trigger: int = 8) -> DataFrame:
    """A stream of the Parquet files of a table, which may be one file or a folder of them."""
    schema = spark.read.parquet(f"{folder}/{table}.parquet").schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("recursiveFileLookup", True)
    return reader.option("pathGlobFilter", "*.parquet").option("basePath", folder).parquet(f"{folder}/{table}.parquet")


def tumbling(events: DataFrame, width: str, late: str) -> DataFrame:
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    rows = rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total"))
    return rows.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, late: str) -> DataFrame:
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    rows = rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return rows.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("until"), "n")


def run(rows: DataFrame, mode: str) -> DataFrame:
    """Run a stream over all there is now and give its result as a table in the shared folder.

    Append mode writes files; complete mode replaces the table with each batch.
    """
    spark, folder = rows.sparkSession, shared_folder(rows.sparkSession)
    writer = rows.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", f"{folder}/out").start()
    else:
        query = writer.foreachBatch(lambda batch, number: batch.write.mode("overwrite").parquet(f"{folder}/out")).start()
    query.awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{folder}/out")
