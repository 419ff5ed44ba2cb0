"""Sources and sinks: text, JSON lines, CSV, snapshots, versions, annotation exports. All paths are Spark's to read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textlake.functions.text import html_escape, strip


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder where all executors can read and write: below spark.checkpoint.dir, which only a session on one machine (tests)
    may leave unset."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="textlake-")
        spark.sparkContext.setCheckpointDir(at)
    return f"{at.rstrip('/')}/files/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it back, which cuts its lineage: a lost executor loses nothing."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# --- sources -------------------------------------------------------------------------------------------------------


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole text files."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def read_chapters(texts: DataFrame, heading: str = r"(?m)^\s*([一二三四五六七八九十]+)\s*[、，,.\s]\s*(.+)$") -> DataFrame:
    """(path, number, title, content) of each chapter; a text without headings is one chapter."""
    found = F.regexp_extract_all("text", F.lit(heading), F.lit(0))
    parts = F.split("text", heading)
    rows = F.transform(found, lambda h, i: F.struct(h.alias("heading"), strip(F.element_at(parts, i + 2)).alias("content")))
    whole = F.array(F.struct(F.lit("").alias("heading"), strip(F.col("text")).alias("content")))
    each = texts.select("path", F.posexplode(F.when(F.size(found) > 0, rows).otherwise(whole)).alias("seq", "c"))
    return each.select(
        "path",
        (F.col("seq") + 1).alias("chapter"),
        F.regexp_extract("c.heading", heading, 1).alias("number"),
        F.when(F.col("c.heading") == "", "全文").otherwise(F.regexp_extract("c.heading", heading, 2)).alias("title"),
        F.col("c.content").alias("content"),
    )


def read_json_lines(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """Rows with a key; blank and broken lines are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path).where(F.col(key).isNotNull())


def read_sheet(spark: SparkSession, path: str, numbers: tuple[str, ...] = (), cut: int = 300) -> DataFrame:
    """A CSV sheet: numbers that can't be read are 0, other cells are cut; empty rows go."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    filled = rows.na.drop("all")
    return filled.select(*[(F.coalesce(F.try_to_number(F.trim(c), F.lit("999999999")), F.lit(0)).cast("bigint") if c in numbers else F.substring(F.coalesce(c, F.lit("")), 1, cut)).alias(c) for c in rows.columns])


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The JSON that follows the first brace of each log line."""
    lines = spark.read.text(path).where(F.col("value").contains("{"))
    parsed = lines.select(F.from_json(F.expr("substr(value, instr(value, '{'))"), schema).alias("r"))
    return parsed.where("r is not null").select("r.*")


# --- sinks ---------------------------------------------------------------------------------------------------------


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def write_version(df: DataFrame, folder: str, version: int) -> str:
    """A snapshot beside the others; readers pick one."""
    path = f"{folder}/version={version}"
    df.write.mode("errorifexists").parquet(path)
    return path


def read_version(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """A version, the latest if none is named."""
    rows = spark.read.parquet(folder)
    at = version if version is not None else rows.agg(F.max("version")).first()[0]
    return rows.where(F.col("version") == at).drop("version")


def append_changes(changes: DataFrame, path: str, batch: int) -> None:
    """An audit log: batches are appended and numbered by the caller, so a repeated batch can be told."""
    changes.withColumn("batch_id", F.lit(batch)).write.mode("append").parquet(path)


def current(rows: DataFrame, key: str, order: Column) -> DataFrame:
    """The latest row of each key in a log of versions."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return rows.withColumn("__place", place).where("__place = 1").drop("__place")


def csv_cell(c: Column) -> Column:
    """RFC 4180."""
    text = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(text.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def csv_lines(df: DataFrame) -> DataFrame:
    return df.select(F.concat_ws(",", *[csv_cell(F.col(c)) for c in df.columns]).alias("line"))


def stand_off_xml(annotations: DataFrame, key: str) -> DataFrame:
    """(key, xml): a list of spans for each text, in order of place."""
    item = F.format_string('<span from="%d" to="%d" type="%s">%s</span>', "start_char", "end_char", html_escape(F.col("category")), html_escape(F.col("label")))
    rows = annotations.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("start_char", "end_char", item.alias("x")))).alias("items"))
    return rows.select(key, F.concat(F.lit("<spanGrp>"), F.array_join(F.transform("items", lambda i: i["x"]), ""), F.lit("</spanGrp>")).alias("xml"))
