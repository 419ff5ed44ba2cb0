"""URL filters by hashed host-suffix and path-prefix expressions, in DataFrame operations only.

Each URL expands into expressions `host suffix + path prefix`; their four-byte hash prefixes meet the rules' in an
equi-join, full SHA-256 digests confirm, and of the rules that fit the longest wins (at equal length a block rule, then
the greater rule string). Only the suffix lengths (in labels) and prefix lengths (in characters) that some rule has are
expanded, which finds exactly the rules that fit and bounds a URL's expressions by the number of those lengths, whatever
the length of its host or path.

Defined cases
    null url, or none with `://`: host and path are empty, and no rule fits.     empty table: empty result.
    repeated rows: each is judged.      null or repeated rules: null rules never fit; repeated ones count once.
    extra columns: dropped by `judge`; `filter_pages` keeps them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textlake.llm.common import attach, own_prefix, stored

#: Rule lists up to this many rows are broadcast (below 128 bytes a row: 26 MB); longer ones are joined by shuffle.
BROADCAST_RULES = 200_000

RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    """The rules as a table of literals."""
    rows = [F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in rules]
    return spark.range(1, numPartitions=1).select(F.inline(F.array(*rows)))


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(url)), r"^([^?#]*)", 1)
    return F.coalesce(lower, F.lit("")), F.coalesce(path, F.lit(""))


def _digest(expression: Column) -> Column:
    return F.sha2(expression, 256)


def _prefix(digest: Column) -> Column:
    return F.substring(digest, 1, 8)


def judge(
    pages: DataFrame,
    rules: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    default: str = "allow",
    broadcast_limit: int = BROADCAST_RULES,
) -> DataFrame:
    """One row per row of `pages`: page_id, host, path, rule, verdict."""
    host, path = split_url(F.col(url_col))
    urls = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    urls = urls.withColumn("row", F.monotonically_increasing_id())
    clean = rules.dropna(subset=["host", "path", "verdict"]).select(
        F.concat("host", "path").alias("rule"),
        "verdict",
        F.size(F.split("host", r"\.")).alias("labels"),
        F.length("path").alias("chars"),
    )
    # At one expression a block rule beats an allow rule.
    clean = clean.groupBy("rule", "labels", "chars").agg(F.max("verdict").alias("verdict"))
    n, found = clean.agg(F.count("*"), F.collect_set(F.struct("labels", "chars"))).first()
    shapes = sorted((x.labels, x.chars) for x in found)  # distinct lengths only, not rules
    if not shapes:
        return urls.drop("row").withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})

    table = clean.withColumn("digest", _digest(F.col("rule"))).withColumn("prefix", _prefix(F.col("digest")))
    table = table.select("prefix", F.col("digest").alias("rule_digest"), "rule", "verdict")
    exploded = urls.withColumn("expression", F.explode_outer(_expressions(shapes)))
    exploded = exploded.withColumn("digest", _digest(F.col("expression"))).withColumn("prefix", _prefix(F.col("digest")))
    fits = F.col("digest") == F.col("rule_digest")
    if n <= broadcast_limit:
        met = exploded.join(F.broadcast(table), "prefix", "left")
    else:  # the rules that occur at all, with the number of URLs of each; a frequent one is not met in one task
        counts = exploded.groupBy("prefix", "digest").agg(F.count("*").alias("weight"))
        occurring = stored(counts.join(table, "prefix").where(fits).select("digest", "rule_digest", "rule", "verdict", "weight"), "rules")
        met = attach(exploded, occurring, "digest", "weight")
    rank = F.struct(F.length("rule").alias("length"), (F.col("verdict") == "block").alias("block"), F.col("rule"), F.col("verdict"))
    best = met.groupBy("row", "page_id", "host", "path").agg(F.max(F.when(fits, rank)).alias("best"))
    return best.select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )


def _expressions(shapes: list[tuple[int, int]]) -> Column:
    """The host-suffix and path-prefix expressions of columns host and path, of the given lengths."""
    parts = F.split("host", r"\.")
    each = [
        F.when(
            (F.size(parts) >= a) & (F.length("path") >= b),
            F.concat(F.substring_index("host", ".", -a), F.substring("path", 1, b)),
        )
        for a, b in shapes
    ]
    return F.filter(F.array(*each), lambda e: e.isNotNull())


def filter_pages(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """The rows of `pages` that are allowed, all columns. Each different url is judged once; a url that many rows have is not
    one task's."""
    p = own_prefix(pages)
    urls = pages.where(F.col(url_col).isNotNull()).groupBy(F.col(url_col).alias("url")).agg(F.count("*").alias("n"))
    urls = stored(urls, "urls")
    judged = judge(urls, rules, "url", "url", default).select(F.col("page_id").alias("url"), "verdict")
    judged = stored(judged.join(urls, "url").select(F.col("url").alias(url_col), F.col("verdict").alias(p + "v"), F.col("n").alias(p + "n")), "verdicts")
    tagged = attach(pages, judged, url_col, p + "n")
    return tagged.where(F.coalesce(p + "v", F.lit(default)) == "allow").select(*pages.columns)
