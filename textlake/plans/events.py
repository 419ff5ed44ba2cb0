"""Queries over the event log."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from textlake.operators import events as E
from textlake.operators.corpus import ranked
from textlake.plans.streams import BUCKETS as TOKEN_BUCKETS
from textlake.sources.tables import table


def _events(spark, sf):
    return table(spark, sf, "events")


def call_summary(spark, sf):
    return E.call_summary(_events(spark, sf), "event_type").select("event_type", "n", "errors", "mean", "total", "first", "last")


SUMMARY = """SELECT event_type, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors, round(avg(value), 4) AS mean, round(sum(value), 3) AS total, min(ts) AS first, max(ts) AS last FROM events GROUP BY 1"""


def call_error_rate(spark, sf):
    rows = E.call_summary(_events(spark, sf), F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day"))
    return rows.select("day", "n", "errors", F.round(F.col("errors") / F.col("n"), 4).alias("rate"))


ERRORS = """SELECT date_trunc('day', ts)::TIMESTAMP AS day, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors, round(count(*) FILTER (event_type = 'error') / count(*), 4) AS rate FROM events GROUP BY 1"""


def bucket_sums(spark, sf):
    band = F.when(F.col("value") <= 5, "5").when(F.col("value") <= 10, "10").otherwise("more")
    return _events(spark, sf).groupBy("event_type", band.alias("band")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total"))


BUCKETS = "SELECT event_type, CASE WHEN value <= 5 THEN '5' WHEN value <= 10 THEN '10' ELSE 'more' END AS band, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY 1, 2"


def session_gaps(spark, sf):
    return E.sessions(_events(spark, sf), "user_id", "ts", 30)


SESSIONS = """WITH x AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS l FROM events),
y AS (SELECT *, sum(CASE WHEN l IS NULL OR ts > l + INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM x)
SELECT user_id, session, min(ts) AS start, max(ts) AS "end", count(*) AS n FROM y GROUP BY 1, 2"""


def tumbling_counts(spark, sf):
    return E.tumbling(_events(spark, sf), "ts", "1 hour", "event_type")


TUMBLING = "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY 1, 2"


def sliding_counts(spark, sf):
    return E.sliding(_events(spark, sf), "ts", "2 hours", "1 hour", "event_type")


SLIDING = "SELECT date_trunc('hour', ts) - to_hours(k) AS window_start, event_type, count(*) AS n FROM events, (VALUES (0), (1)) t(k) GROUP BY 1, 2"


def rate_limited(spark, sf):
    return E.token_bucket(_events(spark, sf), "user_id", 1 / 86400, 2.0)


RATE_LIMITED = f"WITH RECURSIVE {TOKEN_BUCKETS} SELECT user_id, count(*) AS n, count(*) FILTER (allowed) AS allowed FROM b GROUP BY 1"


def purchases_as_of_view(spark, sf):
    ev = _events(spark, sf)
    return E.as_of(ev.where("event_type = 'purchase'"), ev.where("event_type = 'view'"), "user_id", "ts", "value")


AS_OF = """WITH p AS (SELECT * FROM events WHERE event_type = 'purchase'), v AS (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'view' GROUP BY 1, 2)
SELECT p.event_id, v.value AS as_of FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts >= v.ts"""


def json_properties(spark, sf):
    rows = _events(spark, sf).select("event_type", F.get_json_object("props", "$.k").cast("int").alias("k"))
    return rows.groupBy("event_type").agg(F.count("k").alias("n"), F.sum("k").alias("total"), F.max("k").alias("most"), F.count_if(F.col("k").isNull()).alias("missing"))


JSON = "SELECT event_type, count(k) AS n, sum(k)::BIGINT AS total, max(k) AS most, count(*) - count(k) AS missing FROM (SELECT event_type, (props->>'$.k')::INT AS k FROM events) GROUP BY 1"


def busiest_users(spark, sf):
    rows = _events(spark, sf).groupBy("user_id").agg(F.count("*").alias("n"), F.countDistinct("event_type").alias("kinds"), F.approx_count_distinct(F.to_date("ts")).alias("days_about"))
    return ranked(rows.drop("days_about"), 10, F.desc("n"), F.asc("user_id"))


BUSIEST = "SELECT user_id, count(*) AS n, count(DISTINCT event_type) AS kinds, row_number() OVER (ORDER BY count(*) DESC, user_id) AS rank FROM events GROUP BY 1 ORDER BY rank LIMIT 10"


def event_transitions(spark, sf):
    over = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = _events(spark, sf).withColumn("before", F.lag("event_type").over(over)).where("before is not null")
    return rows.groupBy("before", F.col("event_type").alias("after")).agg(F.count("*").alias("n"))


TRANSITIONS = "SELECT before, event_type AS after, count(*) AS n FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE before IS NOT NULL GROUP BY 1, 2"


def stage_timeline(spark, sf):
    """Per user: calls, value, span of time in seconds, mean distance between calls."""
    rows = _events(spark, sf).groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total"), F.expr("timestampdiff(SECOND, min(ts), max(ts))").alias("seconds"))
    return rows.withColumn("mean_gap", F.round(F.try_divide("seconds", F.col("n") - 1), 3))


TIMELINE = "SELECT user_id, count(*) AS n, round(sum(value), 3) AS total, (epoch_us(max(ts)) - epoch_us(min(ts))) // 1000000 AS seconds, round(((epoch_us(max(ts)) - epoch_us(min(ts))) // 1000000) / nullif(count(*) - 1, 0), 3) AS mean_gap FROM events GROUP BY 1"

QUERIES = {
    "call_summary": call_summary, "call_error_rate": call_error_rate, "bucket_sums": bucket_sums, "session_gaps": session_gaps, "tumbling_counts": tumbling_counts, "sliding_counts": sliding_counts,
    "rate_limited": rate_limited, "purchases_as_of_view": purchases_as_of_view, "json_properties": json_properties, "busiest_users": busiest_users, "event_transitions": event_transitions, "stage_timeline": stage_timeline,
}
ORACLE_SQL = {
    "rate_limited": RATE_LIMITED, "call_summary": SUMMARY, "call_error_rate": ERRORS, "bucket_sums": BUCKETS, "session_gaps": SESSIONS, "tumbling_counts": TUMBLING, "sliding_counts": SLIDING, "purchases_as_of_view": AS_OF,
    "json_properties": JSON, "busiest_users": BUSIEST, "event_transitions": TRANSITIONS, "stage_timeline": TIMELINE,
}
