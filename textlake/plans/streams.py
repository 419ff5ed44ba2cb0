"""Streaming queries, run over all files that there are."""

from __future__ import annotations

from pyspark.sql import functions as F

from textlake.functions import text as T
from textlake.streaming import keyed as K
from textlake.streaming import streams as S


def stream_tumbling(spark, sf):
    out = S.run(S.tumbling(S.stream(spark, sf, "events"), "1 hour", "2 hours"), "complete")
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


TUMBLING = "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY 1, 2"


def stream_sessions(spark, sf):
    out = S.run(S.sessions(S.stream(spark, sf, "events"), "30 minutes", "1 hour"), "complete")
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("until").cast("timestamp_ntz").alias("until"), "n")


SESSIONS = """WITH x AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS l FROM events),
y AS (SELECT *, sum(CASE WHEN l IS NULL OR ts >= l + INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM x)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS until, count(*) AS n FROM y GROUP BY user_id, s"""


def stream_evictions(spark, sf):
    """Messages that leave a conversation's buffer. The table has no times, so a turn is a second, and all files are one trigger."""
    rows = S.stream(spark, sf, "conversations", 100_000)
    rows = rows.select("conv_id", F.col("turn").cast("bigint").alias("turn"), T.token_estimate(F.coalesce("text", F.lit(""))).alias("tokens"))
    out = K.keyed(rows, "conv_id", F.timestamp_seconds(F.col("turn") + 1), F.col("tokens"), ["turn", "tokens"], K.Evictions(100), "0 seconds", 30)
    return S.run(out, "append").select("conv_id", "turn", "tokens")


EVICTIONS = """WITH m AS (SELECT conv_id, turn, floor(length(coalesce(text, '')) / 4.0)::BIGINT AS tokens FROM conversations),
x AS (SELECT *, sum(tokens) OVER w AS back, row_number() OVER w AS place FROM m WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC, tokens DESC ROWS UNBOUNDED PRECEDING))
SELECT conv_id, turn, tokens FROM x WHERE back > 100 AND place > 1"""


RATE, BURST = 1 / 86400, 2.0


def stream_rate_limited(spark, sf):
    """Which events find a token in their user's bucket. The watermark of the last batch takes the latest event with it."""
    rows = S.stream(spark, sf, "events", 100_000).withColumn("at", F.col("ts").cast("timestamp")).withColumn("micros", F.unix_micros("at"))
    out = K.keyed(rows, "user_id", F.col("at"), F.col("event_id"), ["event_id", "micros"], K.TokenBucket(RATE, BURST), "0 seconds", 400 * 86400)
    return S.run(out, "append").select("user_id", "event_id", "allowed", F.round("level", 6).alias("level"))


BUCKETS = """e AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
b(user_id, event_id, k, t, allowed, level) AS (
    SELECT user_id, event_id, k, t, true, 1.0::DOUBLE FROM e WHERE k = 1
    UNION ALL
    SELECT e.user_id, e.event_id, e.k, e.t, least(2.0::DOUBLE, level + (e.t - b.t) / 1e6 * (1.0::DOUBLE / 86400)) >= 1.0,
           least(2.0::DOUBLE, level + (e.t - b.t) / 1e6 * (1.0::DOUBLE / 86400)) - CASE WHEN least(2.0::DOUBLE, level + (e.t - b.t) / 1e6 * (1.0::DOUBLE / 86400)) >= 1.0 THEN 1.0 ELSE 0.0 END
    FROM b JOIN e ON e.user_id IS NOT DISTINCT FROM b.user_id AND e.k = b.k + 1)"""
STREAM_BUCKETS = f"WITH RECURSIVE {BUCKETS} SELECT user_id, event_id, allowed, round(level, 6) AS level FROM b"


QUERIES = {"stream_tumbling": stream_tumbling, "stream_sessions": stream_sessions, "stream_evictions": stream_evictions, "stream_rate_limited": stream_rate_limited}
ORACLE_SQL = {"stream_tumbling": TUMBLING, "stream_sessions": SESSIONS, "stream_evictions": EVICTIONS, "stream_rate_limited": STREAM_BUCKETS}
