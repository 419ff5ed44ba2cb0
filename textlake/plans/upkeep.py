"""Queries of memory and message upkeep, and of small shaping functions, over conversations, events, embeddings and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from textlake.functions import shaping as H
from textlake.operators import matching as M
from textlake.operators import upkeep as U
from textlake.sources.tables import table


def chats(spark, sf):
    return table(spark, sf, "conversations").withColumn("text", F.coalesce("text", F.lit("")))


CHATS = "chats AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations)"


def _vectors(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("vector"))


#: The vectors of the test table lie farther apart than memories that say the same do (0.7).
LIKE = 0.3


def _pairs(spark, sf):
    return M.greedy_similar(_vectors(spark, sf), LIKE, 9)


#: One pass over all pairs, best first, with the ids that are taken in a list.
PAIRS = f"""v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
near AS (SELECT x.vec_id AS a, y.vec_id AS b, list_dot_product(x.v, y.v) / (sqrt(list_dot_product(x.v, x.v)) * sqrt(list_dot_product(y.v, y.v))) AS c FROM v x JOIN v y ON x.vec_id < y.vec_id),
e AS (SELECT a, b, round(c, 9) AS cosine, row_number() OVER (ORDER BY round(c, 9) DESC, a, b) AS k FROM near WHERE c > {LIKE}),
pass(k, a, b, cosine, stays, taken) AS (
    SELECT k, a, b, cosine, true, [a, b] FROM e WHERE k = 1
    UNION ALL
    SELECT e.k, e.a, e.b, e.cosine, NOT list_has_any(taken, [e.a, e.b]), CASE WHEN list_has_any(taken, [e.a, e.b]) THEN taken ELSE list_concat(taken, [e.a, e.b]) END
    FROM pass JOIN e ON e.k = pass.k + 1),
won AS (SELECT a, b, cosine FROM pass WHERE stays)"""


def similar_memories(spark, sf):
    return _pairs(spark, sf).select("a", "b", F.round("cosine", 6).alias("cosine"))


SIMILAR = f"WITH RECURSIVE {PAIRS} SELECT a, b, round(cosine, 6) AS cosine FROM won"


def consolidated_memories(spark, sf):
    v = _vectors(spark, sf)
    memories = v.select("id", F.concat(F.lit("memory "), F.col("id").cast("string")).alias("text"), (F.col("label") / F.lit(10.0)).alias("importance"))
    return U.merged_memories(memories, _pairs(spark, sf).select("a", "b"))


CONSOLIDATED = f"""WITH RECURSIVE {PAIRS} SELECT a, b, 'memory ' || a || '; memory ' || b AS text, greatest(x.label, y.label) / 10.0::DOUBLE AS importance, 0.7::DOUBLE AS confidence
FROM won JOIN embeddings x ON x.vec_id = a JOIN embeddings y ON y.vec_id = b"""


def _memories(spark, sf):
    return table(spark, sf, "events").select(F.col("event_id").alias("id"), "ts", "value", F.lit("active").alias("status"))


def daily_cleanup_log(spark, sf):
    gone = (F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz")) & (F.coalesce("value", F.lit(0.0)) < 20)
    return U.cleaned(_memories(spark, sf), gone, 7)[1]


CLEANUP = """SELECT 7 AS batch, event_id AS id, 'active' AS old_status, 'tombstone' AS new_status FROM events WHERE ts < '2024-01-15' AND coalesce(value, 0) < 20"""


def access_touch(spark, sf):
    e = table(spark, sf, "events")
    return U.touched(table(spark, sf, "customer").select(F.col("c_custkey").alias("id")), e.where("event_type = 'view'").select(F.col("user_id").alias("id"), F.col("ts").alias("at")))


TOUCH = """SELECT c_custkey AS id, coalesce(reads, 0) AS reads, last_read FROM customer LEFT JOIN (SELECT user_id, count(*) AS reads, max(ts) AS last_read FROM events WHERE event_type = 'view' GROUP BY 1) e ON user_id = c_custkey"""


def extracted_memories(spark, sf):
    noise = F.col("text").rlike(r"^[\s\d.,!?]*$")
    kind = F.when(F.contains("text", F.lit("the")), "Entity").otherwise("Working")
    importance = F.when(F.col("role") == "user", 0.7).otherwise(0.5)
    return U.extracted(chats(spark, sf), noise, kind, importance, ["user", "assistant"])


EXTRACTED = rf"""WITH {CHATS}, c AS (SELECT conv_id, turn, CASE WHEN contains(text, 'the') THEN 'Entity' ELSE 'Working' END AS kind, CASE role WHEN 'user' THEN 0.7::DOUBLE ELSE 0.5::DOUBLE END AS importance, text
FROM chats WHERE role IN ('user', 'assistant') AND length(text) >= 10 AND NOT regexp_matches(text, '^[\s\x0b\d.,!?]*$'))
SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY text ORDER BY conv_id, turn, kind, importance) = 1"""


def buffer_pressure(spark, sf):
    return U.pressure(chats(spark, sf), "conv_id", "turn", F.length("text"), 600)


PRESSURE = f"""WITH {CHATS}, u AS (SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS used FROM chats)
SELECT conv_id, round(max(used) / 600, 4) AS ratio, min(turn) FILTER (used > 420) AS warned_at FROM u GROUP BY 1"""


def evicted_counts(spark, sf):
    rows = U.kept_after_eviction(chats(spark, sf), "conv_id", "turn", F.length("text"), 400)
    return rows.withColumn("cursor", U.shifted_cursor(F.lit(3), F.col("evicted"), F.col("kept")))


EVICTED = f"""WITH {CHATS}, u AS (SELECT conv_id, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM chats),
c AS (SELECT conv_id, count(*) FILTER (back > 400) AS evicted, count(*) FILTER (back <= 400) AS kept FROM u GROUP BY 1) SELECT *, greatest(0, least(3 - evicted, kept)) AS cursor FROM c"""


def guarded_context(spark, sf):
    rows = U.guarded_context(chats(spark, sf), "conv_id", "turn", F.col("role") == "assistant", F.lit(False), 300, 40, 20)
    return rows.select("conv_id", "turn", "shown")


GUARD = f"""WITH {CHATS}, x AS (SELECT *, sum(length(text)) OVER (PARTITION BY conv_id) AS total, row_number() OVER (PARTITION BY conv_id, role = 'assistant' ORDER BY turn DESC) AS back FROM chats)
SELECT conv_id, turn, CASE WHEN total > 300 AND role = 'assistant' AND back > 2 AND length(text) > 60 THEN substr(text, 1, 40) || '…' || right(text, 20) ELSE text END AS shown FROM x"""


def pending_writes(spark, sf):
    return U.pending(table(spark, sf, "documents").select("doc_id", "source"), table(spark, sf, "labels"), "doc_id")


PENDING = "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"


def snapshot_compare(spark, sf):
    part = lambda d: table(spark, sf, "documents").where(f"doc_id % 2 = {d}").groupBy("source").agg((F.avg("n_chars") / 10000).alias("coverage"))
    old, new = part(0).where("source <> 'src0'"), part(1).where("source <> 'src1'")
    return U.compared(old, new, "source", "coverage").select("source", "change")


SNAPSHOT = """WITH a AS (SELECT source, avg(n_chars) / 10000 AS was FROM documents WHERE doc_id % 2 = 0 AND source <> 'src0' GROUP BY 1), b AS (SELECT source, avg(n_chars) / 10000 AS now FROM documents WHERE doc_id % 2 = 1 AND source <> 'src1' GROUP BY 1)
SELECT coalesce(a.source, b.source) AS source, CASE WHEN was IS NULL THEN 'added' WHEN now IS NULL THEN 'removed' WHEN abs(now - was) > 0.1 THEN 'major' WHEN abs(now - was) > 0.01 THEN 'minor' ELSE 'same' END AS change FROM a FULL JOIN b ON a.source = b.source"""


def assembled_calls(spark, sf):
    deltas = chats(spark, sf).select("conv_id", F.col("turn").alias("at"), F.when(F.col("turn") % 2 == 0, F.concat("role", F.col("turn").cast("string"))).alias("name"), F.substring("text", 1, 15).alias("piece"))
    return U.assembled(deltas, ["conv_id"], "at")


ASSEMBLED = f"""WITH {CHATS} SELECT conv_id, max_by(role || turn, turn) FILTER (turn % 2 = 0) AS name, string_agg(substr(text, 1, 15), '' ORDER BY turn, substr(text, 1, 15)) AS arguments FROM chats GROUP BY 1"""


def store_statistics(spark, sf):
    c = chats(spark, sf)
    return c.agg(
        F.count("*").alias("messages"), F.count_distinct("conv_id").alias("threads"), F.count_if(F.col("role") == "user").alias("from_user"), F.count_if(F.col("role") == "system").alias("from_system"),
        F.count_if(F.length("text") == 0).alias("empty"), F.max("turn").alias("longest"), F.sum(F.length("text")).alias("chars"),
    )


STORE = f"""WITH {CHATS} SELECT count(*) AS messages, count(DISTINCT conv_id) AS threads, count(*) FILTER (role = 'user') AS from_user, count(*) FILTER (role = 'system') AS from_system,
count(*) FILTER (length(text) = 0) AS empty, max(turn) AS longest, sum(length(text))::BIGINT AS chars FROM chats"""


def shaped_events(spark, sf):
    e = table(spark, sf, "events")
    return e.select(
        "event_id", H.season(F.col("ts")).alias("season"), F.date_format(H.parsed_time(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")), "yyyy-MM-dd HH:mm:ss").alias("stored"),
        H.cell(F.coalesce("value", F.lit(0.0)), "percent").alias("percent"), H.cell(F.coalesce("value", F.lit(0.0)), "integer").alias("whole"),
        H.paragraph_index(F.when(F.col("event_id") % 5 == 0, "x").when(F.col("event_id") % 5 == 1, "-7").otherwise(F.col("user_id").cast("string"))).alias("para"),
    )


SHAPED = """SELECT event_id, CASE WHEN month(ts) IN (3, 4, 5) THEN 'spring' WHEN month(ts) IN (6, 7, 8) THEN 'summer' WHEN month(ts) IN (9, 10, 11) THEN 'autumn' ELSE 'winter' END AS season,
strftime(ts, '%Y-%m-%d %H:%M:%S') AS stored, floor(coalesce(value, 0) * 100 + 0.5)::BIGINT || '%' AS percent, floor(coalesce(value, 0) + 0.5)::BIGINT::VARCHAR AS whole,
CASE event_id % 5 WHEN 0 THEN -1 WHEN 1 THEN -1 ELSE user_id END AS para FROM events"""


def composite_keys(spark, sf):
    key = F.concat_ws(":", F.pmod("doc_id", F.lit(150)).cast("string"), F.when(F.col("doc_id") % 11 == 0, "x").otherwise(F.pmod("doc_id", F.lit(30)).cast("string")), F.when(F.col("doc_id") % 2 == 0, "left"))
    parsed = H.composite_key(key, 120)
    return table(spark, sf, "documents").select("doc_id", parsed["chapter"].alias("chapter"), parsed["para"].alias("para"), parsed["side"].alias("side"))


COMPOSITE = """WITH x AS (SELECT doc_id, (doc_id % 150)::INT AS c, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE (doc_id % 30)::INT END AS p FROM documents)
SELECT doc_id, CASE WHEN c BETWEEN 1 AND 120 AND p IS NOT NULL THEN c END AS chapter, CASE WHEN c BETWEEN 1 AND 120 THEN p END AS para, CASE WHEN c BETWEEN 1 AND 120 AND p IS NOT NULL AND doc_id % 2 = 0 THEN 'left' END AS side FROM x"""


def repaired_json(spark, sf):
    e = table(spark, sf, "events")
    broken = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("noise "), "props", F.lit(" end"))).when(F.col("event_id") % 3 == 1, F.replace("props", F.lit("}"), F.lit(",}"))).otherwise(F.replace("props", F.lit("}"), F.lit("")))
    return e.select("event_id", H.repaired_json(broken, "k long")["k"].alias("k"))


REPAIRED = "SELECT event_id, (props->>'k')::BIGINT AS k FROM events"


def delimiter_tuples(spark, sf):
    line = F.concat_ws("<|#|>", F.lit("entity"), "source", "lang", F.substring("text", 1, 20))
    t = H.delimited(line)
    return table(spark, sf, "documents").select("doc_id", t[0].alias("kind"), t[1].alias("name"), t[2].alias("lang"), F.size(t).alias("fields"))


TUPLES = """WITH x AS (SELECT doc_id, list_transform(string_split('entity<|#|>' || source || '<|#|>' || lang || '<|#|>' || substr(text, 1, 20), '<|#|>'), lambda s: trim(s)) AS t FROM documents)
SELECT doc_id, t[1] AS kind, t[2] AS name, t[3] AS lang, len(t)::INT AS fields FROM x"""


def tag_lists(spark, sf):
    """Tags of a document from two fields, placeholders dropped, each once in the order of their first place."""
    people = F.transform(F.slice(F.split("text", " "), 1, 6), lambda w: F.struct(F.lower(w).alias("canonical"), w.alias("raw")))
    tags = H.tag_list([H.projected(people, "canonical"), F.array(F.col("source"), F.lit("deleted"), F.col("lang"))], "deleted")
    return table(spark, sf, "documents").select("doc_id", F.array_join(tags, "|").alias("tags"))


TAGS = """WITH x AS (SELECT doc_id, list_concat(list_transform(string_split(text, ' ')[1:6], lambda w: lower(w)), [source, lang]) AS l FROM documents)
SELECT doc_id, array_to_string(list_transform(list_filter(range(1, len(l) + 1), lambda i: list_position(l, l[i]) = i AND l[i] <> ''), lambda i: l[i]), '|') AS tags FROM x"""


QUERIES = {
    "similar_memories": similar_memories, "consolidated_memories": consolidated_memories, "daily_cleanup_log": daily_cleanup_log, "access_touch": access_touch, "extracted_memories": extracted_memories,
    "buffer_pressure": buffer_pressure, "evicted_counts": evicted_counts, "guarded_context": guarded_context, "pending_writes": pending_writes, "snapshot_compare": snapshot_compare,
    "assembled_calls": assembled_calls, "store_statistics": store_statistics, "shaped_events": shaped_events, "composite_keys": composite_keys, "repaired_json": repaired_json,
    "delimiter_tuples": delimiter_tuples, "tag_lists": tag_lists,
}
ORACLE_SQL = {
    "similar_memories": SIMILAR, "consolidated_memories": CONSOLIDATED, "daily_cleanup_log": CLEANUP, "access_touch": TOUCH, "extracted_memories": EXTRACTED,
    "buffer_pressure": PRESSURE, "evicted_counts": EVICTED, "guarded_context": GUARD, "pending_writes": PENDING, "snapshot_compare": SNAPSHOT,
    "assembled_calls": ASSEMBLED, "store_statistics": STORE, "shaped_events": SHAPED, "composite_keys": COMPOSITE, "repaired_json": REPAIRED,
    "delimiter_tuples": TUPLES, "tag_lists": TAGS,
}
