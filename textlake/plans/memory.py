"""Queries over conversations: budgets, noise, typing, decay, upserts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from textlake.functions import text as T
from textlake.operators import memory as M
from textlake.operators.corpus import ranked
from textlake.sources.tables import table


def _messages(spark, sf):
    return table(spark, sf, "conversations").withColumn("tokens", T.token_estimate(F.col("text")))


TOK = "m AS (SELECT *, floor(length(text) / 4.0)::BIGINT AS tokens FROM conversations)"


def history_token_budget(spark, sf):
    """Newest messages of each conversation until 200 tokens overflow."""
    return M.fits_budget(_messages(spark, sf), "conv_id", [F.desc("turn")], F.col("tokens"), 200).select("conv_id", "turn", "tokens", "running")


BUDGET = f"""WITH {TOK} SELECT * FROM (SELECT conv_id, turn, tokens, sum(tokens) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING)::BIGINT AS running FROM m) WHERE running <= 200"""


def history_with_system(spark, sf):
    rows = M.history(_messages(spark, sf), "conv_id", "turn", F.col("role") == "system", F.col("tokens"), 150)
    return rows.select("conv_id", "turn", "role", "tokens")


HISTORY = f"""WITH {TOK}, x AS (SELECT *, coalesce(sum(tokens) FILTER (role = 'system') OVER (PARTITION BY conv_id), 0) AS fixed,
sum(tokens) OVER (PARTITION BY conv_id, role = 'system' ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS run FROM m)
SELECT conv_id, turn, role, tokens FROM x WHERE role = 'system' OR fixed + run <= 150"""


def budget_greedy_skip(spark, sf):
    """Sequential fold: what doesn't fit is passed over."""
    return M.fits_budget_skipping(_messages(spark, sf), "conv_id", ["turn"], F.col("tokens"), 100, "turn").select("conv_id", F.array_join(F.transform("kept", lambda x: x.cast("string")), ",").alias("kept"), "used")


GREEDY = f"""WITH RECURSIVE {TOK}, o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM m),
f(conv_id, i, n, used, kept) AS (SELECT conv_id, 0, any_value(n), 0::BIGINT, '' FROM o GROUP BY conv_id
UNION ALL SELECT f.conv_id, f.i + 1, f.n, CASE WHEN f.used + o.tokens <= 100 THEN f.used + o.tokens ELSE f.used END,
CASE WHEN f.used + o.tokens <= 100 THEN f.kept || CASE WHEN f.kept = '' THEN '' ELSE ',' END || o.turn::VARCHAR ELSE f.kept END FROM f JOIN o ON f.conv_id = o.conv_id AND o.i = f.i + 1)
SELECT conv_id, kept, used FROM f WHERE i = n"""


def noise_filter(spark, sf):
    return table(spark, sf, "conversations").groupBy("role").agg(F.count("*").alias("n"), F.count_if(M.is_noise(F.col("text"))).alias("noise"))


NOISE = r"""SELECT role, count(*) AS n, count(*) FILTER (regexp_matches(coalesce(text, ''), '^\s*$|^(?i:ok|okay|thanks|thank you|hi|hello|好的|谢谢|你好|嗯+)[.!。！]?\s*$|^.{0,2}$|^[\d\s.,]+$|^[!?.。！？…]+$')) AS noise FROM conversations GROUP BY 1"""


def memory_type_rules(spark, sf):
    rows = table(spark, sf, "conversations").withColumn("kind", M.memory_type(F.col("role"), F.col("text")))
    return rows.withColumn("importance", M.importance(F.col("kind"), F.col("role"), F.col("text"))).groupBy("role", "kind", "importance").agg(F.count("*").alias("n"))


KIND = """CASE WHEN contains(text, 'must') OR contains(text, 'never') OR contains(text, '必须') OR contains(text, '禁止') THEN 'System'
WHEN contains(text, 'now') OR contains(text, 'current') OR contains(text, '现在') OR contains(text, '正在') THEN 'Working'
WHEN contains(text, ' is ') OR contains(text, 'name') OR contains(text, '是') THEN 'Entity' WHEN contains(text, 'licens') OR contains(text, 'chapter') OR contains(text, '原文') THEN 'Archival'
WHEN role = 'user' THEN 'Working' WHEN role = 'system' THEN 'System' ELSE 'Summary' END"""
IMPORTANCE = """round(greatest(0, least(1, CASE kind WHEN 'System' THEN 0.95 WHEN 'Entity' THEN 0.7 WHEN 'Archival' THEN 0.6 WHEN 'Summary' THEN 0.5 ELSE 0.4 END
+ CASE WHEN role = 'user' THEN 0.1 ELSE 0 END + CASE WHEN regexp_matches(text, '(?i)important|remember|重要|记住') THEN 0.15 ELSE 0 END)), 2)::DOUBLE"""
KINDS = f"WITH k AS (SELECT role, text, {KIND} AS kind FROM conversations) SELECT role, kind, {IMPORTANCE} AS importance, count(*) AS n FROM k GROUP BY ALL"


def _memories(spark, sf):
    """Messages as memories: created day by day with their turn."""
    rows = table(spark, sf, "conversations").withColumn("memory_type", M.memory_type(F.col("role"), F.col("text")))
    rows = rows.withColumn("importance", M.importance(F.col("memory_type"), F.col("role"), F.col("text")))
    created = F.expr("timestampadd(DAY, -cast(conv_id % 211 as int), timestamp '2024-06-01 00:00:00')")
    return rows.select("conv_id", "turn", "memory_type", "importance", created.alias("created_at"), F.when(F.col("turn") % 3 == 0, F.expr("timestampadd(DAY, -cast(conv_id % 97 as int), timestamp '2024-06-01 00:00:00')")).alias("last_accessed_at"))


NOW = "2024-06-01 12:00:00"


def memory_scores(spark, sf):
    rows = M.scored(_memories(spark, sf), F.lit(NOW).cast("timestamp"), F.lit(0.5))
    return rows.select("conv_id", "turn", "days", "recency", "score")


MEM = f"""k AS (SELECT conv_id, turn, role, text, {KIND} AS kind FROM conversations), mem AS (SELECT conv_id, turn, kind, {IMPORTANCE} AS importance,
CASE WHEN turn % 3 = 0 THEN (conv_id % 97)::BIGINT ELSE (conv_id % 211)::BIGINT END AS days FROM k),
sc AS (SELECT *, round(pow(2, -days / (CASE kind WHEN 'Entity' THEN 90 WHEN 'Archival' THEN 60 WHEN 'Summary' THEN 14 WHEN 'Working' THEN 7 ELSE 3650 END / 2.0)), 4) AS recency FROM mem)"""
SCORES = f"WITH {MEM} SELECT conv_id, turn, days, recency, round(0.25 + 0.3 * importance + 0.2 * recency, 6) AS score FROM sc"


def memory_expiry(spark, sf):
    rows = M.scored(_memories(spark, sf), F.lit(NOW).cast("timestamp"), F.lit(0.5))
    gone = M.expired(F.col("memory_type"), F.col("importance"), F.col("days"))
    return rows.groupBy("memory_type").agg(F.count("*").alias("n"), F.count_if(gone).alias("expired"))


EXPIRY = f"""WITH {MEM} SELECT kind AS memory_type, count(*) AS n, count(*) FILTER (CASE kind WHEN 'System' THEN false WHEN 'Entity' THEN importance < 0.6 AND days > 180 WHEN 'Archival' THEN importance < 0.4 AND days > 90
WHEN 'Summary' THEN importance < 0.3 AND days > 30 ELSE importance < 0.3 AND days > 7 END) AS expired FROM sc GROUP BY 1"""


def dedup_latest_turn(spark, sf):
    """Of equal messages of a role, the first, and how many there were. Every other conversation is sent twice."""
    rows = table(spark, sf, "conversations").select("role", "conv_id", "turn", "text")
    rows = rows.unionByName(rows.where("conv_id % 2 = 0").withColumn("conv_id", F.col("conv_id") + 10**9))
    first = rows.groupBy("role", F.sha2("text", 256).alias("digest")).agg(F.min(F.struct("conv_id", "turn")).alias("first"), F.count("*").alias("copies"))
    return first.where("copies > 1").select("role", "first.conv_id", "first.turn", "copies")


DEDUP = """WITH x AS (SELECT role, conv_id, turn, text FROM conversations UNION ALL SELECT role, conv_id + 1000000000, turn, text FROM conversations WHERE conv_id % 2 = 0)
SELECT role, conv_id, turn, copies FROM (SELECT *, row_number() OVER (PARTITION BY role, text ORDER BY conv_id, turn) AS place, count(*) OVER (PARTITION BY role, text) AS copies FROM x) WHERE place = 1 AND copies > 1"""


def merge_last_write_wins(spark, sf):
    """An upsert of later versions: each odd turn's message takes the place of the one before it; null titles keep the old ones."""
    c = table(spark, sf, "conversations").select("conv_id", F.floor(F.col("turn") / 2).cast("bigint").alias("slot"), F.col("text").alias("title"), "turn")
    old = c.where("turn % 2 = 0")
    new = c.where("turn % 2 = 1 and conv_id % 3 <> 0").withColumn("title", F.when(F.col("conv_id") % 2 == 0, F.col("title")))
    return M.last_write_wins(old, new, ["conv_id", "slot"], ["title"]).select("conv_id", "slot", F.md5("title").alias("title"), "turn")


UPSERT = """WITH o AS (SELECT conv_id, turn // 2 AS slot, text AS title, turn FROM conversations WHERE turn % 2 = 0),
n AS (SELECT conv_id, turn // 2 AS slot, CASE WHEN conv_id % 2 = 0 THEN text END AS title, turn FROM conversations WHERE turn % 2 = 1 AND conv_id % 3 <> 0)
SELECT conv_id, slot, md5(coalesce(n.title, o.title)) AS title, CASE WHEN n.conv_id IS NOT NULL THEN n.turn ELSE o.turn END AS turn FROM o FULL JOIN n USING (conv_id, slot)"""


def save_with_protection(spark, sf):
    """Agent rows replace agent rows of the touched conversations; user rows stay."""
    c = table(spark, sf, "conversations").withColumn("id", F.concat_ws("-", "conv_id", "turn"))
    new = c.where("conv_id % 5 = 0 and turn <= 1").withColumn("text", F.lit("new"))
    return M.replace_scope(c, new, ["conv_id"], "id", F.col("role") == "user").groupBy("role").agg(F.count("*").alias("n"), F.count_if(F.col("text") == "new").alias("new"))


SAVE = """WITH c AS (SELECT *, conv_id || '-' || turn AS id FROM conversations), n AS (SELECT * REPLACE ('new' AS text) FROM c WHERE conv_id % 5 = 0 AND turn <= 1), keep AS (SELECT * FROM c WHERE role = 'user'),
r AS (SELECT * FROM keep UNION ALL SELECT * FROM c WHERE role <> 'user' AND conv_id NOT IN (SELECT conv_id FROM n) AND id NOT IN (SELECT id FROM n) UNION ALL SELECT * FROM n WHERE id NOT IN (SELECT id FROM keep))
SELECT role, count(*) AS n, count(*) FILTER (text = 'new') AS new FROM r GROUP BY 1"""


def longest_conversations(spark, sf):
    rows = _messages(spark, sf).groupBy("conv_id").agg(F.count("*").alias("turns"), F.sum("tokens").alias("tokens"), F.countDistinct("role").alias("roles"))
    return ranked(rows, 20, F.desc("tokens"), F.asc("conv_id"))


LONGEST = f"WITH {TOK} SELECT conv_id, count(*) AS turns, sum(tokens)::BIGINT AS tokens, count(DISTINCT role) AS roles, row_number() OVER (ORDER BY sum(tokens) DESC, conv_id) AS rank FROM m GROUP BY 1 ORDER BY rank LIMIT 20"


def repeated_calls(spark, sf):
    """A message like the one before it of its role in the conversation."""
    over = Window.partitionBy("conv_id", "role").orderBy("turn")
    rows = table(spark, sf, "conversations").withColumn("same", F.col("text").eqNullSafe(F.lag("text").over(over)))
    return rows.groupBy("role").agg(F.count_if("same").alias("repeats"))


REPEATS = "SELECT role, count(*) FILTER (same) AS repeats FROM (SELECT role, text = lag(text) OVER (PARTITION BY conv_id, role ORDER BY turn) AS same FROM conversations) GROUP BY 1"


QUERIES = {
    "history_token_budget": history_token_budget, "history_with_system": history_with_system, "budget_greedy_skip": budget_greedy_skip, "noise_filter": noise_filter, "memory_type_rules": memory_type_rules,
    "memory_scores": memory_scores, "memory_expiry": memory_expiry, "dedup_latest_turn": dedup_latest_turn, "merge_last_write_wins": merge_last_write_wins, "save_with_protection": save_with_protection,
    "longest_conversations": longest_conversations, "repeated_calls": repeated_calls,
}
ORACLE_SQL = {
    "history_token_budget": BUDGET, "history_with_system": HISTORY, "budget_greedy_skip": GREEDY, "noise_filter": NOISE, "memory_type_rules": KINDS, "memory_scores": SCORES, "memory_expiry": EXPIRY,
    "dedup_latest_turn": DEDUP, "merge_last_write_wins": UPSERT, "save_with_protection": SAVE, "longest_conversations": LONGEST, "repeated_calls": REPEATS,
}
