"""Queries over conversations and event sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.operators import conversations as C
from tracelake.operators.ranking import numbered
from tracelake.operators import runs as R
from tracelake.plans.registry import query, table

PROMPT = "Please provide your supervisor feedback now."


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.col("text").alias("content"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


@query("""
WITH e AS (SELECT user_id, ts, event_id, event_type, lag(event_type, 1) OVER w AS a, lag(event_type, 2) OVER w AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT user_id, coalesce(bool_or(event_type = a AND event_type = b), false) AS stuck FROM e GROUP BY user_id)
SELECT quality, count(*) AS n, count(*) FILTER (stuck) AS n_stuck, round(100.0 * count(*) FILTER (stuck) / count(*), 6) AS stuck_pct
FROM s LEFT JOIN (SELECT doc_id, quality FROM labels) l ON s.user_id = l.doc_id GROUP BY quality""")
def f3_loops_by_quality(spark, sf_dir):
    """Loop rates of actors by the label that they resolve to."""
    stuck = C.stuck(_events(spark, sf_dir), "user_id", ["ts", "event_id"], F.col("event_type"))
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("user_id"), "quality")
    return stuck.join(labels, "user_id", "left").groupBy("quality").agg(F.count("*").alias("n"), F.count_if("stuck").alias("n_stuck"), F.round(100.0 * F.count_if("stuck") / F.count("*"), 6).alias("stuck_pct"))


@query("""
WITH e AS (SELECT user_id, event_type, lag(event_type, 1) OVER w AS a, lag(event_type, 2) OVER w AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, coalesce(bool_or(event_type = a AND event_type = b), false) AS stuck FROM e GROUP BY user_id""")
def w3_stuck_in_loop(spark, sf_dir):
    return C.stuck(_events(spark, sf_dir), "user_id", ["ts", "event_id"], F.col("event_type"))


@query("SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS invocation FROM conversations WHERE role = 'assistant'")
def w1_invocation_number(spark, sf_dir):
    return C.invocations(_messages(spark, sf_dir), "conv_id", "turn", F.col("role") == "assistant").select("conv_id", "turn", "invocation")


@query("""
SELECT conv_id, turn, CAST(len(h) AS INTEGER) AS n_history, coalesce(array_to_string(list_transform(h, lambda x, i: '#' || CAST(i AS VARCHAR) || ' ' || x), '|'), '') AS history
FROM (SELECT conv_id, turn, coalesce(list(text) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), []) AS h FROM conversations)""")
def w2_history_last5(spark, sf_dir):
    h = C.with_history(_messages(spark, sf_dir), "conv_id", "turn", "content")
    shown = F.transform("history", lambda x: F.concat(F.lit("#"), x["n"].cast("string"), F.lit(" "), x["content"]))
    return h.select("conv_id", "turn", F.size("history").alias("n_history"), F.array_join(shown, "|").alias("history"))


@query("""
SELECT conv_id, turn, CAST(used AS BIGINT) AS used FROM (SELECT conv_id, turn, sum(length(text) // 4) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS used FROM conversations) WHERE used <= 300""")
def w4_keep_recent_budget(spark, sf_dir):
    sized = _messages(spark, sf_dir).withColumn("tokens", F.expr("length(content) div 4"))
    return C.keep_recent(sized, "conv_id", "turn", "tokens", 300).select("conv_id", "turn", "used")


@query("""
WITH m AS (SELECT conv_id, turn, role, text FROM conversations WHERE NOT (role = 'assistant' AND turn % 4 = 1)),
s AS (SELECT *, CASE WHEN role = lag(role) OVER w AND role <> 'system' THEN 0 ELSE 1 END AS new FROM m WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
i AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) - 1 AS island FROM s)
SELECT conv_id, CAST(island AS INTEGER) AS turn, any_value(role) AS role, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS content FROM i GROUP BY conv_id, island""")
def w5_merge_roles(spark, sf_dir):
    m = _messages(spark, sf_dir).filter(~((F.col("role") == "assistant") & (F.col("turn") % 4 == 1)))
    return C.merge_roles(m, "conv_id", "turn")


@query("SELECT conv_id, CAST((turn - 2) // 2 AS INTEGER) AS pair, count(*) AS n, min(turn) AS first_turn FROM conversations WHERE turn >= 2 GROUP BY ALL")
def w6_turn_pairs(spark, sf_dir):
    return C.pair_turns(_messages(spark, sf_dir), "conv_id", "turn").groupBy("conv_id", "pair").agg(F.count("*").alias("n"), F.min("turn").alias("first_turn"))


@query("""
SELECT conv_id, turn, CAST(coalesce(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS page FROM conversations""")
def w9_step_pages(spark, sf_dir):
    return C.pages(_messages(spark, sf_dir), "conv_id", "turn").select("conv_id", "turn", "page")


@query("SELECT conv_id, turn, role, turn % 3 = 0 AS fires FROM conversations WHERE role = 'assistant' AND turn % 3 = 0")
def w10_cadence(spark, sf_dir):
    m = _messages(spark, sf_dir).withColumn("fires", F.col("turn") % 3 == 0)
    return m.filter((F.col("role") == "assistant") & F.col("fires")).select("conv_id", "turn", "role", "fires")


@query("SELECT conv_id, max(turn) AS active_turn FROM conversations WHERE role = 'assistant' GROUP BY conv_id")
def w11_active_supervisor(spark, sf_dir):
    return _messages(spark, sf_dir).filter("role = 'assistant'").groupBy("conv_id").agg(F.max("turn").alias("active_turn"))


@query("SELECT conv_id, turn, role = 'user' AND r <= 2 AS tagged FROM (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC) AS r FROM conversations)")
def w13_tag_last_users(spark, sf_dir):
    return C.tag_last_users(_messages(spark, sf_dir), "conv_id", "turn").select("conv_id", "turn", "tagged")


@query("SELECT conv_id, turn, (['fast', 'slow', 'deep'])[turn % 3 + 1] AS model FROM conversations")
def w14_cyclic_schedule(spark, sf_dir):
    models = F.array(*map(F.lit, ("fast", "slow", "deep")))
    return _messages(spark, sf_dir).select("conv_id", "turn", F.element_at(models, (F.pmod("turn", F.lit(3)) + 1).cast("int")).alias("model"))


@query("""
SELECT user_id, CAST((dense_rank() OVER (ORDER BY first, user_id) - 1) % 7 AS INTEGER) AS key_no FROM (SELECT user_id, min(event_id) AS first FROM events GROUP BY user_id)""")
def w15_rotating_key(spark, sf_dir):
    """Keys dealt to workers in the order in which they are first seen; any number of workers will do."""
    first = _events(spark, sf_dir).groupBy("user_id").agg(F.min("event_id").alias("first"))
    return numbered(first, [F.asc("first"), F.asc("user_id")], "n").select("user_id", F.pmod("n", F.lit(7)).cast("int").alias("key_no"))


@query("""
WITH c AS (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos FROM conversations),
p AS (SELECT *, CAST(least(2, greatest((n - 2) // 2, 0)) AS INTEGER) AS prefix_steps FROM c)
SELECT conv_id, prefix_steps, prefix_steps < 2 AS submit_base, CAST(sum(CASE WHEN role = 'assistant' THEN length(text) // 4 ELSE 0 END) AS BIGINT) AS tokens
FROM p WHERE prefix_steps > 0 AND pos < 2 + 2 * prefix_steps GROUP BY ALL""")
def w16_prefix_cost(spark, sf_dir):
    p = C.prefix(_messages(spark, sf_dir), "conv_id", "turn", 2)
    return p.groupBy("conv_id", "prefix_steps", "submit_base").agg(F.sum(F.when(F.col("role") == "assistant", F.expr("length(content) div 4")).otherwise(0)).alias("tokens"))


@query("""
WITH r AS (SELECT DISTINCT o_custkey, CAST(o_orderkey // 100 AS BIGINT) AS s, CAST(o_orderkey // 100 + 40 AS BIGINT) AS e FROM orders),
m AS (SELECT *, max(e) OVER (PARTITION BY o_custkey ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS i FROM m)
SELECT o_custkey, min(s) AS s, max(e) AS e FROM i GROUP BY o_custkey, i""")
def w19_range_merge(spark, sf_dir):
    at = F.expr("o_orderkey div 100")
    return C.merge_ranges(table(spark, sf_dir, "orders").select("o_custkey", at.alias("s"), (at + 40).alias("e")), "o_custkey", "s", "e")


_SAMPLES = f"""
WITH sup AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS invocation FROM conversations WHERE role = 'assistant'),
held AS (SELECT *, coalesce(list(text) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), []) AS h FROM sup WHERE length(text) > 40),
asked AS (SELECT conv_id, turn, invocation, text, CASE WHEN len(h) > 0 THEN chr(10) || chr(10) || '## Previous Supervisor Feedback History:' || chr(10) || array_to_string(list_transform(h, lambda x, i: chr(10) || '### Feedback #' || CAST(i AS VARCHAR) || ':' || chr(10) || x || chr(10)), '') ELSE '' END || chr(10) || chr(10) || '{PROMPT}' AS ask FROM held),
raw AS (SELECT a.conv_id, a.invocation, c.turn AS p, c.role, c.text AS content FROM asked a JOIN conversations c ON c.conv_id = a.conv_id AND c.turn < a.turn AND c.role <> 'assistant'
  UNION ALL SELECT conv_id, invocation, 100000, 'user', ask FROM asked UNION ALL SELECT conv_id, invocation, 100001, 'assistant', text FROM asked),
s AS (SELECT *, CASE WHEN role = lag(role) OVER w AND role <> 'system' THEN 0 ELSE 1 END AS new FROM raw WINDOW w AS (PARTITION BY conv_id, invocation ORDER BY p)),
i AS (SELECT *, sum(new) OVER (PARTITION BY conv_id, invocation ORDER BY p ROWS UNBOUNDED PRECEDING) - 1 AS pos FROM s),
m AS (SELECT conv_id, invocation, pos, any_value(role) AS role, string_agg(content, chr(10) || chr(10) ORDER BY p) AS content FROM i GROUP BY ALL)"""


@query(_SAMPLES + 'SELECT conv_id, CAST(invocation AS INTEGER) AS invocation, CAST(pos AS INTEGER) AS "at", role, content FROM m')
def c1_samples(spark, sf_dir):
    m = _messages(spark, sf_dir)
    s = C.samples(m, "conv_id", "turn", "role", "content", F.col("role") == "assistant", F.length("content") > 40, PROMPT)
    return s.select("conv_id", "invocation", F.posexplode("messages").alias("at", "m")).select("conv_id", "invocation", "at", "m.role", "m.content")


@query(_SAMPLES + """SELECT conv_id, CAST(invocation AS INTEGER) AS invocation, coalesce(any_value(content) FILTER (pos = 0 AND role = 'system'), '') AS system,
string_agg('[USER/ENVIRONMENT]: ' || content, chr(10) || chr(10) ORDER BY pos) FILTER (pos > 0 AND role <> 'assistant') AS "user", any_value(content) FILTER (role = 'assistant') AS assistant FROM m GROUP BY conv_id, invocation
""")
def c3_flattened_samples(spark, sf_dir):
    m = _messages(spark, sf_dir)
    s = C.samples(m, "conv_id", "turn", "role", "content", F.col("role") == "assistant", F.length("content") > 40, PROMPT)
    f = s.withColumn("f", C.flattened(F.col("messages")))
    user = F.nullif(F.get("f", 1)["content"], F.lit(""))
    return f.select("conv_id", "invocation", F.get("f", 0)["content"].alias("system"), user.alias("user"), F.get("f", 2)["content"].alias("assistant"))


@query("""
WITH m AS (SELECT conv_id, turn, length(text) // 4 AS size, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, count(*) OVER w AS n, sum(length(text) // 4) OVER w AS total FROM conversations WINDOW w AS (PARTITION BY conv_id)),
f AS (SELECT *, pos < 2 OR pos >= n - 2 AS fixed FROM m),
r AS (SELECT *, greatest(60, 260 - 100 - sum(CASE WHEN fixed THEN size ELSE 0 END) OVER (PARTITION BY conv_id)) AS room, CASE WHEN NOT fixed THEN (pos - 2) // 2 END AS pair FROM f),
p AS (SELECT conv_id, pair, sum(sum(size)) OVER (PARTITION BY conv_id ORDER BY pair DESC) AS used FROM r WHERE pair IS NOT NULL GROUP BY conv_id, pair),
k AS (SELECT r.*, fixed OR total <= 260 OR used <= room AS kept FROM r LEFT JOIN p ON r.conv_id = p.conv_id AND r.pair = p.pair)
SELECT conv_id, count(*) FILTER (kept) AS n_kept, CAST(count(DISTINCT pair) FILTER (NOT kept) AS INTEGER) AS dropped_pairs, count(*) FILTER (NOT kept) AS dropped_messages FROM k GROUP BY conv_id""")
def c6_truncate(spark, sf_dir):
    m = _messages(spark, sf_dir).withColumn("size", F.expr("length(content) div 4"))
    t = C.truncate_pairs(m, "conv_id", "turn", "role", "content", "size", 260, floor=60)
    return t.groupBy("conv_id").agg(F.count_if("kept").alias("n_kept"), F.max("dropped_pairs").alias("dropped_pairs"), F.count_if(~F.col("kept")).alias("dropped_messages"))


@query("""
SELECT conv_id, turn, id_rank <= floor(n * 0.8) AS is_train FROM conversations JOIN (SELECT conv_id, row_number() OVER (ORDER BY conv_id) AS id_rank, count(*) OVER () AS n FROM (SELECT DISTINCT conv_id FROM conversations)) USING (conv_id)""")
def o7_group_split(spark, sf_dir):
    return R.group_split(_messages(spark, sf_dir), "conv_id", 0.8).select("conv_id", "turn", "is_train")


@query("SELECT CAST(sum(length(text) // 4) AS BIGINT) AS tokens, count(DISTINCT conv_id) AS n, CAST(sum(length(text) // 4) // count(DISTINCT conv_id) AS BIGINT) AS mean_tokens FROM conversations")
def a33_approximate_tokens(spark, sf_dir):
    t = F.sum(F.expr("length(content) div 4"))
    return _messages(spark, sf_dir).agg(t.alias("tokens"), F.count_distinct("conv_id").alias("n")).select("tokens", "n", F.expr("tokens div n").alias("mean_tokens"))


@query("SELECT n_invocations, count(*) AS n FROM (SELECT conv_id, count(*) FILTER (role = 'assistant') AS n_invocations FROM conversations GROUP BY conv_id) GROUP BY n_invocations")
def a17_invocation_histogram(spark, sf_dir):
    per = _messages(spark, sf_dir).groupBy("conv_id").agg(F.count_if(F.col("role") == "assistant").alias("n_invocations"))
    return per.groupBy("n_invocations").agg(F.count("*").alias("n"))


@query("SELECT conv_id, arg_min(text, (length(text), turn)) AS content, arg_min(turn, (length(text), turn)) AS turn FROM conversations WHERE role = 'assistant' GROUP BY conv_id")
def o6_shortest_of_n(spark, sf_dir):
    return R.shortest(_messages(spark, sf_dir).filter("role = 'assistant'"), "conv_id", "content", "turn")


@query("""
SELECT conv_id, bool_and(role = CASE WHEN pos % 2 = 0 THEN 'user' ELSE 'assistant' END) AS alternates FROM (SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos FROM conversations WHERE role <> 'system') GROUP BY conv_id""")
def p18_role_pattern(spark, sf_dir):
    from pyspark.sql import Window

    m = _messages(spark, sf_dir).filter("role <> 'system'")
    at = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    return m.withColumn("at", at).groupBy("conv_id").agg(F.bool_and(F.col("role") == F.when(F.col("at") % 2 == 0, "user").otherwise("assistant")).alias("alternates"))
