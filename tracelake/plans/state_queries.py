"""Queries that keep state between runs: tables changed in place, streams that go on, windows of event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.operators import sequential, training_set
from tracelake.plans import shaping_queries  # noqa: F401  its SQL of the loop is used here
from tracelake.plans.conversation_queries import _SAMPLES, PROMPT
from tracelake.plans.registry import ORACLES, query, table
from tracelake.sources import scratch, sinks
from tracelake.sources.keyed import KeyedTable
from tracelake.streaming import incremental

_TIME = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def _cents():
    return F.round(F.col("value") * 100).cast("long")


def _shown(windows: DataFrame) -> DataFrame:
    """Times as texts, whatever the session's time zone."""
    return windows.withColumns({c: F.date_format(c, _TIME) for c in ("start", "end")})


@query("""WITH w AS (SELECT event_type, CAST(round(value * 100) AS BIGINT) AS v, unnest([time_bucket(INTERVAL 15 MINUTES, ts) - to_minutes(15 * k) for k in range(4)]) AS s FROM events)
SELECT strftime(s, '%Y-%m-%d %H:%M:%S.%f') AS start, strftime(s + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S.%f') AS "end", event_type, count(*) AS n, CAST(sum(v) AS BIGINT) AS total FROM w GROUP BY s, event_type""")
def x1_sliding_windows(spark, sf_dir):
    """Windows of an hour that begin every quarter."""
    return _shown(incremental.windowed_counts(table(spark, sf_dir, "events"), "ts", ["event_type"], "1 hour", "10 minutes", _cents(), "15 minutes"))


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 12 HOURS THEN 0 ELSE 1 END AS new_ FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(new_) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS start, strftime(max(ts) + INTERVAL 12 HOURS, '%Y-%m-%d %H:%M:%S.%f') AS "end", user_id, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS total FROM s GROUP BY user_id, s""")
def x1_sessions(spark, sf_dir):
    """A user's events that follow one another by half a day at most."""
    return _shown(incremental.sessions(table(spark, sf_dir, "events"), "ts", ["user_id"], "12 hours", "10 minutes", _cents()))


@query("""WITH n AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE c_mktsegment END AS v FROM customer UNION ALL SELECT 1000000 + c_custkey, 'added' FROM customer WHERE c_custkey % 3 = 0)
SELECT k, v FROM n WHERE k % 5 <> 0""")
def k10_keyed_table(spark, sf_dir):
    """A table by hash buckets; changes with several rows a key, one batch given twice, and keys that go."""
    now = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("v"))
    held = KeyedTable(spark, scratch.folder(spark, "keyed"), "k long, v string", "k", buckets=16)
    held.upsert(now)
    some = now.filter("k % 3 = 0").select("k")
    changes = some.select("k", F.lit("old").alias("v"), F.lit(1).alias("at")).union(some.select("k", F.lit("new"), F.lit(2))).union(some.select(F.col("k") + 1_000_000, F.lit("added"), F.lit(1)))
    held.upsert(changes, "at", stream="changes", batch=0)
    assert held.upsert(now, stream="changes", batch=0) == []  # that batch is in
    held.delete(held.rows().filter("k % 5 = 0"))
    return held.rows()


@query("SELECT user_id, event_type = 'click' AS is_click, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY ALL")
def x3_counted_once(spark, sf_dir):
    """Counters of a folder that grows; every batch is given to the table twice and counts once."""
    root = scratch.folder(spark, "counted")
    e = table(spark, sf_dir, "events").select(F.concat_ws(":", "user_id", F.col("event_type") == "click").alias("k"), F.lit(1).cast("long").alias("n"), _cents().alias("total"))
    held = KeyedTable(spark, f"{root}/table", "k string, n long, total long", "k", buckets=8)

    def twice(batch: DataFrame, number: int) -> None:
        for _ in range(2):
            incremental.into(held, "events", kind="add")(batch, number)

    for part in (e.filter("total % 2 = 0"), e.filter("total % 2 <> 0")):
        part.write.mode("append").json(f"{root}/in")
        incremental.upsert_each(incremental.growing(spark, f"{root}/in", "k string, n long, total long"), twice, f"{root}/progress").awaitTermination()
    part = F.split("k", ":")
    return held.rows().select(F.get(part, 0).cast("long").alias("user_id"), F.get(part, 1).cast("boolean").alias("is_click"), "n", "total")


@query(ORACLES["x4_supervised"])
def x4_supervised_stream(spark, sf_dir):
    """The loop in two runs of a stream, each over the messages that have come since; the state of the first is what the second begins with."""
    root = scratch.folder(spark, "loop")
    m = table(spark, sf_dir, "embeddings").select("label", "vec_id", "embedding", (F.col("vec_id") % 4 != 0).alias("is_step"))
    middle = m.agg(F.expr("max(vec_id) div 2").alias("x"))
    for side in ("vec_id <= x", "vec_id > x"):
        m.crossJoin(F.broadcast(middle)).filter(side).drop("x").write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(m.schema).parquet(f"{root}/in")
        rows = sequential.supervised_stream(stream, "label", "vec_id", "is_step", "embedding", 3, 0.1)
        rows.writeStream.option("checkpointLocation", f"{root}/progress").trigger(availableNow=True).start(f"{root}/out").awaitTermination()
    return spark.read.parquet(f"{root}/out").select("label", "vec_id", "steps", "asked", "suppressed", "active", "history")


_SAID = "cx AS (SELECT conv_id, turn, role, CASE WHEN role = 'assistant' AND length(text) > 40 THEN text || ' DETECTED: No TASK_STATUS: On track' ELSE text END AS text FROM conversations WHERE conv_id % 10 <> 7 AND conv_id % 4 <> 1)"
_CX = _SAMPLES.replace("FROM conversations WHERE role", "FROM cx WHERE role").replace("JOIN conversations c", "JOIN cx c").replace("WHERE length(text) > 40", "WHERE contains(text, 'TASK_STATUS')").replace("WITH sup", f"WITH {_SAID}, sup", 1)


@query(_CX + """, k AS (SELECT conv_id, row_number() OVER (ORDER BY CAST(conv_id AS VARCHAR)) <= floor(count(*) OVER () * 0.8) AS is_train FROM (SELECT DISTINCT conv_id FROM m))
SELECT is_train, count(DISTINCT conv_id || ':' || invocation) AS n_samples, count(*) AS n_messages, CAST(sum(length(content)) AS BIGINT) AS n_chars, count(DISTINCT conv_id) AS n_ids, (SELECT count(DISTINCT conv_id) FROM conversations WHERE conv_id % 10 = 7) AS errors, CAST((SELECT sum(length(content) // 4) FROM m) AS BIGINT) AS approximate_tokens FROM m JOIN k USING (conv_id) GROUP BY is_train""")
def f1_training_set(spark, sf_dir):
    """Run folders to a set with sidecars in one call: trajectories of ids of 7 modulo 10 are broken, of 1 modulo 4 not resolved."""
    root, sup = scratch.folder(spark, "f1"), F.col("role") == "assistant"
    content = F.when(sup & (F.length("text") > 40), F.concat("text", F.lit(" DETECTED: No TASK_STATUS: On track"))).otherwise(F.col("text"))
    said = F.array_sort(F.collect_list(F.struct("turn", "role", content.alias("content"), sup.alias("_supervisor"))))
    one = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").cast("string").alias("instance_id")).agg(said.alias("messages"))
    text = F.to_json(F.struct("instance_id", "messages"))
    sinks.trajectory_files(one.select(F.col("instance_id").alias("name"), F.when(F.col("instance_id") % 10 == 7, F.left(text, F.length(text) - 5)).otherwise(text).alias("text")), f"{root}/run")
    facts = training_set.build(spark, f"{root}/run", f"{root}/set", PROMPT, one.filter("instance_id % 4 <> 1").select("instance_id"), "plain", 0.8)
    out = None
    for name in ("train", "val"):
        if facts[name]:
            messages = spark.read.json(f"{root}/set/sft_{name}").select(F.explode("messages").alias("m"))
            ids = spark.read.text(f"{root}/set/{name}_ids").agg(F.count("*").alias("n_ids"))
            part = messages.agg(F.count("*").alias("n_messages"), F.sum(F.length("m.content")).alias("n_chars")).crossJoin(F.broadcast(ids))
            part = part.select(F.lit(name == "train").alias("is_train"), F.lit(facts[name]).alias("n_samples"), "n_messages", "n_chars", "n_ids", F.lit(facts["errors"]).alias("errors"), F.lit(facts["approximate_tokens"]).alias("approximate_tokens"))
            out = part if out is None else out.unionByName(part)
    return out
