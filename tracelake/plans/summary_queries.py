"""Further queries: format compliance, on-track behaviour, localization, combined tables, splits of budgets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracelake.functions import text as T
from tracelake.operators import conversations as C
from tracelake.operators import metrics as M
from tracelake.operators import runs as R
from tracelake.plans.metric_queries import _detections, _severities
from tracelake.plans.registry import query, table
from tracelake.plans.run_queries import _FALLBACK, _RUNS, _runs, _sides


@query("SELECT lang, coalesce(CASE n_chars % 5 WHEN 0 THEN 'On track' WHEN 1 THEN 'Needs correction' WHEN 2 THEN 'Critical intervention required' END, 'Unparseable') AS status, count(*) AS n FROM documents GROUP BY ALL")
def a11_status_distribution(spark, sf_dir):
    names = F.array(*map(F.lit, T.STATUSES))
    s = _severities(spark, sf_dir).withColumn("status", F.coalesce(F.get(names, F.col("pred")), F.lit("Unparseable")))
    return s.groupBy("lang", "status").agg(F.count("*").alias("n"))


@query("SELECT count(*) FILTER (k = 12) AS full_, count(*) FILTER (k BETWEEN 1 AND 11) AS partial, count(*) FILTER (k = 0) AS none, count(*) FILTER (doc_id % 4 = 0) AS no_status FROM (SELECT doc_id, doc_id % 13 AS k FROM labels)")
def a12_format_compliance(spark, sf_dir):
    """Answers with the first k of twelve categories, of which every fourth has no status."""
    k = F.col("doc_id") % 13
    lines = [F.when(k > i, F.lit(f"{i + 1}. {c}: DETECTED: No\n")).otherwise("") for i, c in enumerate(T.CATEGORIES)]
    a = table(spark, sf_dir, "labels").select(F.concat(*lines, F.when(F.col("doc_id") % 4 == 0, "").otherwise("TASK_STATUS: On track")).alias("a"))
    n = F.size(T.numbered_detections(F.col("a")))
    return a.agg(F.count_if(n == 12).alias("full_"), F.count_if(n.between(1, 11)).alias("partial"), F.count_if(n == 0).alias("none"), F.count_if(T.task_status(F.col("a")).isNull()).alias("no_status"))


@query("""SELECT lang, count(*) AS n, count(*) FILTER (pred = 0) AS says_on_track, round(coalesce(100 * count(*) FILTER (pred > 0) / count(*), 0), 6) AS intervened_pct
FROM (SELECT lang, CASE WHEN n_chars % 5 < 3 THEN n_chars % 5 END AS pred FROM documents WHERE doc_id % 7 = 0) GROUP BY lang""")
def a14_on_track_behaviour(spark, sf_dir):
    s = _severities(spark, sf_dir).filter("gt = 0")
    return s.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("pred") == 0).alias("says_on_track"), F.round(M.rate(100 * F.count_if(F.col("pred") > 0), F.count("*")), 6).alias("intervened_pct"))


@query("SELECT lang, round(100 * (avg(n_chars) - (SELECT avg(n_chars) FROM documents)) / (SELECT avg(n_chars) FROM documents), 6) AS delta_pct FROM documents GROUP BY lang")
def a16_length_delta(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    whole = d.agg(F.avg("n_chars").alias("w"))
    return d.groupBy("lang").agg(F.avg("n_chars").alias("m")).crossJoin(F.broadcast(whole)).select("lang", F.round(100 * (F.col("m") - F.col("w")) / F.col("w"), 6).alias("delta_pct"))


@query(r"""WITH p AS (SELECT page_id, regexp_extract(url, '^https?://[^/]*/([^?#]*)', 1) AS path FROM pages)
SELECT count(*) FILTER (page_id % 3 = 0) AS localized, count(*) AS n, round(100 * count(*) FILTER (page_id % 3 = 0) / count(*), 6) AS pct FROM p WHERE path <> ''""")
def a26_localization(spark, sf_dir):
    """A model's patch touches the gold file for every third page."""
    p = table(spark, sf_dir, "pages").withColumn("path", F.regexp_extract("url", r"^https?://[^/]*/([^?#]*)", 1)).filter("path <> ''")
    patch = lambda f: F.concat(F.lit("diff --git a/"), f, F.lit(" b/"), f, F.lit("\n"))
    own = patch(F.when(F.col("page_id") % 3 == 0, F.col("path")).otherwise(F.concat("path", F.lit("_other"))))
    hit = F.arrays_overlap(T.files_in_patch(own), T.files_in_patch(patch(F.col("path"))))
    return p.agg(F.count_if(hit).alias("localized"), F.count("*").alias("n"), F.round(M.rate(100 * F.count_if(hit), F.count("*")), 6).alias("pct"))


@query("""WITH p AS (SELECT page_id, page_id % 4 AS model, list_transform(range(0, page_id % 3 + 1), lambda j: (length(url) + 2 * j) % 5) AS own, [page_id % 5, (page_id + 2) % 5] AS gold FROM pages)
SELECT model, count(*) FILTER (list_has_any(own, gold)) AS localized, count(*) AS n FROM p WHERE page_id % 7 <> 0 GROUP BY model""")
def a26_overlaps(spark, sf_dir):
    """Patches of one to three files against gold patches of two; a seventh has no gold patch."""
    p = table(spark, sf_dir, "pages").select(F.col("page_id").alias("instance_id"), (F.col("page_id") % 4).alias("model"), F.length("url").alias("n"))
    section = lambda k: F.concat(F.lit("diff --git a/src/f"), (k % 5).cast("string"), F.lit(".py b/src/f"), (k % 5).cast("string"), F.lit(".py\n@@ -1 +1 @@\n+x\n"))
    own = F.array_join(F.transform(F.sequence(F.lit(0), (F.col("instance_id") % 3).cast("int")), lambda j: section(F.col("n") + 2 * j)), "")
    made = p.select("instance_id", "model", own.alias("model_patch"))
    gold = p.filter("instance_id % 7 <> 0").select("instance_id", F.concat(section(F.col("instance_id")), section(F.col("instance_id") + 2)).alias("gold_patch"))
    return R.localization(made, gold, ["model"])


_COMBINED = _FALLBACK.format(resolved="CASE WHEN exit_status = 'Submitted' THEN resolved ELSE coalesce(br, false) END").replace("WITH ", "", 1)


@query(f"""WITH {_COMBINED.rsplit("SELECT instance,", 1)[0]}, c AS (SELECT instance,{_COMBINED.rsplit("SELECT instance,", 1)[1]}), both_ AS (SELECT 'critic' AS row_kind, resolved, steps, cost FROM j UNION ALL SELECT 'critic + base', resolved, steps, cost FROM c)
SELECT row_kind, count(*) FILTER (resolved) AS resolved, CAST(sum(steps) AS BIGINT) AS steps, CAST(sum(cost) AS BIGINT) AS cost FROM both_ GROUP BY row_kind""")
def a28_combined_rows(spark, sf_dir):
    """The plain row and the one with fallback under one another."""
    critic, base = _sides(spark, sf_dir)
    rows = critic.withColumn("row_kind", F.lit("critic")).unionByName(R.with_fallback(critic, base).drop("used_base").withColumn("row_kind", F.lit("critic + base")))
    return rows.groupBy("row_kind").agg(F.count_if("resolved").alias("resolved"), F.sum("steps").alias("steps"), F.sum("cost").alias("cost"))


@query(f"WITH {_RUNS}, r AS (SELECT instance, run, sum(cost) OVER (PARTITION BY instance ORDER BY run ROWS UNBOUNDED PRECEDING) AS spent, cost FROM runs) SELECT instance, run, CAST(spent AS BIGINT) AS spent FROM r WHERE spent > 50000000 AND spent - cost <= 50000000")
def a37_limit_reached(spark, sf_dir):
    """The run after which an instance's spending first exceeds its limit."""
    w = Window.partitionBy("instance").orderBy("run").rowsBetween(Window.unboundedPreceding, 0)
    r = _runs(spark, sf_dir).withColumn("spent", F.sum("cost").over(w))
    return r.filter((F.col("spent") > 50_000_000) & (F.col("spent") - F.col("cost") <= 50_000_000)).select("instance", "run", "spent")


_BOTH = f"""{_COMBINED.rsplit("SELECT instance,", 1)[0]}, c AS (SELECT instance,{_COMBINED.rsplit("SELECT instance,", 1)[1]}), parts AS (SELECT instance, resolved, steps, cost, 'critic' AS kind FROM j UNION ALL SELECT instance, resolved, steps, cost, 'critic + base' FROM c)"""


def _parts(spark, sf_dir):
    """Runs by tens of instances in the order of a registry: each its own, then with the base run's result."""
    critic, base = _sides(spark, sf_dir)
    both = {"critic": critic, "critic + base": R.with_fallback(critic, base)}
    return [(f"setting {k}", kind, rows.filter(F.col("instance") % 3 == k)) for k in (2, 0, 1) for kind, rows in both.items()]


def _totals(runs):
    return runs.agg(F.count_if("resolved").alias("resolved"), F.sum("steps").alias("steps"), F.sum("cost").alias("cost"))


@query(f"""WITH {_BOTH} SELECT CAST(CASE instance % 3 WHEN 2 THEN 0 WHEN 0 THEN 2 ELSE 4 END + CASE WHEN kind = 'critic' THEN 0 ELSE 1 END AS INTEGER) AS at, 'setting ' || instance % 3 AS label, kind, count(*) FILTER (resolved) AS resolved, CAST(sum(steps) AS BIGINT) AS steps, CAST(sum(cost) AS BIGINT) AS cost FROM parts GROUP BY ALL""")
def u5_registry_order(spark, sf_dir):
    """Plain rows and rows with fallback of each setting, with their places in the registry."""
    return R.stacked(_parts(spark, sf_dir), _totals)


@query(f"""WITH {_BOTH}, t AS (SELECT 'setting ' || instance % 3 AS label, kind, count(*) FILTER (resolved) AS resolved, CAST(sum(cost) AS BIGINT) AS cost FROM parts GROUP BY ALL)
SELECT a.label, a.resolved, a.cost, b.resolved AS resolved_combined, b.cost AS cost_combined, b.resolved - a.resolved AS resolved_gain, b.cost - a.cost AS cost_gain FROM t a JOIN t b ON b.label = a.label AND a.kind = 'critic' AND b.kind <> 'critic'""")
def j21_paired_rows(spark, sf_dir):
    return R.paired(R.stacked(_parts(spark, sf_dir), _totals), "label", "kind", "critic", "critic + base", ["resolved", "cost"])


@query(f"""WITH {_RUNS} SELECT exit_status AS prompt, NULL AS "0", count(*) FILTER (resolved AND run % 3 = 1) AS "1", count(*) FILTER (resolved AND run % 3 = 2) AS "2" FROM runs WHERE exit_status = 'Submitted' GROUP BY exit_status
UNION ALL SELECT exit_status, count(*) FILTER (resolved AND run % 3 = 0), NULL, NULL FROM runs WHERE exit_status <> 'Submitted' GROUP BY exit_status""")
def j21_matrix(spark, sf_dir):
    """Prompts by settings; runs that reached their limit are all of one setting."""
    points = _runs(spark, sf_dir).groupBy(F.col("exit_status").alias("prompt"), (F.col("run") % 3).alias("k")).agg(F.count_if("resolved").alias("resolved"))
    return R.matrix(points, "prompt", "k", [0, 1, 2], "resolved")


@query("""WITH f AS (SELECT DISTINCT user_id FROM events ORDER BY user_id LIMIT 10), s AS (SELECT user_id, list_sort(list(event_id)) AS x FROM events WHERE user_id % 4 = 3 AND user_id IN (SELECT user_id FROM f) GROUP BY user_id)
SELECT CASE WHEN len(x) > 1 THEN x[2] - x[1] ELSE x[1] END AS step_interval FROM s ORDER BY user_id LIMIT 1""")
def a36_first_files(spark, sf_dir):
    """The first of ten files that has steps tells the interval; three of four have none."""
    e = table(spark, sf_dir, "events")
    return R.interval(e.select("user_id"), e.filter("user_id % 4 = 3").select("user_id", "event_id"), "user_id", "event_id")


@query("SELECT user_id, CASE WHEN len(x) > 1 THEN x[2] - x[1] ELSE x[1] END AS step_interval FROM (SELECT user_id, list_sort(list(DISTINCT event_id)) AS x FROM events GROUP BY user_id)")
def a36_interval(spark, sf_dir):
    """Difference of the two least steps, or the only one: two minima, not a sorted list."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id").distinct()
    r = e.withColumn("r", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))).filter("r <= 2")
    one, two = (F.max(F.when(F.col("r") == k, F.col("event_id"))) for k in (1, 2))
    return r.groupBy("user_id").agg(F.coalesce(two - one, one).alias("step_interval"))


@query("SELECT d.doc_id, l.toxic, l.quality FROM documents d JOIN labels l USING (doc_id) WHERE d.n_chars > 200 AND l.quality IS NOT NULL")
def j2_complete_pairs(spark, sf_dir):
    l = table(spark, sf_dir, "labels").filter("quality is not null")
    return table(spark, sf_dir, "documents").filter("n_chars > 200").select("doc_id").join(l, "doc_id").select("doc_id", "toxic", "quality")


@query("SELECT doc_id, side, value FROM (SELECT doc_id, unnest(['truth', 'predicted']) AS side, unnest([CASE WHEN quality = 1 THEN toxic = 1 END, CASE WHEN n_chars > 200 THEN n_chars % 4 = 0 END]) AS value FROM documents LEFT JOIN labels USING (doc_id)) WHERE value IS NOT NULL")
def j17_category_fan_out(spark, sf_dir):
    """A map of known values to a row each."""
    m = F.map_from_arrays(F.array(F.lit("truth"), F.lit("predicted")), F.array("truth", "predicted"))
    return _detections(spark, sf_dir).select("doc_id", F.explode(m).alias("side", "value")).filter("value is not null")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type ORDER BY n DESC, event_type LIMIT 3")
def o5_top_groups(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "event_type").limit(3)


@query("SELECT c_custkey, list_sort(list_distinct([c_mktsegment, CAST(c_nationkey AS VARCHAR), c_mktsegment])) AS names FROM customer")
def u6_sorted_distinct(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_sort(F.array_distinct(F.array("c_mktsegment", F.col("c_nationkey").cast("string"), "c_mktsegment"))).alias("names"))


@query("SELECT page_id, 'repo__' || left(md5(url), 12) AS instance_id, lower('img_repo_1776_' || CAST(page_id AS VARCHAR)) || ':latest' AS image FROM pages")
def t19_t20_names(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    image = F.concat(F.lower(F.replace(F.concat(F.lit("IMG_repo__"), F.col("page_id").cast("string")), F.lit("__"), F.lit("_1776_"))), F.lit(":latest"))
    return p.select("page_id", F.concat_ws("__", F.lit("repo"), F.left(F.md5("url"), F.lit(12))).alias("instance_id"), image.alias("image"))


@query("SELECT conv_id, done, total, CASE WHEN done > 0 THEN round(60.0 / done * (total - done), 6) END AS eta FROM (SELECT conv_id, count(*) FILTER (role = 'assistant') AS done, count(*) AS total FROM conversations GROUP BY conv_id)")
def w18_eta(spark, sf_dir):
    g = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count_if(F.col("role") == "assistant").alias("done"), F.count("*").alias("total"))
    return g.withColumn("eta", F.round(F.try_divide(F.lit(60.0), F.col("done")) * (F.col("total") - F.col("done")), 6))


@query("""WITH b AS (SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN 'trajectory' ELSE 'feedback' END AS cat, length(text) // 4 AS size FROM conversations WHERE turn > 0),
t AS (SELECT *, sum(CASE WHEN cat = 'feedback' THEN size ELSE 0 END) OVER (PARTITION BY conv_id) AS fb, sum(CASE WHEN cat = 'trajectory' THEN size ELSE 0 END) OVER (PARTITION BY conv_id) AS tr FROM b),
g AS (SELECT *, CASE WHEN fb + tr <= 200 THEN 1000000000 WHEN cat = 'feedback' THEN CASE WHEN fb <= 60 THEN fb WHEN tr <= 140 THEN 200 - tr ELSE 60 END ELSE CASE WHEN fb <= 60 THEN 200 - fb WHEN tr <= 140 THEN tr ELSE 140 END END AS budget FROM t),
u AS (SELECT *, sum(size) OVER (PARTITION BY conv_id, cat ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS used FROM g)
SELECT conv_id, turn, cat, used <= budget AS kept FROM u""")
def c7_budget_split(spark, sf_dir):
    """Blocks kept when feedback may take three tenths of the room and what one side leaves goes to the other."""
    cat = F.when(F.col("role") == "assistant", "trajectory").otherwise("feedback")
    b = table(spark, sf_dir, "conversations").filter("turn > 0").select("conv_id", "turn", cat.alias("cat"), F.expr("length(text) div 4").alias("size"))
    return C.split_budget(b, "conv_id", "turn", "cat", "size", 200, 0.3)


@query("SELECT conv_id, turn, CASE role WHEN 'assistant' THEN 'trajectory' WHEN 'system' THEN 'task' ELSE 'prompt' END AS cat FROM conversations")
def c5_block_kinds(spark, sf_dir):
    """Blocks of a flattened user message, told by their tags."""
    tag = F.when(F.col("role") == "assistant", "[AGENT RESPONSE]: ").otherwise("[USER/ENVIRONMENT]: ")
    said = F.when(F.col("role") == "user", "Please provide your supervisor feedback now.").otherwise("x")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.block_kind(F.concat(tag, said), F.col("role") == "system").alias("cat"))


@query("SELECT conv_id, turn, CASE WHEN turn >= 4 THEN 'late' ELSE 'early' END AS stage, CASE WHEN length(text) > 100 THEN left(text, 100) || '...' ELSE text END AS shown FROM conversations")
def t13_shown_history(spark, sf_dir):
    cut = F.when(F.length("text") > 100, F.concat(F.left("text", F.lit(100)), F.lit("..."))).otherwise(F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("turn") >= 4, "late").otherwise("early").alias("stage"), cut.alias("shown"))
