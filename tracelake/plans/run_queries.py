"""Queries over runs: orders stand for runs, customers for instances, nations for agents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.operators import runs as R
from tracelake.plans.registry import query, table


def _runs(spark, sf_dir) -> DataFrame:
    """A run per order, with cents as cost, so that sums do not depend on their order."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return o.select(
        F.col("o_custkey").alias("instance"), k.alias("run"), F.when(k % 3 == 0, "LimitsExceeded").otherwise(R.SUBMITTED).alias("exit_status"),
        (k % 5 < 2).alias("resolved"), (k % 40 + 1).cast("long").alias("steps"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cost"),
    )


_RUNS = "runs AS (SELECT o_custkey AS instance, o_orderkey AS run, CASE WHEN o_orderkey % 3 = 0 THEN 'LimitsExceeded' ELSE 'Submitted' END AS exit_status, o_orderkey % 5 < 2 AS resolved, CAST(o_orderkey % 40 + 1 AS BIGINT) AS steps, CAST(round(o_totalprice * 100) AS BIGINT) AS cost FROM orders)"


def _sides(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Each instance's first order is the critic's run, its last is the base run (if it is another)."""
    from pyspark.sql import Window

    r = _runs(spark, sf_dir)
    w = Window.partitionBy("instance")
    r = r.withColumn("lo", F.min("run").over(w)).withColumn("hi", F.max("run").over(w))
    return r.filter("run = lo").drop("lo", "hi", "run"), r.filter("run = hi and hi <> lo").drop("lo", "hi", "run")


_SIDES = _RUNS + """, x AS (SELECT *, min(run) OVER w AS lo, max(run) OVER w AS hi FROM runs WINDOW w AS (PARTITION BY instance)), j AS (SELECT c.instance, c.exit_status, c.resolved, c.steps, c.cost, b.exit_status AS be, b.resolved AS br, b.steps AS bs, b.cost AS bc
FROM (SELECT * FROM x WHERE run = lo) c LEFT JOIN (SELECT * FROM x WHERE run = hi AND hi <> lo) b ON b.instance = c.instance)"""
_FALLBACK = f"""WITH {_SIDES} SELECT instance, CASE WHEN exit_status = 'Submitted' OR br IS NULL THEN exit_status ELSE be END AS exit_status, {{resolved}} AS resolved,
steps + CASE WHEN exit_status = 'Submitted' THEN 0 ELSE coalesce(bs, 0) END AS steps, cost + CASE WHEN exit_status = 'Submitted' THEN 0 ELSE coalesce(bc, 0) END AS cost, exit_status <> 'Submitted' AND br IS NOT NULL AS used_base FROM j"""


@query(_FALLBACK.format(resolved="CASE WHEN exit_status = 'Submitted' THEN resolved ELSE coalesce(br, false) END"))
def j8_fallback_full(spark, sf_dir):
    return R.with_fallback(*_sides(spark, sf_dir), mode="full")


@query(_FALLBACK.format(resolved="resolved OR (exit_status <> 'Submitted' AND coalesce(br, false))"))
def j9_fallback_mini(spark, sf_dir):
    return R.with_fallback(*_sides(spark, sf_dir), mode="mini")


@query(_FALLBACK.format(resolved="CASE WHEN exit_status = 'Submitted' OR br IS NULL THEN resolved ELSE coalesce(br, false) END"))
def j10_fallback_additive(spark, sf_dir):
    return R.with_fallback(*_sides(spark, sf_dir), mode="additive")


@query("""
WITH c AS (SELECT l_orderkey AS run, count(b) > 0 AS is_priced, sum(CAST(l_quantity AS DOUBLE) * 3 + l_linenumber * 2) AS spent FROM lineitem JOIN orders ON o_orderkey = l_orderkey LEFT JOIN (SELECT '1-URGENT' AS b UNION ALL SELECT '5-LOW') ON b = o_orderpriority GROUP BY l_orderkey)
SELECT run, is_priced, CASE WHEN is_priced THEN spent ELSE 7.0 END AS cost FROM c""")
def j11_price_lookup(spark, sf_dir):
    prices = spark.createDataFrame([("1-URGENT", 3.0, 2.0), ("5-LOW", 3.0, 2.0)], "o_orderpriority string, rate_in double, rate_out double")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run"), "o_orderpriority")
    calls = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run"), F.col("l_quantity").cast("double").alias("q"), "l_linenumber").join(o, "run").withColumn("stored", F.lit(7.0))
    return R.priced(calls, prices, "run", "o_orderpriority", "q", "l_linenumber", "stored")


@query(f"""WITH {_RUNS} SELECT instance % 10 AS grp, count(*) FILTER (resolved) AS resolved, count(*) FILTER (exit_status = 'Submitted') AS submitted, round(100 * count(*) FILTER (resolved) / 500, 6) AS resolved_pct,
round(100 * count(*) FILTER (resolved) / nullif(count(*) FILTER (exit_status = 'Submitted'), 0), 6) AS resolved_of_submitted_pct, round(CAST(sum(steps) AS BIGINT) / 500, 6) AS avg_steps, round(CAST(sum(cost) AS BIGINT) / 500, 6) AS avg_cost FROM runs GROUP BY instance % 10""")
def a24_fixed_denominator(spark, sf_dir):
    return R.run_table(_runs(spark, sf_dir).withColumn("grp", F.col("instance") % 10), ["grp"], 500)


@query(f"WITH {_RUNS} SELECT instance, bool_or(resolved) AS resolved, bool_or(exit_status = 'Submitted') AS submitted, CAST(sum(steps) AS BIGINT) AS steps, CAST(sum(cost) AS BIGINT) AS cost FROM runs GROUP BY instance")
def a29_best_of_n(spark, sf_dir):
    return R.best_of_n(_runs(spark, sf_dir), ["instance"])


def _points(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("instance"), "c_nationkey")
    return _runs(spark, sf_dir).join(c, "instance").groupBy(F.col("c_nationkey").alias("agent"), "instance").agg(F.sum("cost").alias("cost"), F.count_if("resolved").alias("resolved"))


_POINTS = _RUNS + ", points AS (SELECT c_nationkey AS agent, instance, CAST(sum(cost) AS BIGINT) AS cost, count(*) FILTER (resolved) AS resolved FROM runs JOIN customer ON c_custkey = instance GROUP BY ALL)"


@query(f"""WITH {_POINTS} SELECT agent, instance, cost, resolved FROM (SELECT *, max(resolved) OVER (PARTITION BY agent ORDER BY cost, resolved DESC, instance ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM points) WHERE best IS NULL OR resolved > best""")
def w8_pareto_frontier(spark, sf_dir):
    return R.pareto(_points(spark, sf_dir), "agent", "instance", "cost", "resolved").select("agent", "instance", "cost", "resolved")


@query(f"""WITH {_POINTS} SELECT agent, instance, cost, resolved FROM (SELECT *, max(resolved) OVER (ORDER BY cost, resolved DESC, instance ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM points) WHERE best IS NULL OR resolved > best""")
def w8_global_frontier(spark, sf_dir):
    """All agents' points on one frontier."""
    return R.pareto(_points(spark, sf_dir), None, "instance", "cost", "resolved").select("agent", "instance", "cost", "resolved")


@query(f"""WITH {_RUNS}, r AS (SELECT run, cost, CAST(sum(cost) OVER w AS BIGINT) AS spent, count(*) OVER w AS n_calls FROM runs WINDOW w AS (ORDER BY run ROWS UNBOUNDED PRECEDING))
SELECT run, cost, spent, n_calls, spent > 2000000000 OR n_calls >= 12000 AS exceeded FROM r""")
def a37_global_limits(spark, sf_dir):
    """One account for all runs in order of key: a limit of cost and one of calls, checked after each is added."""
    return R.budgeted(_runs(spark, sf_dir).select("run", "cost"), [F.asc("run")], "cost", 2_000_000_000, 12_000)


@query(f"WITH {_POINTS} SELECT agent, instance, resolved, cost FROM (SELECT *, row_number() OVER (PARTITION BY agent ORDER BY resolved DESC, cost, instance DESC) AS r FROM points) WHERE r = 1")
def a32_best_variant(spark, sf_dir):
    return R.best_variant(_points(spark, sf_dir), "agent", "resolved", "cost", "instance")


@query(f"""WITH {_RUNS}, c AS (SELECT exit_status, steps, count(*) AS n FROM runs WHERE resolved GROUP BY ALL)
SELECT exit_status, steps, CAST(sum(n) OVER w AS BIGINT) AS resolved, round(100 * CAST(sum(n) OVER w AS BIGINT) / CAST(sum(n) OVER (PARTITION BY exit_status) AS BIGINT), 6) AS pct FROM c WINDOW w AS (PARTITION BY exit_status ORDER BY steps ROWS UNBOUNDED PRECEDING)""")
def w7_step_curve(spark, sf_dir):
    return R.step_curve(_runs(spark, sf_dir).filter("resolved"), "exit_status", "steps")


@query(f"WITH {_RUNS} SELECT exit_status, threshold, count(*) FILTER (steps <= threshold) AS n FROM runs, (VALUES (5), (10), (20), (40)) t(threshold) GROUP BY ALL")
def a31_cdf_thresholds(spark, sf_dir):
    return R.at_thresholds(_runs(spark, sf_dir), "exit_status", "steps", (5, 10, 20, 40))


@query(f"WITH {_RUNS} SELECT exit_status, count(*) AS n, min(run) AS first_run FROM runs GROUP BY exit_status")
def a39_by_exit_status(spark, sf_dir):
    return _runs(spark, sf_dir).groupBy("exit_status").agg(F.count("*").alias("n"), F.min("run").alias("first_run"))


@query("SELECT c_custkey, c_nationkey FROM (SELECT c_custkey, c_nationkey, row_number() OVER (ORDER BY c_custkey) - 1 AS pos, count(*) OVER () AS n FROM customer) WHERE pos >= greatest(n - 60, 0) AND pos < greatest(n - 10, 0) AND (pos - greatest(n - 60, 0)) % 7 = 0")
def o2_slice(spark, sf_dir):
    """customers[-60:-10:7] in order of key."""
    return R.python_slice(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_custkey", -60, -10, 7)


@query("SELECT 'customer' AS src, c_nationkey AS nation, count(*) AS n FROM customer GROUP BY ALL UNION ALL SELECT 'supplier', s_nationkey, count(*) FROM supplier GROUP BY ALL")
def u1_union(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.lit("customer").alias("src"), F.col("c_nationkey").alias("nation"))
    return c.unionByName(table(spark, sf_dir, "supplier").select(F.lit("supplier").alias("src"), F.col("s_nationkey").alias("nation"))).groupBy("src", "nation").agg(F.count("*").alias("n"))


@query("SELECT o_custkey AS k FROM orders WHERE o_orderkey % 2 = 0 INTERSECT SELECT o_custkey FROM orders WHERE o_orderkey % 2 = 1")
def u2_intersect(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.filter("o_orderkey % 2 = 0").select(F.col("o_custkey").alias("k")).intersect(o.filter("o_orderkey % 2 = 1").select("o_custkey"))


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
def u3_except(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")).exceptAll(table(spark, sf_dir, "orders").select("o_custkey").distinct())


@query("SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE c_mktsegment END AS v FROM customer UNION ALL SELECT 1000000 + c_custkey, 'new' FROM customer WHERE c_custkey % 3 = 0")
def k10_upsert(spark, sf_dir):
    now = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("v"))
    some = now.filter("k % 3 = 0").select("k")
    changes = some.select("k", F.lit("old").alias("v"), F.lit(1).alias("at")).union(some.select("k", F.lit("new"), F.lit(2))).union(some.select(F.col("k") + 1_000_000, F.lit("new"), F.lit(1)))
    return R.upsert(now, changes, "k", "at")
