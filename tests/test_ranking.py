"""Running sums and extremes, ranks and quantiles against plain Python, with ties, hot groups and nulls."""

import random
from itertools import accumulate

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelake.operators import metrics as M
from tracelake.operators import ranking
from tracelake.operators import runs as R


def rows_of(n, seed=1):
    """(group, id, value): half of all rows in one group, many equal values, some nulls."""
    rng = random.Random(seed)
    return [(rng.choice(["hot", "hot", "a", "b", None]), i, rng.choice([None, 5, 5, 5, *range(-20, 20)])) for i in rng.sample(range(10 * n), n)]


@pytest.fixture
def cut(spark):
    """Small tables in several ranges."""
    was = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    yield
    for k, v in was.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("n", [0, 1, 2, 400])
@pytest.mark.parametrize("inclusive", [True, False])
def test_running(spark, cut, n, inclusive):
    rows = rows_of(n)
    df = spark.createDataFrame(rows, "g string, id long, v long")
    for of, plain, empty in ((F.sum, sum, 0), (F.max, max, None), (F.min, min, None)):
        got = {r["id"]: r["x"] for r in ranking.running(df, [F.asc("id")], {"x": F.col("v")}, of, inclusive=inclusive).collect()}
        got_by = {r["id"]: r["x"] for r in ranking.running(df, [F.asc("id")], {"x": F.col("v")}, of, ["g"], inclusive).collect()}
        want, want_by = {}, {}
        for g, i, _ in rows:
            ahead = [(h, v) for h, j, v in rows if v is not None and (j < i or inclusive and j == i)]
            want[i] = plain([v for _, v in ahead]) if ahead else empty
            own = [v for h, v in ahead if h == g]
            want_by[i] = plain(own) if own else empty
        assert got == want and got_by == want_by


def test_running_sums_of_several_values(spark, cut):
    df = spark.createDataFrame(rows_of(100), "g string, id long, v long")
    got = ranking.running(df, [F.desc("id")], {"n": F.lit(1), "s": F.coalesce("v", F.lit(0))}).orderBy(F.desc("id")).collect()
    assert [r["n"] for r in got] == list(range(1, 101)) and [r["s"] for r in got] == list(accumulate(r["v"] or 0 for r in got))
    assert got[0].asDict().keys() == {"g", "id", "v", "n", "s"}


@pytest.mark.parametrize("n", [1, 2, 3, 5, 200])
def test_quantiles(spark, cut, n):
    rows = rows_of(n, n)
    df = spark.createDataFrame(rows, "g string, id long, v long")
    nearest = {"p0": (0, 1), "p25": (1, 4), "p50": (1, 2), "p95": (19, 20)}
    interpolated = {"q0": (0, 1), "q25": (1, 4), "q50": (1, 2), "q90": (9, 10), "q100": (1, 1)}
    for by in ([], ["g"]):
        groups = {}
        for g, _, v in rows:
            if v is not None:
                groups.setdefault((g,) if by else (), []).append(v)
        got = {tuple(r[c] for c in by): r for r in ranking.quantiles(df, by, "v", nearest, interpolated).collect()}
        assert got.keys() == groups.keys()
        for key, values in groups.items():
            s, r = sorted(values), got[key]
            assert r["n"] == len(s) and [r[k] for k in nearest] == [s[len(s) * a // b] for a, b in nearest.values()]
            assert [r[k] for k in interpolated] == pytest.approx([float(np.percentile(s, 100 * a / b)) for a, b in interpolated.values()], abs=1e-9)


def test_one_group_is_no_single_tasks(spark, cut):
    """A group of distinct values lies in all ranges, and only those with a wanted place are looked into."""
    df = spark.range(0, 5000, 1, 5).select((F.col("id") * 7919 % 5000).alias("v"))
    counts = df.groupBy("v").agg(F.count("*").alias("_c"))
    ranges = ranking._ranges(counts, [F.asc("v")])
    sizes = [r["count"] for r in ranges.groupBy("_range").count().collect()]
    assert len(sizes) == 7 and max(sizes) < 1500
    assert tuple(ranking.quantiles(df, [], "v", {"a": (1, 2)}, {"b": (1, 2)}).first()) == (5000, 2500, 2499.5)


def test_statistics_of_groups_without_values(spark, cut):
    df = spark.createDataFrame([("a", None), ("a", None), ("b", 3), (None, 1), (None, 4)], "g string, v long")
    got = {r["g"]: tuple(r)[1:] for r in M.length_stats(df, ["g"], "v").collect()}
    assert got == {"a": (0, None, None, None, None, None, None, None), "b": (1, 3.0, 3.0, 0.0, 3, 3, 3.0, 3.0), None: (2, 2.5, 2.5, 1.5, 1, 4, 1.75, 3.25)}
    assert M.length_stats(df.filter("false"), [], "v").first()["n"] == 0
    assert M.nearest_ranks(df.filter("false"), ["g"], "v", {"m": (1, 2)}).collect() == []


def frontier(points):
    best, out = None, set()
    for cost, value, name in sorted(points, key=lambda p: (p[0], -p[1], p[2])):
        if best is None or value > best:
            best = value
            out.add(name)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_frontier_with_ties_at_range_borders(spark, cut, seed):
    rng = random.Random(seed)
    points = [(rng.randint(0, 12), rng.randint(0, 30), f"p{k:03}", rng.choice("xy")) for k in range(150)]
    df = spark.createDataFrame(points, "cost long, value long, name string, g string")
    assert {r["name"] for r in R.pareto(df, None, "name", "cost", "value").collect()} == frontier([p[:3] for p in points])
    got = {r["name"] for r in R.pareto(df, "g", "name", "cost", "value").collect()}
    assert got == frontier([p[:3] for p in points if p[3] == "x"]) | frontier([p[:3] for p in points if p[3] == "y"])


def test_budget_is_checked_after_adding(spark, cut):
    calls = [(i, None if i % 9 == 0 else i % 5) for i in range(60)]
    df = spark.createDataFrame(calls, "at long, cost long")
    got = R.budgeted(df, [F.asc("at")], "cost", cost_limit=40, call_limit=50).orderBy("at").collect()
    spent = 0
    for n, ((at, cost), r) in enumerate(zip(calls, got), 1):
        spent += cost or 0
        assert tuple(r) == (at, cost, spent, n, spent > 40 or n >= 50)
    assert not any(r["exceeded"] for r in R.budgeted(df, [F.asc("at")], "cost").collect())


@pytest.mark.parametrize("descending", [True, False])
def test_ranks(spark, cut, descending):
    rows = [(i, v) for _, i, v in rows_of(120)]
    got = {r["id"]: r["r"] for r in ranking.ranked(spark.createDataFrame(rows, "id long, v long"), "v", "r", descending).collect()}
    key = lambda v: (v is None, 0 if v is None else -v if descending else v)
    assert got == {i: 1 + sum(key(w) < key(v) for _, w in rows) for i, v in rows}
