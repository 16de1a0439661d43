"""Every registered query against its SQL on the smallest tables, where they are at hand."""

import os

import pytest

from tracelake.operators import runs as R
from tracelake.plans import registry

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in os.listdir(SF):
        c.sql(f"create view {t.split('.')[0]} as select * from read_parquet('{SF}/{t}')")
    return c


def plain(rows):
    def value(v):
        return "null" if v is None or v != v else repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted(tuple(value(v) for v in r) for r in rows)


@needs_tables
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_is_its_sql(spark, duck, name):
    got = registry.queries()[name](spark, SF)
    columns = sorted(got.columns)
    want = duck.sql(registry.oracle_sql()[name])
    assert sorted(want.columns) == columns
    assert plain(got.select(columns).collect()) == plain(want.select(*[f'"{c}"' for c in columns]).fetchall())


@needs_tables
def test_entry_and_registry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_fallback_modes(spark):
    schema = "instance string, exit_status string, resolved boolean, steps long, cost long"
    critic = spark.createDataFrame([("a", "Submitted", True, 5, 10), ("b", "LimitsExceeded", True, 5, 10), ("c", "LimitsExceeded", False, 5, 10), ("d", "LimitsExceeded", True, 5, 10)], schema)
    base = spark.createDataFrame([(i, "Submitted", i == "c", 3, 7) for i in "abc"], schema)
    resolved = lambda mode: {r["instance"]: r["resolved"] for r in R.with_fallback(critic, base, mode).collect()}
    assert resolved("full") == {"a": True, "b": False, "c": True, "d": False}
    assert resolved("mini") == {"a": True, "b": True, "c": True, "d": True}
    assert resolved("additive") == {"a": True, "b": False, "c": True, "d": True}
    assert {r["instance"]: (r["steps"], r["cost"]) for r in R.with_fallback(critic, base).collect()} == {"a": (5, 10), "b": (8, 17), "c": (8, 17), "d": (5, 10)}


def test_split_is_disjoint_and_ordered(spark):
    rows = spark.createDataFrame([(f"k{i:03}", j) for i in range(50) for j in range(3)], "k string, j int")
    got = R.group_split(rows, "k", 0.9).collect()
    train = {r["k"] for r in got if r["is_train"]}
    assert train == {f"k{i:03}" for i in range(45)} and len(got) == 150


@pytest.mark.parametrize("at", [(2, 8, 1), (-4, None, 1), (None, -3, 2), (5, 2, 1), (None, None, 3), (-99, 4, 1)])
def test_slices(spark, at):
    got = [r["id"] for r in R.python_slice(spark.range(10), "id", *at).orderBy("id").collect()]
    assert got == list(range(10))[slice(*at)]


@needs_tables
def test_complete_answers_are_read_once(spark):
    """The numbered reading has two patterns; each stands once in the plan that runs."""
    plan = registry.queries()["p9_complete_answers"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 2
