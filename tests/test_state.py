"""Tables changed in place, streams that resume, windows of event time."""

import json
import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tracelake.operators import sequential
from tracelake.operators import snippets as S
from tracelake.sources.keyed import KeyedTable
from tracelake.streaming import incremental


def held(table):
    return sorted(map(tuple, table.rows().collect()), key=str)


def test_keyed_table_is_a_dictionary(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), "k long, v string", "k", buckets=4)
    assert held(table) == [] and table.versions() == []
    rng, want = random.Random(1), {}
    for step in range(5):
        rows = [(rng.choice([None, *range(30)]), f"{step}:{i}", i) for i in range(12)]
        table.upsert(spark.createDataFrame(rows, "k long, v string, at int"), "at")
        want |= {k: v for k, v, _ in rows}
        gone = [(rng.choice([None, *range(40)]),) for _ in range(3)]
        table.delete(spark.createDataFrame(gone, "k long"))
        for (k,) in gone:
            want.pop(k, None)
        assert held(table) == sorted(want.items(), key=str)
    assert table.versions() == list(range(1, 11))


def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_only_touched_buckets_are_written(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), "k long, v string", "k", buckets=16)
    table.upsert(spark.range(5000).select(F.col("id").alias("k"), F.lit("x" * 50).alias("v")))
    whole, first = files(tmp_path / "t/data"), table.manifest()
    touched = table.upsert(spark.createDataFrame([(7, "new")], "k long, v string"))
    second, new = table.manifest(), files(tmp_path / "t/data") - whole
    assert len(touched) == 1 and len(new) == 1
    assert sum(map(os.path.getsize, new)) < sum(map(os.path.getsize, whole)) / 8
    assert {b for b in first["folders"] if first["folders"][b] != second["folders"][b]} == {str(touched[0])}
    assert table.rows(1).filter("k = 7").first()["v"] != "new" and table.rows(2).filter("k = 7").first()["v"] == "new"  # each version stays as it was
    assert table.clean(keep=1) == 0  # the first version's folder still holds the other buckets
    assert table.rows().count() == 5000 and table.versions() == [2]
    table.upsert(table.rows())
    assert table.clean(keep=1) == 2 and table.rows().count() == 5000


def test_of_two_writers_one_does_its_change_again(spark, tmp_path):
    one = KeyedTable(spark, str(tmp_path / "t"), "k long, n long", "k", buckets=2)
    other = KeyedTable(spark, str(tmp_path / "t"), "k long, n long", "k")
    one.add(spark.createDataFrame([(1, 5), (2, 5)], "k long, n long"))
    tries = []

    def slow(now, new):
        tries.append(now.count())
        if len(tries) == 1:  # the other one commits first
            other.add(spark.createDataFrame([(1, 100)], "k long, n long"))
        return now.unionByName(new).groupBy("k").agg(F.sum("n").alias("n"))

    one.change(spark.createDataFrame([(1, 7), (2, 1), (3, 1)], "k long, n long"), slow)
    assert len(tries) == 2 and held(one) == [(1, 112), (2, 6), (3, 1)]
    assert other.buckets == 2


def test_a_batch_that_comes_again_counts_once(spark, tmp_path):
    """The run ends between the table's write and the stream's commit; the batch comes again when it goes on."""
    folder = tmp_path / "in"
    folder.mkdir()
    table = KeyedTable(spark, str(tmp_path / "t"), "k string, n long", "k", buckets=4)
    merge, seen = incremental.into(table, "counts", kind="add"), []

    def fails_after(batch, number):
        merge(batch, number)
        seen.append(number)
        raise RuntimeError("lost")

    def again(batch, number):
        seen.append(number)
        merge(batch, number)

    def run(how, raises=False):
        stream = incremental.upsert_each(incremental.growing(spark, str(folder), "k string, n long"), how, str(tmp_path / "ck"))
        if raises:
            with pytest.raises(Exception, match="lost"):
                stream.awaitTermination()
        else:
            stream.awaitTermination()

    (folder / "0.json").write_text('{"k": "a", "n": 1}\n{"k": "b", "n": 2}\n{"k": "a", "n": 4}\n')
    run(fails_after, raises=True)
    assert held(table) == [("a", 5), ("b", 2)] and table.versions() == [1]
    (folder / "1.json").write_text('{"k": "a", "n": 10}\n')
    run(again)
    assert seen == [0, 0, 1] and held(table) == [("a", 15), ("b", 2)] and table.versions() == [1, 2]
    run(again)
    assert seen == [0, 0, 1] and table.manifest()["ledger"] == {"counts": 1}


@pytest.mark.parametrize("cuts", [(40,), (7, 8, 30)])
def test_loop_as_a_stream_is_the_loop_of_the_whole(spark, tmp_path, cuts):
    rng = random.Random(2)
    rows = [(k, p, rng.random() < 0.7, None if rng.random() < 0.1 else [rng.choice([0.0, 1.0]), rng.choice([0.0, 1.0]), 1.0]) for k in ("a", "b", None) for p in range(60)]
    schema = "k string, p long, is_step boolean, v array<double>"
    want = sorted(map(tuple, sequential.supervised(spark.createDataFrame(rows, schema), "k", "p", "is_step", "v", 3, 0.9).collect()), key=str)
    edges = [0, *cuts, 60]
    for a, b in zip(edges, edges[1:]):
        again = [r for r in rows if a - 3 <= r[1] < a]  # the last messages of the run before come once more
        part = [r for r in rows if a <= r[1] < b] + again
        rng.shuffle(part)
        spark.createDataFrame(part, schema).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        answers = sequential.supervised_stream(stream, "k", "p", "is_step", "v", 3, 0.9)
        answers.writeStream.option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()), key=str) == want


def at(minutes):
    return datetime(2024, 5, 1) + timedelta(minutes=minutes)


def put(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(json.dumps({"t": str(at(m)) if m is not None else None, "k": k, "v": v}) + "\n" for m, k, v in rows))


def test_streams_of_windows_equal_the_batch_without_late_rows(spark, tmp_path):
    rng = random.Random(3)
    rows = [(rng.randint(0, 600), rng.choice("ab"), rng.randint(1, 9)) for _ in range(150)] + [(None, "a", 1)]
    late = [(5, "a", 1000), (6, "b", 1000)]
    put(tmp_path / "in", "0.json", rows)
    shapes = {
        "sliding": lambda e: incremental.windowed_counts(e, "t", ["k"], "60 minutes", "30 minutes", F.col("v"), "20 minutes"),
        "sessions": lambda e: incremental.sessions(e, "t", ["k"], "15 minutes", "30 minutes", F.col("v")),
    }
    batch = spark.read.schema("t timestamp, k string, v long").json(str(tmp_path / "in"))
    want = {name: sorted(map(tuple, f(batch).collect())) for name, f in shapes.items()}
    sessions = []
    for k in "ab":
        for m, v in sorted((m, v) for m, x, v in rows if x == k and m is not None):
            if sessions and sessions[-1][0] == k and m - sessions[-1][2] <= 15:
                sessions[-1][2:] = [m, sessions[-1][3] + 1, sessions[-1][4] + v]
            else:
                sessions.append([k, m, m, 1, v])
    assert want["sessions"] == sorted((at(a), at(b + 15), k, n, v) for k, a, b, n, v in sessions)
    assert sum(r[3] for r in want["sliding"]) == 3 * 150
    for name, f in shapes.items():
        folder = tmp_path / f"in-{name}"
        for step, part in enumerate((rows, [(5000, "z", 0)], late, [(9000, "z", 0)])):  # the second closes all windows, so the third's rows are late
            put(folder, f"{step}.json", part)
            stream = f(incremental.growing(spark, str(folder), "t timestamp, k string, v long"))
            stream.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / f"ck-{name}")).trigger(availableNow=True).start(str(tmp_path / f"out-{name}"), format="parquet").awaitTermination()
        got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / f"out-{name}")).filter("k <> 'z'").collect())
        assert got == want[name]


def snippet(ranges, lines, context):
    merged = []
    for a, b in sorted(set(ranges)):
        s, e = max(1, a - context), min(len(lines), b + context)
        if merged and s <= merged[-1][1] + 1:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e])
    out = []
    for s, e in merged:
        out += [f"\n--- Lines {s}-{e} ---"] * (len(merged) > 1) + [f"{i:4d} | {lines[i - 1]}" for i in range(s, e + 1)]
    return out


def test_snippets_of_edited_files(spark):
    rng, files_, patches, want = random.Random(5), [], [], {}
    for k in range(30):
        shown, patch = [], ""
        for name in rng.sample(["a.py", "b/c.py", "none.py", "empty.py", "long.py"], rng.randint(1, 5)):
            n = 0 if name == "empty.py" else 3000 if name == "long.py" else rng.randint(1, 40)
            lines = [f"line {i}" + rng.choice(["", " | x", "  "]) for i in range(n)]
            if name != "none.py":
                files_.append((k, name, "".join(x + rng.choice(["\n", "\r\n"]) for x in lines[:-1]) + "".join(lines[-1:]) + rng.choice(["", "\n"]) * bool(lines), 0.5))
            ranges = []
            patch += f"diff --git a/{name} b/{name}\n--- a/{name}\n+++ b/{name}\n"
            for _ in range(rng.randint(0, 4)):
                a, c = rng.randint(1, max(n, 1)), rng.choice([None, 0, 1, 2, 5, n])
                patch += f"@@ -1,2 +{a}{'' if c is None else f',{c}'} @@ def\n+x\n"
                ranges.append((a, a + (1 if c is None else c) - 1))
            if name != "none.py" and lines and ranges:
                shown.append((name, "\n".join([f"=== File: {name} ===", *snippet(ranges, lines, 3)])))
        patches.append((k, patch, "clash"))
        if shown:
            want[k] = "\n\n".join(t for _, t in sorted(shown))
    got = S.snippets(spark.createDataFrame(patches, "k long, patch string, path string"), spark.createDataFrame(files_, "k long, file string, text string, line double"), "k", "patch", "file", "text")
    assert {r["k"]: r["shown"] for r in got.collect()} == want


def test_a_long_range_goes_to_bins_not_to_lines(spark):
    lines = spark.range(1, 100_001).select(F.lit(1).alias("k"), F.lit("f").alias("path"), F.col("id").cast("int").alias("line_no"), F.lit("x").alias("line"))
    ranges = spark.createDataFrame([(1, "f", 10, 99_990)], "k int, path string, start int, end int")
    assert S.snippet_lines(ranges, lines, "k").count() == 99_981
    bins = ranges.withColumn("b", F.explode(F.sequence(F.expr(f"(start - 1) div {S.BIN}"), F.expr(f"(end - 1) div {S.BIN}"))))
    assert bins.count() == 196
