import json

import pytest
from pyspark.sql import functions as F

from tracelake.operators import conversations as C
from tracelake.operators import training_set
from tracelake.sources import readers, sinks
from tracelake.streaming import incremental

GOOD = "DETECTED: No TASK_STATUS: On track"


@pytest.fixture
def run_dir(tmp_path):
    def put(name, text):
        d = tmp_path / "run" / name
        d.mkdir(parents=True)
        (d / f"{name}.traj.json").write_text(text if isinstance(text, str) else json.dumps(text, indent=1))

    usage = {"response": {"usage": {"prompt_tokens": 10, "completion_tokens": 2}}}
    say = lambda role, content, **more: {"role": role, "content": content, **more}
    put("a", {"instance_id": "a", "info": {"exit_status": "Submitted", "config": {"agent": {"prm_template": "P"}}, "prm_stats": {"prm_feedback_log": [{"invocation": 1, "after_step": 4}, {"invocation": 0, "after_step": 9}]}}, "messages": [say("system", "s"), say("user", [{"type": "text", "text": "x"}, {"value": "y"}, "z"]), say("assistant", "```bash\nls\n```", extra=usage), say("user", GOOD, _supervisor=True, _prm_after_step=7), say("user", None)]})
    put("b", [say("user", "u"), say("user", GOOD, _supervisor=True, _prm_after_step=3)])
    put("c", "invalid json content")
    (tmp_path / "run" / "report.json").write_text(json.dumps({"resolved_ids": ["a", "a", "q"]}))
    (tmp_path / "run" / "preds.json").write_text(json.dumps({"a": {"model_name_or_path": "m", "instance_id": "a", "model_patch": "diff"}}))
    return str(tmp_path / "run")


def test_trajectories(spark, run_dir):
    t = readers.trajectories(spark, run_dir)
    assert {(r["instance_id"], r["is_corrupt"], r["run_id"]) for r in t.collect()} == {("a", False, "run"), ("b", False, "run"), ("c", True, "run")}
    assert readers.trajectories(spark, run_dir, recursive=True).count() == 3 and readers.first_of_instance(t.union(t)).count() == 3
    m = {(r["instance_id"], r["pos"]): r for r in readers.messages(t).collect()}
    assert [m["a", k]["content"] for k in range(5)] == ["s", "x\ny\nz", "```bash\nls\n```", GOOD, ""]
    assert m["a", 2]["prompt_tokens"] == 10 and m["a", 3]["is_supervisor"] and not m["b", 0]["is_supervisor"]
    assert {tuple(r) for r in readers.after_steps(t).select("instance_id", "invocation", "after_step").collect()} == {("a", 1, 4), ("b", 1, 3)}
    assert readers.system_prompt(t).first()["prompt"] == "P"


def test_reports_and_predictions(spark, run_dir):
    assert {r["instance_id"] for r in readers.resolved_ids(spark, [f"{run_dir}/report.json", f"{run_dir}/none.json"]).collect()} == {"a", "q"}
    assert readers.resolved_ids(spark, [f"{run_dir}/none.json"]).count() == 0
    assert [tuple(r) for r in readers.predictions(spark, f"{run_dir}/preds.json").collect()] == [("a", "m", "diff")]
    assert readers.predictions(spark, f"{run_dir}/none.json").count() == 0


def test_lines(spark, tmp_path):
    three = [{"role": r, "content": r} for r in ("system", "user", "assistant")]
    (tmp_path / "s.jsonl").write_text("".join(json.dumps({"messages": three}) + "\n" for _ in range(3)))
    assert sorted(r["idx"] for r in readers.samples(spark, str(tmp_path / "s.jsonl")).collect()) == [0, 1, 2]
    (tmp_path / "bad.jsonl").write_text(json.dumps({"messages": three + three}) + "\n")
    with pytest.raises(Exception, match="three messages"):
        readers.samples(spark, str(tmp_path / "bad.jsonl")).collect()
    (tmp_path / "r.jsonl").write_text('{"idx": 1, "response": "old"}\n{"idx": 2, "response": "b"}\n{"idx": 1, "response": "new"}\n')
    assert {r["idx"]: r["response"] for r in readers.responses(spark, str(tmp_path / "r.jsonl")).collect()} == {1: "new", 2: "b"}
    with pytest.raises(FileNotFoundError):
        readers.responses(spark, str(tmp_path / "none"))
    (tmp_path / "t.csv").write_text("label,x\na,1.5\nb,N/A\nc,\n")
    assert {r["label"]: (r["x"], r["y"]) for r in readers.stats_table(spark, str(tmp_path / "t.csv"), ["x", "y"]).collect()} == {"a": (1.5, None), "b": (None, None), "c": (None, None)}
    (tmp_path / "m.tsv").write_text("i1\timg1\n")
    assert readers.image_manifest(spark, str(tmp_path / "m.tsv")).first()["image"] == "img1"


def test_sample_set_round_trip(spark, run_dir, tmp_path):
    m = readers.messages(readers.trajectories(spark, run_dir))
    s = C.samples(m, "instance_id", "pos", "role", "content", F.col("is_supervisor"), F.length("content") > 0, "Now.")
    counts = sinks.sample_set(s.withColumn("is_train", F.col("instance_id") == "a"), str(tmp_path / "out"), ["instance_id", "invocation"])
    assert counts == {"train": 1, "val": 1} and set(json.loads((tmp_path / "out/dataset_info.json").read_text())) == {"sft_train", "sft_val"}
    got = spark.read.json(str(tmp_path / "out/sft_train")).first()["messages"]
    assert [(x["role"], x["content"]) for x in got] == [("system", "s"), ("user", "x\ny\nz"), ("assistant", "```bash\nls\n```"), ("user", "\n\nNow."), ("assistant", GOOD)]
    sinks.metadata(spark, str(tmp_path / "meta.json"), n=2)
    assert json.loads((tmp_path / "meta.json").read_text()) == {"n": 2}
    sinks.trajectories(m, str(tmp_path / "docs"))
    assert spark.read.json(str(tmp_path / "docs")).count() == 2
    parts = sinks.sections({"one": m.groupBy("role").count(), "two": m.select("pos").distinct()})
    assert parts.columns == ["section", "role", "count", "pos"]


def test_training_set_from_end_to_end(spark, run_dir, tmp_path):
    out = str(tmp_path / "set")
    facts = training_set.build(spark, run_dir, out, layout="multiturn", train_ratio=0.5)
    assert {k: facts[k] for k in ("errors", "filtered", "skipped", "denoised", "samples", "train", "val", "interval")} == {"errors": 1, "filtered": 0, "skipped": 0, "denoised": 1, "samples": 2, "train": 1, "val": 1, "interval": 4}
    assert json.loads((tmp_path / "set/metadata.json").read_text()) == facts
    got = {name: [tuple(m) for m in spark.read.json(f"{out}/sft_{name}").select("messages.role", "messages.content").collect()] for name in ("train", "val")}
    assert got["train"] == [(["system", "user", "assistant", "user", "assistant"], ["s", "x\ny\nz", "```bash\nls\n```", "\n\nP", GOOD])]
    assert got["val"] == [(["system", "assistant"], ["", GOOD])]  # what stands in the place of a system text is not one
    assert [spark.read.text(f"{out}/{n}_ids").first()[0] for n in ("train", "val")] == ["a", "b"]
    none = training_set.build(spark, run_dir, str(tmp_path / "none"), resolved=spark.createDataFrame([("q",)], "instance_id string"))
    assert none["samples"] == 0 and none["filtered"] == 2 and not (tmp_path / "none/sft_train").exists()


def test_counters_come_from_the_write(spark, tmp_path):
    """The samples are computed once, however many counters are asked for, and one that raises leaves no set."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = spark.range(0, 50, 1, 3).select("id", F.when(F.col("id") % 5 != 0, F.col("id") < 40).alias("is_train"), F.array(F.struct(F.lit("user").alias("role"), F.col("id").cast("string").alias("content"))).alias("messages"))
    counts = sinks.sample_set(rows.mapInArrow(counted, rows.schema), str(tmp_path / "out"), ["id"], counters={"longest": F.max(F.length(F.get("messages", 0)["content"])), "odd": F.count_if(F.col("id") % 2 == 1)})
    assert seen.value == 50 and counts == {"train": 32, "val": 18, "longest": 2, "odd": 25}
    train = [r["messages"][0]["content"] for f in sorted((tmp_path / "out/sft_train").glob("*.json")) for r in map(json.loads, f.read_text().splitlines())]
    assert train == [str(k) for k in range(40) if k % 5]
    assert sinks.sample_set(rows.filter("false"), str(tmp_path / "none"), ["id"]) == {"train": 0, "val": 0}
    assert set(json.loads((tmp_path / "none/dataset_info.json").read_text())) == {"sft_train"}


def test_growing_folder_resumes(spark, tmp_path):
    folder, seen = tmp_path / "in", []
    folder.mkdir()
    for k in range(2):
        (folder / f"{k}.json").write_text(json.dumps({"idx": k}) + "\n")
        stream = incremental.growing(spark, str(folder), "idx long")
        incremental.upsert_each(stream, lambda batch, _: seen.extend(r["idx"] for r in batch.collect()), str(tmp_path / "ck")).awaitTermination()
    assert seen == [0, 1]  # the second call reads the new file only
    rows = spark.range(4).withColumnRenamed("id", "idx")
    assert incremental.missing(rows, rows.filter("idx < 2"), "idx").count() == 2 and incremental.missing(rows, rows, "idx", redo=True).count() == 4
