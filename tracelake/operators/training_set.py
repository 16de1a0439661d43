"""F1 from end to end: run folders in, a training set with its sidecars out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.functions import text as T
from tracelake.operators import conversations as C
from tracelake.operators import runs as R
from tracelake.sources import readers, scratch, sinks

LAYOUTS = {"plain": lambda m: m, "flattened": C.flattened, "multiturn": C.multiturn}


def build(spark: SparkSession, run_dirs: str | list[str], out: str, prompt: str | None = None, resolved: DataFrame | None = None, layout: str = "multiturn", train_ratio: float = 0.9, last: int = 5) -> dict[str, object]:
    """Writes `out`: folders sft_train and sft_val, dataset_info.json, train_ids and val_ids (sorted, a line an instance) and metadata.json, whose facts are returned.

    A sample is a valid supervisor's message with what was said before it (C1) and up to `last` earlier
    ones, in a layout of LAYOUTS; without a prompt the first trajectory's own holds. resolved: instance_id
    of trajectories to learn from, all if None. Instances, not samples, are split by train_ratio, in order.
    Trajectories are parsed once and samples computed once; counters come from these two writes. Without any
    sample nothing is written but metadata.json.
    """
    if layout not in LAYOUTS:
        raise ValueError(f"a layout is one of {', '.join(LAYOUTS)}")
    found = scratch.written(readers.first_of_instance(readers.trajectories(spark, run_dirs)).withColumn("key", F.concat_ws("/", "run_id", "instance_id")), "trajectories")
    if prompt is None:
        prompt = readers.system_prompt(found).first()["prompt"] or ""
    said = readers.messages(found).withColumn("key", F.concat_ws("/", "run_id", "instance_id"))
    said = said.withColumn("content", F.when(F.col("is_supervisor"), T.current_feedback(F.col("content"))).otherwise(F.col("content")))
    valid = F.col("is_supervisor") & (F.col("content") != "")
    per_run = said.groupBy("key").agg(F.count_if("is_supervisor").alias("n_own"), F.count_if(valid).alias("n_valid"))
    logged = F.coalesce(F.size("info.prm_stats.prm_feedback_log"), F.lit(-1))
    stages = found.join(per_run, "key", "left").withColumn("n_log", F.when(logged >= 0, logged).otherwise(F.coalesce("n_own", F.lit(0))))
    facts = C.stage_counters(stages, resolved, "instance_id", "is_corrupt", "n_log", "n_valid").first().asDict()
    facts["interval"] = R.interval(found.select("key"), readers.after_steps(found).withColumn("key", F.concat_ws("/", "run_id", "instance_id")), "key", "after_step").first()["step_interval"]
    facts |= {"layout": layout, "last": last, "train_ratio": train_ratio}
    used = said if resolved is None else said.join(resolved.select("instance_id").distinct(), "instance_id", "left_semi")
    samples = C.samples(used, "key", "pos", "role", "content", F.col("is_supervisor"), F.col("content") != "", prompt, last)
    samples = samples.join(found.select("key", "instance_id"), "key").withColumn("messages", LAYOUTS[layout](F.col("messages")))
    if facts["samples"]:
        samples = R.group_split(samples, "instance_id", train_ratio)
        tokens = F.aggregate("messages", F.lit(0).cast("long"), lambda a, m: a + T.approximate_tokens(m["content"]))
        facts |= sinks.sample_set(samples, out, ["key", "invocation"], counters={"approximate_tokens": F.sum(tokens), "longest_sample": F.max(tokens)})
        for name, flag in (("train", True), ("val", False)):
            samples.filter(F.col("is_train") == flag).select("instance_id").distinct().orderBy("instance_id").write.mode("overwrite").text(f"{out}/{name}_ids")
    sinks.metadata(spark, f"{out}/metadata.json", **facts)
    return facts
