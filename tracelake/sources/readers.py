"""Scans of run folders: trajectories, predictions, reports, samples and responses. Parsing never fails a job: what cannot be read is kept and flagged."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelake.functions.text import content_text
from tracelake.sources import schemas


def _whole(spark: SparkSession, path: str, name: str, recursive: bool = False) -> DataFrame:
    reader = spark.read.option("pathGlobFilter", name)
    return (reader.option("recursiveFileLookup", True) if recursive else reader).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


def trajectories(spark: SparkSession, run_dirs: str | list[str], recursive: bool = False) -> DataFrame:
    """One row per `*.traj.json` one level below each run's folder (any level with recursive): path, run_id, instance_id, info, messages, is_corrupt.

    A document is an object with `messages` or a bare list of them; other texts are corrupt rows.
    """
    dirs = [run_dirs] if isinstance(run_dirs, str) else run_dirs
    found = None
    for d in dirs:
        at = _whole(spark, d.rstrip("/") if recursive else f"{d.rstrip('/')}/*/", "*.traj.json", recursive).withColumn("run_id", F.lit(d.rstrip("/").rsplit("/", 1)[-1]))
        found = at if found is None else found.unionByName(at)
    doc = F.from_json("value", schemas.TRAJECTORY)
    is_list = F.ltrim(F.regexp_replace("value", r"^\s+", "")).startswith("[")
    bare = F.from_json("value", f"array<{schemas.MESSAGE}>")
    parsed = found.withColumn("doc", F.when(~is_list, doc)).withColumn("bare", F.when(is_list, bare))
    named = F.regexp_extract("path", r"([^/]+)\.traj\.json$", 1)
    messages = F.coalesce("doc.messages", "bare")
    return parsed.select("path", "run_id", F.coalesce("doc.instance_id", named).alias("instance_id"), F.col("doc.info").alias("info"), messages.alias("messages"), messages.isNull().alias("is_corrupt"))


def first_of_instance(found: DataFrame) -> DataFrame:
    """One trajectory per run and instance, the first by path."""
    r = F.row_number().over(Window.partitionBy("run_id", "instance_id").orderBy("path"))
    return found.withColumn("_r", r).filter("_r = 1").drop("_r")


def messages(found: DataFrame) -> DataFrame:
    """The message table: run_id, instance_id, pos, role, content (text), is_supervisor, is_active, after_step, prompt_tokens, completion_tokens."""
    m = found.filter(~F.col("is_corrupt")).select("run_id", "instance_id", F.posexplode("messages").alias("pos", "m"))
    usage = F.col("m.extra.response.usage")
    return m.select(
        "run_id", "instance_id", "pos", "m.role", F.when(F.col("m.content").isNull(), "").otherwise(content_text(F.col("m.content"))).alias("content"),
        F.coalesce("m._supervisor", F.lit(False)).alias("is_supervisor"), F.coalesce("m._supervisor_active", F.lit(False)).alias("is_active"),
        F.col("m._prm_after_step").alias("after_step"), usage["prompt_tokens"].alias("prompt_tokens"), usage["completion_tokens"].alias("completion_tokens"),
    )


def after_steps(found: DataFrame) -> DataFrame:
    """run_id, instance_id, invocation, after_step from the feedback log; where a trajectory's log has none, from the messages in order."""
    key = ["run_id", "instance_id"]
    log = found.select(*key, F.explode("info.prm_stats.prm_feedback_log").alias("e")).filter("e.invocation > 0 and e.after_step is not null")
    log = log.groupBy(*key, F.col("e.invocation").alias("invocation")).agg(F.max("e.after_step").alias("after_step"))
    own = messages(found).filter("is_supervisor").withColumn("invocation", F.row_number().over(Window.partitionBy(*key).orderBy("pos")))
    own = own.filter("after_step is not null").select(*key, "invocation", "after_step").join(log.select(*key).distinct(), key, "left_anti")
    return log.unionByName(own)


def system_prompt(found: DataFrame) -> DataFrame:
    """One row with the critic's prompt of the first trajectory by path that has one."""
    p = F.col("info.config.agent.prm_template")
    return found.filter(F.length(p) > 0).agg(F.min_by(p, "path").alias("prompt"))


def resolved_ids(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Distinct ids of reports; missing files give none."""
    present = [p for p in paths if _exists(spark, p)]
    if not present:
        return spark.createDataFrame([], "path string, instance_id string")
    text = spark.read.text(present, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.from_json("value", "resolved_ids array<string>").alias("r"))
    return text.select("path", F.explode("r.resolved_ids").alias("instance_id")).distinct()


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def predictions(spark: SparkSession, path: str) -> DataFrame:
    """instance_id, model_name, model_patch of a map by id; unreadable or missing files give none."""
    if not _exists(spark, path):
        return spark.createDataFrame([], "instance_id string, model_name string, model_patch string")
    m = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", schemas.PREDICTIONS)).alias("k", "v"))
    return m.select(F.col("k").alias("instance_id"), F.col("v.model_name_or_path").alias("model_name"), "v.model_patch")


def gold_patches(spark: SparkSession, path: str, key: str = "instance_id", patch: str = "patch") -> DataFrame:
    """instance_id and gold_patch of a data set's local copy in Parquet, one row an instance. A copy that is missing, is no Parquet or has no such columns gives no rows, so that what is measured by it is not available instead of wrong."""
    none = spark.createDataFrame([], "instance_id string, gold_patch string")
    if not _exists(spark, path):
        return none
    try:
        rows = spark.read.parquet(path)
    except AnalysisException:
        return none
    if not {key, patch} <= set(rows.columns):
        return none
    return rows.filter(F.col(key).isNotNull()).groupBy(F.col(key).cast("string").alias("instance_id")).agg(F.max(patch).alias("gold_patch"))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """path, line_no (from 0 within its file) and line of text files of any size: lines are numbered within the splits in which they are read, then by the counts of the splits before."""
    split = ["path", "_start"]
    read = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_at"), F.col("value").alias("line"))
    within = read.withColumn("_no", F.row_number().over(Window.partitionBy(*split).orderBy("_at")) - 1)
    counts = spark.read.text(path).groupBy(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_start")).agg(F.count("*").alias("_n"))
    ahead = F.sum("_n").over(Window.partitionBy("path").orderBy("_start").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
    return within.join(counts.select(*split, ahead.alias("_ahead")), split).select("path", (F.col("_ahead") + F.col("_no")).alias("line_no"), "line")


def samples(spark: SparkSession, path: str) -> DataFrame:
    """Idx (line number within the file) and messages of a JSONL file; reading fails on samples that are not system, user, assistant."""
    s = lines(spark, path).select(F.col("line_no").alias("idx"), F.from_json("line", schemas.SAMPLE).alias("s")).select("idx", "s.messages")
    return s.filter(F.assert_true((F.size("messages") == 3) & (F.get("messages", 0)["role"] == "system"), "a sample is not three messages from system on").isNull())


def responses(spark: SparkSession, path: str) -> DataFrame:
    """One row per idx; of repeated ones the last line of the last file (by path) holds. Keyed by idx, never by position."""
    if not _exists(spark, path):
        raise FileNotFoundError(path)
    r = lines(spark, path).select("path", "line_no", F.from_json("line", schemas.RESPONSE).alias("r")).filter("r.idx is not null").select("path", "line_no", "r.*")
    last = F.row_number().over(Window.partitionBy("idx").orderBy(F.desc("path"), F.desc("line_no")))
    return r.withColumn("_r", last).filter("_r = 1").drop("_r", "path", "line_no")


def judgements(spark: SparkSession, path: str) -> DataFrame:
    """Idx and winner_model."""
    return spark.read.schema("idx long, winner_model string").json(path)


def image_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Two tab-separated columns without a header."""
    return spark.read.csv(path, sep="\t", schema="instance_id string, image string")


def stats_table(spark: SparkSession, path: str, numbers: list[str]) -> DataFrame:
    """A CSV with header; '' and N/A are null, and the columns named are doubles, null where they are missing."""
    t = spark.read.csv(path, header=True, inferSchema=False)
    blank = lambda c: F.when(F.trim(c).isin("", "N/A"), None).otherwise(c)
    t = t.select([blank(F.col(f"`{c}`")).alias(c) for c in t.columns])
    return t.withColumns({c: F.expr(f"try_cast(`{c}` as double)") if c in t.columns else F.lit(None).cast("double") for c in numbers})


def prices(spark: SparkSession, path: str) -> DataFrame:
    """Model, rate_in and rate_out (per token) of a JSON map by model; a missing file gives none."""
    if not _exists(spark, path):
        return spark.createDataFrame([], "model string, rate_in double, rate_out double")
    m = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,struct<input:double,output:double>>")).alias("model", "v"))
    return m.select("model", F.col("v.input").alias("rate_in"), F.col("v.output").alias("rate_out"))


def critic_results(spark: SparkSession, path: str) -> DataFrame:
    """One row with n_calls and tokens_in of a JSON list of a critic's calls; a missing file counts as none."""
    none = spark.range(1).select(F.lit(0).cast("long").alias("n_calls"), F.lit(0).cast("long").alias("tokens_in"))
    if not _exists(spark, path):
        return none
    calls = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<struct<formatted_tokens:long>>")).alias("c"))
    return calls.agg(F.count("*").alias("n_calls"), F.coalesce(F.sum("c.formatted_tokens"), F.lit(0)).alias("tokens_in"))


def files(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Paths below a folder of files whose name fits a glob; contents are not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", name).option("recursiveFileLookup", True).load(path).select("path")


def runs_at_hand(spark: SparkSession, registry: DataFrame, root: str, run: str = "run", report: str = "report.json") -> DataFrame:
    """The registered runs whose folder below root has a report."""
    found = files(spark, root, report).select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias(run)).distinct()
    return registry.join(found, run, "left_semi")


def universe(spark: SparkSession, run_dir: str, gold: DataFrame | None = None) -> DataFrame:
    """Distinct instance_id of the dataset where there is one, else the names of a reference run's folders."""
    if gold is not None:
        return gold.select("instance_id").distinct()
    below = F.regexp_extract("path", re.escape(run_dir.rstrip("/").rsplit("/", 1)[-1]) + r"/([^/]+)/[^/]+$", 1)
    return files(spark, run_dir, "*").select(below.alias("instance_id")).filter("instance_id <> ''").distinct()
