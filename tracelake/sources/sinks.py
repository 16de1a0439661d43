"""Sinks: sample sets with their sidecars, tables, reports and keyed maps."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tracelake.sources.scratch import folder


def write_text(spark: SparkSession, path: str, text: str, replace: bool = True) -> None:
    """A small file from the driver, through the file system of its path. It replaces an older one at once, so that readers find either; without replace one that is there raises FileExistsError."""
    jvm = spark._jvm
    target, part = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    conf = spark._jsc.hadoopConfiguration()
    files = target.getFileSystem(conf)
    out = files.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE if replace else rename.NONE
    target_uri = files.makeQualified(target)
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(target_uri.toUri(), conf).rename(files.makeQualified(part), target_uri, how)
    except Py4JJavaError as e:
        files.delete(part, False)
        if not replace and files.exists(target):
            raise FileExistsError(path) from e
        raise


_TAGS = {"role_tag": "role", "content_tag": "content", "user_tag": "user", "assistant_tag": "assistant", "system_tag": "system"}


def counted_write(rows: DataFrame, path: str, counters: dict[str, Column], **options: object) -> dict[str, object]:
    """Rows as Parquet, and counters of them (aggregates) from the write itself, so that what they come from is computed once."""
    seen = Observation()
    rows.observe(seen, F.count("*").alias("rows"), *[c.alias(n) for n, c in counters.items()]).write.options(**options).parquet(path)
    return seen.get


def sample_set(samples: DataFrame, path: str, order: list[str], split: str = "is_train", counters: dict[str, Column] | None = None) -> dict[str, object]:
    """K1, K2: train and val folders of JSON lines in order, and dataset_info.json; val only if it has rows. Returns the counts train and val, and those of `counters`, aggregates over the samples.

    The samples are computed once: one job writes them to the shared folder and counts what it writes. From
    there each task writes its range of the order as a file; the files' names keep the order. Both
    folders come into view with dataset_info.json, which is written last.
    """
    spark = samples.sparkSession
    held = folder(spark, "samples")
    flag = F.coalesce(F.col(split), F.lit(False))
    counts = counted_write(samples.select("messages", split, *[c for c in order if c != split], *_extra(samples, order, split, counters)), held, {"train": F.count_if(flag), "val": F.count_if(~flag)} | (counters or {}))
    info = {}
    for name, wanted in (("train", True), ("val", False)):
        if name == "train" or counts["val"]:
            part = spark.read.schema(samples.select("messages", split, *[c for c in order if c != split]).schema).parquet(held).filter(F.coalesce(F.col(split), F.lit(False)) == wanted)
            part.orderBy(*order).select("messages").write.mode("overwrite").json(f"{path}/sft_{name}")
            info[f"sft_{name}"] = {"file_name": f"sft_{name}", "formatting": "sharegpt", "columns": {"messages": "messages"}, "tags": _TAGS}
    write_text(spark, f"{path}/dataset_info.json", json.dumps(info, indent=2))
    return {k: v for k, v in counts.items() if k != "rows"}


def _extra(samples: DataFrame, order: list[str], split: str, counters: dict | None) -> list[str]:
    """Columns that only counters read."""
    return [c for c in samples.columns if c not in ("messages", split, *order)] if counters else []


def metadata(spark: SparkSession, path: str, **facts: object) -> None:
    """K3, K5, K6: a JSON sidecar of counters and provenance."""
    write_text(spark, path, json.dumps(facts, indent=2, sort_keys=True, default=str))


def csv_table(rows: DataFrame, path: str) -> None:
    """K7, K8: CSV with header; what needs quotes gets them."""
    rows.write.mode("overwrite").csv(path, header=True)


def sections(parts: dict[str, DataFrame]) -> DataFrame:
    """K9: tables of a report under one another, with a section column."""
    out = None
    for name, part in parts.items():
        one = part.select(F.lit(name).alias("section"), *[F.col(f"`{c}`").cast("string").alias(c) for c in part.columns])
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def by_exit_status(runs: DataFrame) -> DataFrame:
    """exit_status and its sorted instances, one line an instance; a status may have any number of them."""
    return runs.select("exit_status", "instance_id").orderBy("exit_status", "instance_id")


def documents(messages: DataFrame) -> DataFrame:
    """run_id, instance_id and messages (role, content in order) of message rows."""
    m = F.struct("pos", "role", "content")
    return messages.groupBy("run_id", "instance_id").agg(F.transform(F.array_sort(F.collect_list(m)), lambda x: F.struct(x["role"], x["content"])).alias("messages"))


def trajectories(messages: DataFrame, path: str) -> None:
    """A JSON document per instance with its messages in order, many to a file, by run."""
    documents(messages).write.mode("overwrite").partitionBy("run_id").json(path)


def trajectory_files(texts: DataFrame, path: str) -> int:
    """K12, one file an instance: (name, text) rows as path/name/name.traj.json, each whole under its name at once; a task that is run again writes the same. Returns how many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(path)
        for batch in batches:
            for name, text in zip(batch.column("name").to_pylist(), batch.column("text").to_pylist()):
                at = f"{root}/{name}"
                store.create_dir(at, recursive=True)
                part = f"{at}/.{uuid.uuid4().hex}"
                with store.open_output_stream(part) as out:
                    out.write(text.encode())
                store.move(part, f"{at}/{name.rsplit('/', 1)[-1]}.traj.json")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    return texts.select(F.col("name").cast("string").alias("name"), "text").mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]


def checkpoint(rows: DataFrame, path: str, order: str, keep: DataFrame | None = None) -> None:
    """K4: results so far as JSON lines in order, with those of an earlier checkpoint; the commit of the write makes the new folder whole before it is read, and a `latest` file names it."""
    every = rows if keep is None else keep.join(rows.select(order), order, "left_anti").unionByName(rows)
    name = f"part-{uuid.uuid4().hex}"
    every.repartitionByRange(order).sortWithinPartitions(order).write.json(f"{path}/{name}")
    write_text(rows.sparkSession, f"{path}/latest", name)


def from_checkpoint(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """The rows of the last whole checkpoint, None before the first."""
    from tracelake.sources.readers import _exists

    if not _exists(spark, f"{path}/latest"):
        return None
    name = spark.read.text(f"{path}/latest").first()[0]
    return spark.read.schema(schema).json(f"{path}/{name}")


def markdown(table: DataFrame, title: str, order: list[str], most: int = 1000) -> str:
    """A small result as a Markdown table; a larger one is an error, as it would pass through the driver."""
    rows = table.orderBy(*order).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report of over {most} rows")
    line = lambda cells: f"| {' | '.join(str(c).replace('|', chr(92) + '|') for c in cells)} |"
    return "\n".join([f"## {title}", "", line(table.columns), line(["---"] * len(table.columns)), *map(line, rows), ""])


def json_rows(table: DataFrame) -> DataFrame:
    """Each row as one JSON text."""
    return table.select(F.to_json(F.struct("*")).alias("json"))
