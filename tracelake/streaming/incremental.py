"""Resumable processing: missing keys in a batch, and folders that grow as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tracelake.sources.keyed import KeyedTable


def missing(rows: DataFrame, done: DataFrame, key: str, redo: bool = False) -> DataFrame:
    """Rows whose key has no result yet, or all with redo."""
    return rows if redo else rows.join(done.select(key).distinct(), key, "left_anti")


def growing(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1000) -> DataFrame:
    """A stream of the JSON rows of a folder to which runs append files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(path)


def upsert_each(stream: DataFrame, merge: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Calls merge(batch, id) for each batch until the input at hand is used up; reruns go on where the last ended."""
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def into(table: KeyedTable, stream: str, order: str | None = None, kind: str = "upsert") -> Callable[[DataFrame, int], None]:
    """What a stream does with each batch, for `upsert_each`: the table takes it once, however often it comes.

    The table's ledger has the batch's number under the stream's name, written at once with the
    batch's rows. Where a run ends between that write and the stream's own commit, the batch comes again and
    is left alone. The name stands for one stream with one checkpoint. kind: upsert (by order), add or delete.
    """

    def merge(batch: DataFrame, number: int) -> None:
        if kind == "upsert":
            table.upsert(batch, order, stream=stream, batch=number)
        else:
            {"add": table.add, "delete": table.delete}[kind](batch, stream=stream, batch=number)

    return merge


def windowed_counts(events: DataFrame, time: str, keys: list[str], size: str, late: str, value: Column | None = None, slide: str | None = None) -> DataFrame:
    """Counts and sums per window of event time (one that slides, if asked: an event is in every window that holds it), with a watermark for late rows; the same on a batch.

    A row is late when its windows ended before the latest time seen, less `late`; a stream leaves it
    out, a batch has no late rows. Rows without a time are in no window.
    """
    marked = events.withWatermark(time, late)
    window = F.window(time, size, slide) if slide else F.window(time, size)
    sums = marked.groupBy(window.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value if value is not None else F.lit(0)).alias("total"))
    return sums.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "total")


def sessions(events: DataFrame, time: str, keys: list[str], gap: str | Column, late: str, value: Column | None = None) -> DataFrame:
    """Counts and sums per session of each key: events that follow one another by the gap at most, which may depend on the event. A session ends a gap after its last event, and two that a late row joins become one."""
    marked = events.withWatermark(time, late)
    sums = marked.groupBy(F.session_window(time, gap).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value if value is not None else F.lit(0)).alias("total"))
    return sums.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "total")
