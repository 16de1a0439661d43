"""One document of each group of near duplicates stays."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tracelake.llm.common import materialize, shared_dir, tidied
from tracelake.llm.ngram_join import linked_nodes
from tracelake.llm.packed import Shards, find, pack, put, ranges, shard_bits


def _fates(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """row_key and fate of the rows that do not simply stay: 0 goes, 2 stays once (the row is repeated)."""
    rows, linked = linked_nodes(docs, doc_id, text)
    rows = rows.filter("node is not null")
    counted = rows.groupBy("node").agg(F.count("*").alias("n"))
    rooted = counted.join(linked, "node", "left").filter("n > 1 or root is not null").select("node", F.coalesce("root", "node").alias("root"))
    # A group may have a third of all rows: these joins are split by the skew join of the adaptive plan where they are large.
    members = materialize(rows.join(materialize(rooted, "near-nodes"), "node").select("root", "doc_id", "row_key"), "near-members")
    # The least id stays; rows without an id come last.
    first = members.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")).alias("first")).select("root", F.col("first.row_key").alias("kept"))
    found = materialize(members.join(materialize(first, "near-first"), "root").select("row_key", "kept"), "near-found")
    gone = found.filter("row_key <> kept").select("row_key", F.lit(0).alias("fate")).distinct()
    twice = found.filter("row_key = kept").groupBy("row_key").agg(F.count("*").alias("n")).filter("n > 1").select("row_key", F.lit(2).alias("fate"))
    return gone.union(twice)


def _write(fates: DataFrame, bits: int, folder: str) -> frozenset[int]:
    """Sorted arrays row key -> fate, and the shards that have one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for shard, key, fate in zip(*(batch.column(c).to_pylist() for c in ("shard", "row_key", "fate"))):
                held.setdefault(shard, []).append((key, fate))
        for shard, found in held.items():
            keys, fate = np.array([k for k, _ in found], np.int64).view(np.uint64), np.array([f for _, f in found], np.uint8)
            order = np.argsort(keys)
            put(folder, f"fates-{shard}", pack(keys[order], fate[order]))
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32())], names=["shard"])

    top = F.shiftrightunsigned("row_key", 64 - bits).cast("int")
    return frozenset(r["shard"] for r in fates.select(top.alias("shard"), "row_key", "fate").repartition(1 << bits, "shard").mapInArrow(tidied(run), "shard int").collect())


def distinct(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs, all columns, less those that links connect to a row of smaller id.

    Texts are not shuffled: workers look a row's fate up in sorted arrays in the shared folder. Rows
    without words stay. Of rows that repeat an id and a text one stays. An empty table gives an empty one.
    """
    bits, folder = shard_bits(docs.sparkSession), f"{shared_dir(docs.sparkSession)}/near-{uuid.uuid4().hex}"
    written = _write(_fates(docs, doc_id, text), bits, folder)
    key = "_row_key" + uuid.uuid4().hex[:8]
    keyed = docs.withColumn(key, F.xxhash64(F.col(doc_id).cast("long"), F.coalesce(F.col(text), F.lit(""))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fates = Shards(folder, "fates", written, "<u8", "u1")
        for batch in batches:
            keys = batch.column(key).to_numpy().view(np.uint64)
            fate, order = np.ones(len(keys), np.int8), np.argsort(keys)
            for shard, x in ranges(keys[order], bits):
                if (found := fates[shard]) is not None:
                    hit, at = find(found[0], keys[order][x])
                    fate[order[x][hit]] = found[1][at]
            # A key in place of its marker: rows that stay once keep it, the others get none.
            stays = pa.array(fate > 0)
            once = pa.array(np.where(fate == 2, keys.view(np.int64), 0), pa.int64(), mask=fate != 2)
            yield batch.set_column(batch.schema.get_field_index(key), key, once).filter(stays)

    looked = keyed.mapInArrow(tidied(run), StructType([*docs.schema.fields, StructField(key, LongType())]))
    return looked.filter(F.col(key).isNull()).unionByName(looked.filter(F.col(key).isNotNull()).dropDuplicates([key])).drop(key)
