"""A table of one row a key that is changed in place: hash buckets, versions, and a ledger of the batches that it holds.

A version is a small file that names, for each bucket, the folder with its rows, and for each stream
the last batch that went in. A change reads and writes only the buckets whose keys it names; all other
buckets stay where they are. Readers take one version and see nothing of a change that is under way.
A version file is made under a name that must not exist yet, so of two writers at once one fails and
does its change again on the other's version.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tracelake.sources.sinks import write_text

#: combine(rows of the touched buckets as they are, changes) -> these rows as they shall be.
Combine = Callable[[DataFrame, DataFrame], DataFrame]


class KeyedTable:
    """The table at `path`, with rows of `schema`. A null key is a key like others. `buckets` holds for a new table; an old one keeps its own."""

    def __init__(self, spark: SparkSession, path: str, schema: str | StructType, key: str, buckets: int = 256):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self.schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
        found = self.manifest()
        self.buckets = found["n_buckets"] if found else buckets

    # --- versions

    def _at(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Numbers of the versions that are kept, rising."""
        folder, fs = self._at(f"{self.path}/versions")
        if not fs.exists(folder):
            return []
        names = (f.getPath().getName() for f in fs.listStatus(folder))
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, version: int | None = None) -> dict | None:
        """A version (the last by default): number, n_buckets, folders by bucket, last batch by stream. None before the first."""
        if version is None:
            known = self.versions()
            if not known:
                return None
            version = known[-1]
        return json.loads("\n".join(r[0] for r in self.spark.read.text(f"{self.path}/versions/{version:09}.json").collect()))

    def rows(self, version: int | None = None, only: set[int] | None = None) -> DataFrame:
        """The rows of one version, of some buckets only if asked."""
        return self._read(self.manifest(version), only)

    def _read(self, now: dict | None, only: set[int] | None = None) -> DataFrame:
        held = now["folders"] if now else {}
        paths = [f"{self.path}/{f}" for b, f in held.items() if only is None or int(b) in only]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    # --- changes

    def change(self, changes: DataFrame, combine: Combine, stream: str | None = None, batch: int | None = None, attempts: int = 5) -> list[int]:
        """Gives the touched buckets (those of the keys of changes) the rows that combine makes of them, as a new version. Returns the buckets.

        With stream and batch, a batch of the stream that is in already, or an earlier one, changes nothing: its number
        is written with the version that holds it, so one cannot be there without the other.
        """
        for attempt in range(attempts):
            now = self.manifest() or {"version": 0, "n_buckets": self.buckets, "folders": {}, "ledger": {}}
            self.buckets = now["n_buckets"]  # another writer may have made the table
            if stream is not None and now["ledger"].get(stream, -1) >= batch:
                return []
            touched = {r[0] for r in changes.select(self.bucket(F.col(self.key)).alias("b")).distinct().collect()}  # as many as buckets at most
            folders = dict(now["folders"])
            if touched:
                made = combine(self._read(now, touched), changes).select(*self.schema.names).withColumn("_bucket", self.bucket(F.col(self.key)))
                name = f"data/{uuid.uuid4().hex}"
                made.repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{name}")
                written = self._buckets_in(f"{self.path}/{name}")
                if written - touched:
                    raise ValueError("combine made keys of buckets that the changes do not touch")
                for b in touched:
                    folders.pop(str(b), None)
                folders |= {str(b): f"{name}/_bucket={b}" for b in written}
            ledger = now["ledger"] | ({stream: batch} if stream is not None else {})
            new = {"version": now["version"] + 1, "n_buckets": self.buckets, "folders": folders, "ledger": ledger}
            try:
                write_text(self.spark, f"{self.path}/versions/{new['version']:09}.json", json.dumps(new), replace=False)
            except FileExistsError:
                if attempt + 1 == attempts:
                    raise
                continue
            return sorted(touched)
        return []

    def _buckets_in(self, folder: str) -> set[int]:
        p, fs = self._at(folder)
        names = (f.getPath().getName() for f in fs.listStatus(p))
        return {int(n.split("=")[1]) for n in names if n.startswith("_bucket=")}

    def _same_key(self, a: DataFrame, b: DataFrame) -> Column:
        return a[self.key].eqNullSafe(b[self.key])

    def upsert(self, changes: DataFrame, order: str | None = None, **batch) -> list[int]:
        """Rows of changes take the place of those of their keys; of a key's several the last by order, which is no column of the table or one of it."""

        def combine(now: DataFrame, new: DataFrame) -> DataFrame:
            row = F.struct(*self.schema.names)
            last = new.groupBy(self.key).agg((F.max_by(row, F.col(order)) if order else F.any_value(row)).alias("_r")).select("_r.*")
            return now.join(last, self._same_key(now, last), "left_anti").unionByName(last)

        return self.change(changes, combine, **batch)

    def delete(self, keys: DataFrame, **batch) -> list[int]:
        """Rows of the given keys go; keys that are not there change nothing but the version."""
        return self.change(keys.select(self.key), lambda now, gone: now.join(gone, self._same_key(now, gone), "left_anti"), **batch)

    def add(self, changes: DataFrame, **batch) -> list[int]:
        """Counters: every column but the key is a sum that the changes are added to. Only with stream and batch is it safe to give a batch again."""
        sums = [F.sum(c).alias(c) for c in self.schema.names if c != self.key]
        return self.change(changes, lambda now, new: now.unionByName(new.select(*self.schema.names)).groupBy(self.key).agg(*sums), **batch)

    def clean(self, keep: int = 2) -> int:
        """Removes versions but the last `keep`, and folders that none of these names. Not while changes run. Returns how many data folders went."""
        known = self.versions()
        kept = [self.manifest(v) for v in known[-keep:]]
        used = {f.rsplit("/", 1)[0] for m in kept for f in m["folders"].values()}
        for v in known[:-keep]:
            p, fs = self._at(f"{self.path}/versions/{v:09}.json")
            fs.delete(p, False)
        top, fs = self._at(f"{self.path}/data")
        gone = [f.getPath() for f in fs.listStatus(top) if f"data/{f.getPath().getName()}" not in used] if fs.exists(top) else []
        for p in gone:
            fs.delete(p, True)
        return len(gone)
