"""Numpy arrays that travel between tasks packed by hash range, and sorted arrays in the shared folder that workers map into memory."""

from __future__ import annotations

import mmap
import os
import struct
import tempfile
import uuid
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

ROWS = "shard int, part binary, sums array<long>"
_ARROW = pa.schema([("shard", pa.int32()), ("part", pa.binary()), ("sums", pa.list_(pa.int64()))])


def _local(uri: str) -> str | None:
    """The path of a folder that is mounted everywhere, None for other stores."""
    parts = urlparse(uri)
    return parts.path if parts.scheme in ("", "file") else None


def put(folder: str, name: str, data: bytes) -> None:
    """Writes a whole file under its final name at once: a repeated task writes the same again."""
    if (path := _local(folder)) is not None:
        os.makedirs(path, exist_ok=True)
        part = f"{path}/.{name}.{uuid.uuid4().hex}"
        with open(part, "wb") as f:
            f.write(data)
        os.replace(part, f"{path}/{name}")
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    part = f"{path}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(part) as f:
        f.write(data)
    store.move(part, f"{path}/{name}")


def mapped(folder: str, name: str) -> np.ndarray:
    """A file's bytes, mapped. A file that was written and is not there raises, as without it results would be incomplete: which shards have one is known to those that look (`Shards`). From a store that cannot be mapped it is copied to an unnamed local file first, which goes with the worker."""
    if (path := _local(folder)) is not None:
        with open(f"{path}/{name}", "rb") as f:
            return np.frombuffer(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ), np.uint8)
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder)
    with tempfile.TemporaryFile() as f, store.open_input_stream(f"{path}/{name}") as source:
        while block := source.read(8 << 20):
            f.write(block)
        f.flush()
        return np.frombuffer(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ), np.uint8)


class Shards:
    """The files `name-shard` of a folder, mapped as they are needed. `written` tells which shards have one; the others have no key."""

    def __init__(self, folder: str, name: str, written: frozenset[int], *types: str):
        self.folder, self.name, self.written, self.types = folder, name, written, types
        self._open: dict[int, list[np.ndarray]] = {}

    def __getitem__(self, shard: int) -> list[np.ndarray] | None:
        if shard not in self.written:
            return None
        if shard not in self._open:
            self._open[shard] = unpack(mapped(self.folder, f"{self.name}-{shard}"), *self.types)
        return self._open[shard]


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays behind a header of their lengths; wide types first, so that all are aligned."""
    return b"".join([struct.pack(f"<{len(arrays)}q", *map(len, arrays)), *(np.ascontiguousarray(a).tobytes() for a in arrays)])


def unpack(data: np.ndarray | bytes, *types: str) -> list[np.ndarray]:
    data = np.frombuffer(data, np.uint8) if isinstance(data, bytes) else data
    lengths = data[: 8 * len(types)].view("<i8")
    at, out = 8 * len(types), []
    for n, t in zip(lengths.tolist(), types):
        size = n * np.dtype(t).itemsize
        out.append(data[at : at + size].view(t))
        at += size
    return out


def ranges(keys: np.ndarray, bits: int, top: int = 64) -> Iterator[tuple[int, slice]]:
    """The parts of sorted keys (of `top` bits) by their first bits, those that have any."""
    ends = np.searchsorted((keys >> np.uint64(top - bits)).astype(np.int64), np.arange((1 << bits) + 1))
    for s in np.flatnonzero(np.diff(ends)).tolist():
        yield s, slice(ends[s], ends[s + 1])


def runs(sorted_keys: tuple[np.ndarray, ...], n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal keys begin in sorted keys, and the runs' sums of n."""
    new = np.ones(len(n), bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in sorted_keys], axis=0)
    at = np.flatnonzero(new)
    return at, np.add.reduceat(n, at) if len(at) else n


def find(array: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys are in a sorted array, and where."""
    at = np.searchsorted(array, keys)
    hit = array[np.minimum(at, len(array) - 1)] == keys if len(array) else np.zeros(len(keys), bool)
    return hit, at[hit]


def shard_bits(spark: SparkSession, least: int | None = None) -> int:
    """Bits of a hash range per shuffle partition: as many shards as spark.sql.shuffle.partitions asks for, 16 at least."""
    return max(4, (int(least or spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())


def dealt(rows: DataFrame, bits: int) -> DataFrame:
    """ROWS brought to their shards' tasks, in order of shard."""
    return rows.repartition(1 << bits, "shard").sortWithinPartitions("shard")


def by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes], list[list[int]]]]:
    """The shards of a partition of ROWS sorted by shard, one at a time."""
    now, parts, sums = None, [], []
    for batch in batches:
        for shard, part, x in zip(batch.column("shard").to_pylist(), batch.column("part").to_pylist(), batch.column("sums").to_pylist()):
            if shard != now and now is not None:
                yield now, parts, sums
                parts, sums = [], []
            now = shard
            if part:
                parts.append(part)
            if x:
                sums.append(x)
    if now is not None:
        yield now, parts, sums


def batches_of(rows: Iterator[tuple], schema: pa.Schema = _ARROW, size_at: int = 1) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of a few megabytes."""
    held: list[tuple] = []
    size = 0
    make = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
    for r in rows:
        held.append(r)
        size += 64 + len(r[size_at])
        if size > 8 << 20:
            yield make()
            held, size = [], 0
    if held:
        yield make()
