"""What the text operators share: batches of whole texts, shared storage, hashed words."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that a task handles at once; a longer text is a batch of its own.
SLICE_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (spark.checkpoint.dir). Where that is unset, a temporary one if all run on this machine; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, what: str, codec: str = "snappy") -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: a lost executor never recomputes what came before."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of whole texts that Spark hands to Python at once.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches: rows here are whole texts, and the default of 10,000 of them takes hundreds of megabytes a task."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once a row, however often a lambda inside refers to it."""
    return F.transform(F.array(value), body)[0]


def remainder(doc_id: str, n: int) -> Column:
    """crc32 of the id as text modulo n; 1 for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % n, F.lit(1))


def slices(batch: pa.RecordBatch, text: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with up to about `most` bytes of text each, so that memory does not follow the longest batch."""
    if not batch.num_rows:
        return
    sizes = pc.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes) // most
    starts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(starts, starts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which a worker that is kept for later tasks gives freed memory back to the system."""

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:
                trim(0)

    return tidy


def map_texts(docs: DataFrame, work: Callable[[list, list], dict], schema: str, doc_id: str = "doc_id", text: str = "text", prepare: Callable[[], object] | None = None, most: int = SLICE_BYTES) -> DataFrame:
    """Applies work(ids, texts) -> columns to slices of whole texts. Only the id and the text are sent to Python; null texts come as ''. With prepare, work gets its result first."""
    small_batches(docs.sparkSession)
    picked = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    out = StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        to = to_arrow_schema(out)
        state = (prepare(),) if prepare else ()
        for batch in batches:
            for part in slices(batch, most=most):
                got = work(*state, part.column("doc_id").to_pylist(), part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array(got[f.name], type=f.type) for f in to], schema=to)

    return picked.mapInArrow(tidied(run), out)


# --- hashed words -----------------------------------------------------------

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def mix(h: np.ndarray) -> np.ndarray:
    """The finisher of splitmix64, a bijection of 64-bit values."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


_POWERS = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, 0 to n - 1."""
    if len(_POWERS["up"]) < n:
        size = 1 << int(n - 1).bit_length()
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"][:n], _POWERS["down"][:n]


#: Bytes hashed at once, of several texts or of one: the arrays of 64-bit values take some thirty times as much.
_HASHED_BYTES = 1 << 19
_BLANK = re.compile(rb"[\x20\x09-\x0D]")


def _pieces(raw: bytes) -> Iterator[bytes]:
    """A text in parts of _HASHED_BYTES, cut at white space, so that every word is whole in one."""
    at = 0
    while len(raw) - at > _HASHED_BYTES:
        blank = _BLANK.search(raw, at + _HASHED_BYTES)
        end = blank.start() if blank else len(raw)
        yield raw[at:end]
        at = end
    yield raw[at:]


def hashed_words(texts: list[str], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts in order, and each text's first place in them (one more at the end). Lower-cases A-Z. A long text is hashed in parts, so memory follows its words and its longest word."""
    found: list[np.ndarray] = []
    words = np.zeros(len(texts), np.int64)
    held: list[bytes] = []
    owners: list[int] = []
    size = 0

    def done() -> None:
        h, begin = _hashed(held, lower)
        found.append(h)
        np.add.at(words, owners, np.diff(begin))

    for k, t in enumerate(texts):
        for part in _pieces(t.encode("utf-8", "surrogatepass")):
            held.append(part)
            owners.append(k)
            size += len(part)
            if size >= _HASHED_BYTES:
                done()
                held, owners, size = [], [], 0
    if held:
        done()
    first = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(words, out=first[1:])
    return np.concatenate([np.zeros(0, np.uint64), *found]), first


def _hashed(raw: list[bytes], lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Numpy over bytes only: a prefix sum of byte * base**place gives each word's polynomial."""
    joined = b"\n".join(raw) + b"\n"
    if lower:
        joined = joined.translate(_LOWER)
    data = np.frombuffer(joined, np.uint8)
    space = _SPACE[data]
    before = np.empty_like(space)
    before[0] = True
    before[1:] = space[:-1]
    starts = np.flatnonzero(~space & before)
    ends = np.flatnonzero(space & ~before)
    up, down = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    h = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    lengths = np.fromiter((len(r) + 1 for r in raw), np.int64, len(raw))
    offsets = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    return h, np.searchsorted(starts, offsets)
