"""Rules whose next answer depends on the last one: each key's rows in order, one state a key; in a batch, or as a stream whose state outlives a run."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import Row, StructType


def _cells(column: pa.Array) -> Iterator:
    """A column's values; lists of numbers are views of one numpy array."""
    if not pa.types.is_list(column.type):
        yield from column.to_pylist()
        return
    flat = column.flatten().to_numpy(zero_copy_only=False)
    ends = np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).tolist()
    for a, b, known in zip([0, *ends], ends, column.is_valid().to_pylist()):
        yield flat[a:b] if known else None


def folded(rows: DataFrame, key: str, order: list[str], start: Callable[[], object], step: Callable[[object, tuple], tuple[object, tuple]], schema: str) -> DataFrame:
    """(state, values of a row) -> (state, values of schema) over the rows of every key in order; key is the first column.

    Rows stream through sorted by key; a task holds one state and one batch, however many rows a key
    has. A key's rows are one task's, as each needs the one before it.
    """
    out = to_arrow_schema(StructType.fromDDL(schema))
    rows = rows.select(key, *[c for c in rows.columns if c != key])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, began = None, None, False
        for batch in batches:
            made = []
            for values in zip(*map(_cells, batch.columns)):
                if not began or values[0] != now:
                    now, state, began = values[0], start(), True
                state, answer = step(state, values)
                made.append(answer)
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made), out)], schema=out)

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)


def cosine(a: np.ndarray, b: np.ndarray) -> float:
    """M1 of two vectors; 0 where one has no length."""
    x, y = np.asarray(a, float), np.asarray(b, float)
    size = float(np.linalg.norm(x) * np.linalg.norm(y))
    return float(x @ y) / size if size else 0.0


def deduplicated(feedback: DataFrame, key: str, pos: str, vector: str, limit: float = 0.93) -> DataFrame:
    """Each feedback against the last that was delivered; a suppressed one never becomes the reference. (key, pos, similarity, suppressed); similarity is null for a key's first."""
    rows = feedback.select(key, pos, F.col(vector).cast("array<double>").alias("_v"))

    def step(last: np.ndarray | None, values: tuple):
        k, p, v = values
        similarity = None if last is None else cosine(last, v)
        gone = similarity is not None and similarity >= limit
        return (last if gone else v), (k, p, similarity, gone)

    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return folded(rows, key, [pos], lambda: None, step, f"`{key}` {types[key]}, `{pos}` {types[pos]}, similarity double, suppressed boolean")


#: The loop before a key's first message: steps, steps since the critic was asked, invocations, active answer, delivered answers behind it, the vector last delivered.
_BEGIN = (0, 0, 0, None, 0, None)


def _supervise(state: tuple, pos: object, is_step: bool | None, vector: object, interval: int, limit: float) -> tuple[tuple, tuple]:
    """One message: the state after it, and (steps, invocations, asked, suppressed, active, history)."""
    steps, since, asked, active, history, last = state
    here, suppressed = False, None
    if is_step:
        steps, since = steps + 1, since + 1
        if since == interval:
            since, asked, here = 0, asked + 1, True
            suppressed = last is not None and vector is not None and cosine(last, vector) >= limit
            if not suppressed:
                history, active, last = history + (active is not None), pos, vector
    return (steps, since, asked, active, history, last), (steps, asked, here, suppressed, active, history)


def _supervised_rows(messages: DataFrame, key: str, pos: str, is_step: str, vector: str) -> tuple[DataFrame, str]:
    rows = messages.select(key, pos, is_step, F.col(vector).cast("array<double>").alias("_v"))
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows, f"`{key}` {types[key]}, `{pos}` {types[pos]}, steps long, invocations long, asked boolean, suppressed boolean, active {types[pos]}, history long"


def supervised(messages: DataFrame, key: str, pos: str, is_step: str, vector: str, interval: int = 5, limit: float = 0.93) -> DataFrame:
    """The supervising loop as a state machine over each key's messages.

    Every step counts; after `interval` steps the critic is asked, and its answer (the message's
    vector) is delivered unless it is too near the last that was. Per message: steps so far,
    invocations, whether the critic was asked and suppressed here, the position of the answer that is
    active, and how many delivered answers lie behind it.
    """
    rows, schema = _supervised_rows(messages, key, pos, is_step, vector)

    def step(state: tuple, values: tuple):
        k, p, counts, v = values
        state, answer = _supervise(state, p, counts, v, interval, limit)
        return state, (k, p, *answer)

    return folded(rows, key, [pos], lambda: _BEGIN, step, schema)


class _Loop(StatefulProcessor):
    """The supervising loop's state of a key between batches and runs."""

    def __init__(self, interval: int, limit: float, pos_type: str, names: list[str]):
        self.interval, self.limit, self.pos_type, self.row = interval, limit, pos_type, Row(*names)

    def init(self, handle) -> None:
        self.state = handle.getValueState("loop", f"steps long, since int, asked long, active {self.pos_type}, history long, last array<double>, upto {self.pos_type}")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        kept = self.state.get() if self.state.exists() else None
        state, upto = (tuple(kept)[:6], kept[6]) if kept is not None else (_BEGIN, None)
        # A batch holds a key's rows in any order.
        for _, p, counts, v in sorted(rows, key=lambda r: r[1]):
            if upto is not None and p <= upto:
                continue
            state, answer = _supervise(state, p, counts, v, self.interval, self.limit)
            upto = p
            yield self.row(key[0], p, *answer)
        self.state.update((*state[:5], None if state[5] is None else [float(x) for x in state[5]], upto))

    def close(self) -> None:
        pass


#: The only state store that keeps typed state.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def supervised_stream(messages: DataFrame, key: str, pos: str, is_step: str, vector: str, interval: int = 5, limit: float = 0.93) -> DataFrame:
    """X4 as a stream: the answers of `supervised` for messages as they come, in append mode.

    Counters, the active answer and the vector last delivered are kept in the state store of the
    query's checkpoint, so a later run goes on where the last one ended, on other machines too. A key's
    messages come in order from batch to batch; within one they may be mixed, and are sorted in memory, so
    the trigger's limit of files bounds it. A message at or before the last position that was
    taken counts as delivered again and gives no row, and so does the second of a position.
    """
    rows, schema = _supervised_rows(messages, key, pos, is_step, vector)
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    pos_type = rows.schema[pos].dataType.simpleString()
    out = StructType.fromDDL(schema)
    return rows.filter(F.col(pos).isNotNull()).groupBy(key).transformWithState(_Loop(interval, limit, pos_type, out.names), outputStructType=out, outputMode="Append", timeMode="None")
