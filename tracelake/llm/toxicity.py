"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text's features are the distinct n-grams of its characters (code points, case folded in every script;
ASCII that is no letter is a space), hashed into buckets. On a bounded sample of labelled rows, each
bucket's ratio r = log((pos + a) / (P + 2 a)) - log((neg + a) / (N + 2 a)) is counted in Spark, pos and neg
the toxic and other rows that hold it of P and N; the buckets that tell the classes apart best are
selected, and a logistic regression is fitted on presence * r. Scoring looks every n-gram of a whole text up in one table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import map_texts, materialize, remainder, slices, small_batches, tidied

SIZES = (3, 4, 5, 6)
BITS = 20
#: At most so many labelled rows are learned from (the rows of smallest id hash), and so many buckets kept.
SAMPLE = 16_000
KEPT = 4_000
#: A bucket is kept only if so many rows of the sample hold it: this share of its toxic rows, within these bounds.
LEAST_SHARE, LEAST_ROWS = 0.02, (2, 6)
ALPHA = 0.5
L2 = 0.2
ROUNDS = 300
#: Bytes of text scored at once: the arrays of n-grams take some forty times as much.
SCORED_BYTES = 1 << 19
#: Characters of one text that are hashed at once; a longer one goes in windows that overlap by the longest n-gram but one character.
WINDOW = 1 << 18


class Model(NamedTuple):
    buckets: np.ndarray  # sorted
    weights: np.ndarray  # coefficient * ratio
    bias: float


def grams(data: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each n, the bucket of the n-gram at each place of an array of code points."""
    hashes, done = np.zeros(len(data), np.uint64), 0
    for n in SIZES:
        m = len(data) - n + 1
        if m <= 0:
            return
        for k in range(done, n):
            hashes[:m] = hashes[:m] * np.uint64(0x9E3779B97F4A7C15) + data[k : k + m] + np.uint64(1)
        done = n
        x = hashes[:m] ^ hashes[:m] >> np.uint64(29)
        yield n, ((x + np.uint64(n)) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - BITS)).astype(np.int32)


def characters(text: str) -> np.ndarray:
    """Code points of a text between two spaces: case folded, ASCII but letters as spaces, one for a run of them."""
    data = np.frombuffer(f" {text.casefold()} ".encode("utf-32-le", "surrogatepass"), "<u4")
    space = (data < 128) & ((data < 97) | (data > 122))
    again = space.copy()
    again[1:] &= space[:-1]
    again[0] = False
    return np.where(space, np.uint32(32), data)[~again]


def windows(data: np.ndarray) -> Iterator[np.ndarray]:
    """Parts of an array of code points that hold each of its n-grams whole, once or more."""
    for k in range(0, max(len(data) - SIZES[-1] + 1, 1), WINDOW):
        yield data[k : k + WINDOW + SIZES[-1] - 1]


def features(text: str) -> np.ndarray:
    """Distinct buckets of a text, sorted."""
    seen = np.zeros(0, np.int32)
    for part in windows(characters(text)):
        seen = np.unique(np.concatenate([seen, *(b for _, b in grams(part))]))
    return seen


def fit(rows: list[np.ndarray], labels: np.ndarray, ratio: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression with L2 by Nesterov steps; rows hold places in ratio. Classes weigh the same in total up to a square root."""
    lengths = np.array([len(r) for r in rows])
    at = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)
    doc = np.repeat(np.arange(len(rows)), lengths)
    x = ratio[at]
    n = len(rows)
    share = labels.mean()
    if n == 0 or share in (0.0, 1.0):
        return np.zeros(len(ratio)), math.log((labels.sum() + 1) / (n - labels.sum() + 1))
    cost = np.where(labels == 1, math.sqrt(0.5 / share), math.sqrt(0.5 / (1 - share)))
    cost *= n / cost.sum()
    w, b = np.zeros(len(ratio)), math.log(share / (1 - share))
    # The step fits the largest curvature, found by a few power iterations.
    v = np.ones(len(ratio)) / math.sqrt(len(ratio))
    for _ in range(12):
        v = np.bincount(at, x * np.bincount(doc, x * v[at], n)[doc], len(ratio))
        size = np.linalg.norm(v)
        v /= size or 1.0
    step = 1 / (0.3 * size * cost.max() / n + 0.3)
    wv, bv, t = w.copy(), b, 1.0
    for _ in range(ROUNDS):
        z = np.bincount(doc, x * wv[at], n) + bv
        g = cost * (1 / (1 + np.exp(-z)) - labels) / n
        w_new = wv - step * (np.bincount(at, x * g[doc], len(ratio)) + L2 * wv / n)
        b_new = bv - step * g.sum()
        t_new = (1 + math.sqrt(1 + 4 * t * t)) / 2
        wv, bv = w_new + (t - 1) / t_new * (w_new - w), b_new + (t - 1) / t_new * (b_new - b)
        w, b, t = w_new, b_new, t_new
    return w, float(b)


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE, kept: int = KEPT, least_rows: tuple[int, int] = LEAST_ROWS, folds: int = 5) -> Model:
    """Learns from labelled rows whose crc32(id) modulo folds is not 0.

    sample: rows learned from at most, those of smallest id hash; so its ids may be broadcast and
    its counts and rows collected. kept: buckets that the model keeps at most, those that tell the
    classes apart best; of equals those of smaller number. least_rows: bounds of the rows that must
    hold a kept bucket, which follow the sample's toxic rows (LEAST_SHARE) between them. Null labels
    are left out; of repeated labels the larger holds; without labelled rows every score is 0.5.
    """
    small_batches(docs.sparkSession)
    known = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("y")).filter(F.col("y").isNotNull() & F.col("id").isNotNull() & (remainder("id", folds) != 0))
    known = known.groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(sample)
    texts = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(known), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, most=SCORED_BYTES):
                found = [features(t) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("y"), pa.array(found, pa.list_(pa.int32()))], names=["id", "y", "buckets"])

    rows = materialize(texts.mapInArrow(tidied(run), "id long, y int, buckets array<int>"), "tox-rows")
    counts = rows.select("y", F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    totals = rows.agg(F.coalesce(F.sum("y"), F.lit(0)).alias("p"), F.count("*").alias("n")).first()
    n_pos, n_neg = totals["p"], totals["n"] - totals["p"]
    counts = counts.filter(F.col("pos") + F.col("neg") >= min(max(round(LEAST_SHARE * n_pos), least_rows[0]), least_rows[1]))
    # By the log likelihood of the row counts: how much better two rates tell the rows than one.
    pos, neg = F.col("pos"), F.col("neg")
    part = lambda k, of: F.when(k > 0, k * F.ln(k / of)).otherwise(F.lit(0.0))
    gain = part(pos, (pos + neg) * float(max(n_pos, 1)) / max(n_pos + n_neg, 1)) + part(neg, (pos + neg) * float(max(n_neg, 1)) / max(n_pos + n_neg, 1))
    best_rows = materialize(counts.select("bucket", "pos", "neg", gain.alias("gain")).orderBy(F.desc("gain"), "bucket").limit(kept), "tox-kept")
    best = best_rows.toPandas().sort_values("bucket")
    buckets = best["bucket"].to_numpy(np.int32)
    if not len(buckets):
        return Model(buckets, np.zeros(0), math.log((n_pos + 1) / (n_neg + 1)))
    ratio = np.log((best["pos"].to_numpy() + ALPHA) / (n_pos + 2 * ALPHA)) - np.log((best["neg"].to_numpy() + ALPHA) / (n_neg + 2 * ALPHA))

    # Each row's kept buckets, picked before they leave Spark.
    known = best_rows.agg(F.collect_list("bucket").alias("kept"))
    got = rows.crossJoin(F.broadcast(known)).select("id", "y", F.array_intersect("buckets", "kept").alias("found")).toArrow().sort_by("id")
    places = [np.searchsorted(buckets, np.array(b, np.int32)) for b in got.column("found").to_pylist()]
    w, bias = fit(places, got.column("y").to_numpy().astype(float), ratio)
    return Model(buckets, w * ratio, bias)


def logits(model: Model, table: np.ndarray, texts: list[str]) -> np.ndarray:
    """Sum of the weights of each text's distinct kept buckets, and the bias. table: a bucket's place in the model or -1."""
    size = len(model.buckets)
    once, held, docs = np.zeros(0, np.int64), [], []

    def counted() -> np.ndarray:
        """What was found so far, with the n-grams of the parts at hand that do not cross from one to the next."""
        data, ends = np.concatenate(held), np.cumsum([len(x) for x in held])
        of, hits = np.array(docs), [once]
        for n, bucket in grams(data):
            place = table[bucket]
            at = np.flatnonzero(place >= 0)
            part = np.searchsorted(ends, at, side="right")
            inside = at + n <= ends[part]
            hits.append(of[part[inside]] * size + place[at[inside]])
        return np.unique(np.concatenate(hits))

    room = WINDOW
    for k, text in enumerate(texts):
        for part in windows(characters(text)):
            if held and len(part) > room:
                once = counted()
                held, docs, room = [], [], WINDOW
            held.append(part)
            docs.append(k)
            room -= len(part)
    if held:
        once = counted()
    z = np.full(len(texts), model.bias)
    if len(once):
        z += np.bincount(once // size, model.weights[once % size], len(texts))
    return z


def _table(model: Model) -> np.ndarray:
    table = np.full(1 << BITS, -1, np.int32)
    table[model.buckets] = np.arange(len(model.buckets), dtype=np.int32)
    return table


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and score (0 to 1) of every row. A null or empty text has no n-grams and gets the score of the bias; repeated rows get equal scores; extra columns are left out."""

    def work(table: np.ndarray, ids: list, texts: list) -> dict:
        return {"doc_id": ids, "score": 1 / (1 + np.exp(-np.clip(logits(model, table, texts), -500, 500)))}

    return map_texts(docs, work, "doc_id long, score double", doc_id, text, prepare=lambda: _table(model), most=SCORED_BYTES)


def reject(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, whose score is below the threshold. A null or empty text has the score of the bias; repeated rows go or stay together; an empty table gives an empty one."""
    small_batches(docs.sparkSession)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(model)
        for batch in batches:
            for part in slices(batch, text, SCORED_BYTES):
                texts = [t or "" for t in part.column(at).to_pylist()]
                yield part.filter(pa.array(1 / (1 + np.exp(-np.clip(logits(model, table, texts), -500, 500))) < threshold))

    return docs.mapInArrow(tidied(run), docs.schema)
