"""Whitening of vectors by the leading components of their covariance.

Entries are made whole numbers, so sums and the covariance are exact: tasks centre their vectors on the
whole number next to the mean before they multiply, entries of the products are added up by Spark,
and the rest of the centring, under half a unit, is done once on the sums. The driver holds one matrix
of dimensions by dimensions. It is brought to tridiagonal form by Householder reflections, the
leading eigenvalues come from bisection on Sturm counts, and their vectors from inverse iteration that
is reorthogonalised within clusters. Every vector is then projected where it lies.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal, localcontext
from fractions import Fraction
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tracelake.llm.common import materialize, tidied

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 32
#: Whole numbers up to this are exact as doubles; a vector with a scaled entry beyond it is left out.
EXACT = float(1 << 53)
#: Centred entries up to this are multiplied as doubles, so many rows at a time that every sum is exact.
PLAIN = 1 << 20
ROWS = 1 << 12
REAL = np.longdouble


# --- eigenvalues and vectors of one small matrix --------------------------------


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, subdiagonal and the unit vectors of the Householder reflections that bring a symmetric matrix there."""
    a = matrix.astype(REAL)
    n, vectors = len(a), []
    for k in range(n - 2):
        u = a[k + 1 :, k].copy()
        size = np.sqrt(u @ u)
        u[0] += size if u[0] >= 0 else -size
        norm = np.sqrt(u @ u)
        if norm == 0:
            vectors.append(u)
            continue
        u /= norm
        b = a[k + 1 :, k + 1 :]
        p = b @ u
        q = p - (u @ p) * u
        b -= 2 * (np.outer(u, q) + np.outer(q, u))
        a[k + 1 :, k] -= 2 * u * (u @ a[k + 1 :, k])
        vectors.append(u)
    return np.diagonal(a).copy(), np.diagonal(a, -1).copy(), vectors


def above(d: np.ndarray, e2: np.ndarray, x: np.ndarray, least: REAL) -> np.ndarray:
    """Sturm counts: how many eigenvalues lie above each x. e2: squares of the subdiagonal."""
    q = d[0] - x
    n = (q > 0).astype(np.int64)
    for k in range(1, len(d)):
        q = np.where(np.abs(q) < least, -least, q)
        q = d[k] - x - e2[k - 1] / q
        n += q > 0
    return n


def leading(d: np.ndarray, e: np.ndarray, m: int) -> np.ndarray:
    """The m greatest eigenvalues, falling: all are bisected side by side."""
    side = np.abs(np.concatenate([[0], e])) + np.abs(np.concatenate([e, [0]]))
    low, high = (d - side).min(), (d + side).max()
    eps = np.finfo(REAL).eps
    least = max(eps * eps * max(abs(low), abs(high)), np.finfo(REAL).tiny)
    lo, hi, wanted = np.full(m, low, REAL), np.full(m, high, REAL), np.arange(m)
    for _ in range(2 * np.finfo(REAL).nmant + 20):
        mid = (lo + hi) / 2
        more = above(d, e * e, mid, least) > wanted
        lo, hi = np.where(more, mid, lo), np.where(more, hi, mid)
        if (hi - lo <= 2 * eps * np.maximum(np.abs(lo), np.abs(hi))).all():
            break
    return (lo + hi) / 2


def _solved(d: np.ndarray, e: np.ndarray, shift: REAL, b: np.ndarray, least: REAL) -> np.ndarray:
    """x of (T - shift) x = b by elimination with row interchanges; b is used up."""
    n = len(d)
    main, up, far = d - shift, np.append(e, REAL(0)), np.zeros(n, REAL)
    for k in range(n - 1):
        below, next_main, next_up = e[k], main[k + 1], up[k + 1]
        if abs(below) > abs(main[k]):
            factor = main[k] / below
            main[k + 1], up[k + 1] = up[k] - factor * next_main, -factor * next_up
            main[k], up[k], far[k] = below, next_main, next_up
            b[k], b[k + 1] = b[k + 1], b[k] - factor * b[k + 1]
        else:
            if abs(main[k]) < least:
                main[k] = least
            factor = below / main[k]
            main[k + 1] = next_main - factor * up[k]
            b[k + 1] -= factor * b[k]
    if abs(main[-1]) < least:
        main[-1] = least
    for k in range(n - 1, -1, -1):
        x = b[k]
        if k + 1 < n:
            x -= up[k] * b[k + 1]
        if k + 2 < n:
            x -= far[k] * b[k + 2]
        b[k] = x / main[k]
    return b


def vectors_of(d: np.ndarray, e: np.ndarray, values: np.ndarray, steps: int = 4) -> np.ndarray:
    """Unit eigenvectors (rows) of the tridiagonal matrix for falling values. Those of values within a thousandth of its norm of their neighbours are one cluster, made orthogonal at every step."""
    n, eps = len(d), np.finfo(REAL).eps
    norm = max((np.abs(d) + np.abs(np.append(e, 0)) + np.abs(np.insert(e, 0, 0))).max(), np.finfo(REAL).tiny)
    rng, out, cluster, shift = np.random.default_rng(12), np.zeros((len(values), n), REAL), 0, None
    for j, value in enumerate(values):
        if j and values[j - 1] - value > norm / 1000:
            cluster = j
        # Equal values are set apart by a few units, else their iterations are the same.
        shift = value if shift is None or j == cluster else min(value, shift - 10 * eps * norm)
        x = rng.standard_normal(n).astype(REAL)
        for _ in range(steps):
            x = _solved(d, e, shift, x / np.sqrt(x @ x), eps * norm)
            x /= np.abs(x).max()
            for _ in range(2):
                for y in out[cluster:j]:
                    x -= (x @ y) * y
        out[j] = x / np.sqrt(x @ x)
    return out


def components_of(matrix: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """The m leading eigenvalues of a symmetric matrix, falling, and their unit vectors as rows, the largest entry of each positive. Values that rounding may have made are left out."""
    if not len(matrix):
        return np.zeros(0, REAL), np.zeros((0, 0), REAL)
    d, e, reflections = tridiagonal(matrix)
    values = leading(d, e, min(m, len(d)))
    values = values[values > values[0] * len(d) * np.finfo(REAL).eps * 1e4] if values[0] > 0 else values[:0]
    rows = vectors_of(d, e, values)
    for k in range(len(reflections) - 1, -1, -1):
        u, part = reflections[k], rows[:, k + 1 :]
        part -= 2 * np.outer(part @ u, u)
    for r in rows:
        r /= np.sqrt(r @ r) * (1 if r[np.argmax(np.abs(r))] > 0 else -1)
    return values, rows


# --- vectors in batches -----------------------------------------------------------


def _whole(batch: pa.RecordBatch, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length of vector in a batch: rows, and floor(scale * entry) of those that hold finite numbers only."""
    column = batch.column(1)
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(sizes > 0)
    flat = column.flatten()
    values = np.floor(flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False) * float(scale))
    ends = np.cumsum(sizes)
    if not len(rows):
        return
    with np.errstate(invalid="ignore"):
        good = np.logical_and.reduceat(np.abs(values) <= EXACT, (ends - sizes)[rows])
    for size in np.unique(sizes[rows]):
        at = rows[(sizes[rows] == size) & good]
        if len(at):
            yield at, values[(ends - sizes)[at][:, None] + np.arange(size)].astype(np.int64)


def _added(x: np.ndarray) -> list[int]:
    """Exact column sums of whole numbers up to EXACT."""
    return [sum(int(part) for part in column) for column in zip(*(x[k : k + 512].sum(axis=0).tolist() for k in range(0, len(x), 512)))]


def _products(x: np.ndarray) -> np.ndarray:
    """Exact x.T @ x of whole numbers, as Python's integers."""
    out = np.zeros((x.shape[1],) * 2, object)
    small = np.abs(x).max(axis=1) <= PLAIN
    plain = x[small].astype(np.float64)
    for k in range(0, len(plain), ROWS):
        part = plain[k : k + ROWS]
        out += (part.T @ part).astype(np.int64).astype(object)
    for row in x[~small].astype(object):
        out += np.outer(row, row)
    return out


def _numbers(values: list, places: int = 0) -> pa.Array:
    return pa.array(values, pa.decimal128(38, places))


class Fit(NamedTuple):
    """What is known of the fit list: rows, exact sums of x by dimension, covariance as doubles or wider, eigenvalues and unit vectors (rows)."""

    n: int
    sums: list[int]
    trace: Fraction
    values: np.ndarray
    vectors: np.ndarray

    @property
    def centre(self) -> np.ndarray:
        """The whole number next to each mean of the scaled entries (without the offset)."""
        return np.array([(2 * (s - self.n * OFFSET) + self.n) // (2 * self.n) for s in self.sums], np.int64)

    @property
    def rest(self) -> list[int]:
        """n times mean minus centre, up to n / 2."""
        return [s - self.n * OFFSET - self.n * int(k) for s, k in zip(self.sums, self.centre)]

    @property
    def explained(self) -> list[float]:
        return [float(Fraction(np.format_float_scientific(e, precision=25)) / self.trace) for e in self.values]


def _picked(rows: DataFrame, vec_id: str, vector: str) -> DataFrame:
    return rows.select(F.col(vec_id).alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))


def _real(x: int) -> np.longdouble:
    """A Python integer of up to some hundred bits as a wide float."""
    high = x >> 62
    return np.ldexp(REAL(high >> 62), 124) + np.ldexp(REAL(high & (1 << 62) - 1), 62) + REAL(x & (1 << 62) - 1)


def fit(rows: DataFrame, m: int = COMPONENTS, scale: int = SCALE, vec_id: str = "vec_id", vector: str = "embedding") -> Fit | None:
    """The fit list and its m leading components; None where no row remains. Two scans; what meets on the driver is a few numbers for each pair of dimensions."""
    picked = _picked(rows, vec_id, vector)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple[int, list[int]]] = {}
        for batch in batches:
            for at, x in _whole(batch, scale):
                n, s = found.get(x.shape[1], (0, [0] * x.shape[1]))
                found[x.shape[1]] = n + len(at), [a + b for a, b in zip(s, _added(x))]
        for size, (n, s) in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([size] * size, pa.int32()), pa.array(range(size), pa.int32()), pa.array([n] * size, pa.int64()), _numbers(s)], ["size", "i", "n", "s"])

    sums = picked.mapInArrow(tidied(summed), "size int, i int, n long, s decimal(38,0)").groupBy("size", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    sums = materialize(sums, "whitening-sums")
    most = sums.filter("i = 0").agg(F.max(F.struct("n", "size")).alias("x")).select("x.*").first()
    if most["n"] is None:
        return None
    n, size = most["n"], most["size"]
    sums = [int(r["s"]) + n * OFFSET for r in sums.filter(F.col("size") == size).orderBy("i").collect()]
    known = Fit(n, sums, Fraction(0), np.zeros(0), np.zeros((0, 0)))
    centre, rest = known.centre, known.rest
    i, j = np.triu_indices(size)

    def multiplied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size), object)
        for batch in batches:
            for _, x in _whole(batch, scale):
                if x.shape[1] == size:
                    total += _products(x - centre)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), _numbers(total[i, j].tolist())], ["i", "j", "p"])

    added = picked.mapInArrow(tidied(multiplied), "i int, j int, p decimal(38,0)").groupBy("i", "j").agg(F.sum("p").alias("p")).collect()
    matrix, trace = np.zeros((size, size), REAL), 0
    for r in added:
        exact = n * int(r["p"]) - rest[r["i"]] * rest[r["j"]]  # n^2 times the covariance
        matrix[r["i"], r["j"]] = matrix[r["j"], r["i"]] = _real(exact) / REAL(n) / REAL(n)
        trace += exact if r["i"] == r["j"] else 0
    values, vectors = components_of(matrix, m)
    return Fit(n, sums, Fraction(trace, n * n), values, vectors)


def _projection(known: Fit) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centre, what is left of the mean, and the matrix that whitens."""
    rest = np.array([float(Fraction(r, known.n)) for r in known.rest])
    return known.centre, rest, (known.vectors / np.sqrt(known.values)[:, None]).astype(np.float64).T


def identity_error(rows: DataFrame, known: Fit, scale: int = SCALE, vec_id: str = "vec_id", vector: str = "embedding") -> float:
    """The largest absolute entry of the whitened vectors' covariance minus the identity, from one more scan. Sums are decimals, so that their order does not matter."""
    centre, rest, by = _projection(known)
    k = by.shape[1]
    if not k:
        return 0.0
    i, j = np.triu_indices(k)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, sums = np.zeros((k, k)), np.zeros(k)
        for batch in batches:
            for _, x in _whole(batch, scale):
                if x.shape[1] == len(centre):
                    y = ((x - centre) - rest) @ by
                    total, sums = total + y.T @ y, sums + y.sum(axis=0)
        values = [Decimal(repr(v)) for v in [*total[i, j].tolist(), *sums.tolist()]]
        with localcontext() as c:
            c.prec = 60
            values = [v.quantize(Decimal(1).scaleb(-16)) for v in values]
        yield pa.RecordBatch.from_arrays([pa.array([*i, *range(k)], pa.int32()), pa.array([*j, *[-1] * k], pa.int32()), _numbers(values, 16)], ["i", "j", "p"])

    got = _picked(rows, vec_id, vector).mapInArrow(tidied(measured), "i int, j int, p decimal(38,16)").groupBy("i", "j").agg(F.sum("p").alias("p")).collect()
    of = {(r["i"], r["j"]): float(r["p"]) / known.n for r in got}
    return max(abs(of[a, b] - of[a, -1] * of[b, -1] - (a == b)) for a, b in zip(i.tolist(), j.tolist()))


def _deviations(d: np.ndarray, known: Fit) -> list[int | None]:
    """Sums over dimensions of (n * x - S) ** 2, null where one takes more than a long. 64-bit arithmetic is exact modulo 2 ** 64, so only sums near the limit need more."""
    n, rest = known.n, known.rest
    rough = ((n * d.astype(np.float64) - np.array(rest, np.float64)) ** 2).sum(axis=1)
    with np.errstate(over="ignore"):
        t = d.astype(np.uint64) * np.uint64(n) - np.array([r % (1 << 64) for r in rest], np.uint64)
        exact = (t * t).sum(axis=1, dtype=np.uint64)
    limit, out = float(1 << 63), []
    for k, (about, value) in enumerate(zip(rough.tolist(), exact.tolist())):
        if about > 0.999 * limit:
            value = sum((n * int(x) - r) ** 2 for x, r in zip(d[k].tolist(), rest)) if about < 1.001 * limit else 1 << 63
        out.append(value if value < 1 << 63 else None)
    return out


def whitened(rows: DataFrame, known: Fit, scale: int = SCALE, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, deviation and whitened (array of doubles, a component each) of the rows that remain."""
    centre, rest, by = _projection(known)
    out = StructType([_picked(rows, vec_id, vector).schema["vec_id"], *StructType.fromDDL("deviation long, whitened array<double>")])

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in _whole(batch, scale):
                if x.shape[1] == len(centre):
                    d = x - centre
                    y = (d - rest) @ by
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1) * y.shape[1], pa.int32()), pa.array(y.ravel()))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(_deviations(d, known), pa.int64()), lists], ["vec_id", "deviation", "whitened"])

    return _picked(rows, vec_id, vector).mapInArrow(tidied(projected), out)


def components(rows: DataFrame, m: int = COMPONENTS) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained and identity_error for every row that remains and each of up to m components.

    Left out are rows whose vector is null, empty or holds a null, an infinite or undefined number or
    one whose scaled form is no exact double, and rows of another length than most (of equally many
    the longer). Repeated rows, null ids and ties all count. Directions without variance have no component, so a
    table of one vector, or of none, gives no rows. deviation is null where it takes more than a long.
    Other columns are not read, so their names cannot clash.
    """
    known = fit(rows, m)
    if known is None:
        return rows.sparkSession.createDataFrame([], StructType([_picked(rows, "vec_id", "embedding").schema["vec_id"], *StructType.fromDDL("component int, n long, deviation long, whitened double, explained double, identity_error double")]))
    error = identity_error(rows, known)
    each = whitened(rows, known).select("vec_id", "deviation", F.posexplode("whitened").alias("k", "whitened"))
    explained = F.array(*[F.lit(x) for x in known.explained]) if known.explained else F.array().cast("array<double>")
    return each.select("vec_id", (F.col("k") + 1).alias("component"), F.lit(known.n).cast("long").alias("n"), "deviation", "whitened", F.get(explained, F.col("k")).alias("explained"), F.lit(error).alias("identity_error"))
