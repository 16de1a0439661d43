import math
import random

import numpy as np
import pytest

from tracelake.llm import whitening as W

SCHEMA = "vec_id long, embedding array<double>, n string, component string, whitened double"


def row(i, v):
    return (i, v, "clash", "clash", 0.5)


def vectors(n=300, dims=12, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dims)) @ rng.standard_normal((dims, dims)) + 50
    return x


def brute(rows):
    """Vectors that remain, and their exact integers."""
    good = [(i, v) for i, v, *_ in rows if v and all(c is not None and math.isfinite(c) and abs(64 * c) < 2**53 for c in v)]
    sizes = [len(v) for _, v in good]
    size = max(set(sizes), key=lambda s: (sizes.count(s), s))
    return [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v in good if len(v) == size]


def check(spark, rows, m=32):
    kept = brute(rows)
    n, x = len(kept), np.array([v for _, v in kept], object)
    sums = x.sum(axis=0)
    exact = np.array([[float(sum((n * a - s) * (n * b - t) for a, b in zip(x[:, i], x[:, j])) / n**3) for j, t in enumerate(sums)] for i, s in enumerate(sums)])
    values, vecs = np.linalg.eigh(exact)
    values, vecs = values[::-1][:m], vecs[:, ::-1][:, :m]
    got = W.components(spark.createDataFrame(rows, SCHEMA), m).collect()
    k = len({r["component"] for r in got})
    assert len(got) == n * k and {r["n"] for r in got} == {n}
    assert sorted((r["vec_id"], r["deviation"]) for r in got if r["component"] == 1) == sorted((i, sum((n * a - int(s)) ** 2 for a, s in zip(v, sums))) for i, v in kept)
    assert {r["identity_error"] for r in got} and max(r["identity_error"] for r in got) < 1e-6
    for c in range(k):
        of = {r["vec_id"]: r for r in got if r["component"] == c + 1}
        assert of[kept[0][0]]["explained"] == pytest.approx(values[c] / np.trace(exact), rel=1e-6)
        if min(abs(values[c] - np.delete(values, c)), default=1) > 1e-6 * values[0]:
            want = ((n * x - sums) / n).astype(float) @ vecs[:, c] / np.sqrt(values[c])
            have = np.array([of[i]["whitened"] for i, _ in kept])
            assert min(np.abs(have - want).max(), np.abs(have + want).max()) < 1e-6
    return k


def test_components_by_brute_force(spark):
    rows = [row(i, v) for i, v in enumerate(vectors().tolist())]
    bad = [row(1000, None), row(1001, []), row(1002, [None] + [1.0] * 11), row(1003, [math.nan] + [1.0] * 11), row(1004, [math.inf] * 12), row(1005, [1.0, 2.0]), row(1006, [1e300] * 12)]
    assert check(spark, rows + bad) == 12
    assert check(spark, rows, m=5) == 5


def test_large_offsets_repeats_and_flat_directions(spark):
    x = vectors(60, 6, 2)
    x[:, 3], x[:, 4] = 7.0, x[:, 0] * 2 + 1e6  # a constant dimension, and one of large offset
    x[:, 5] = np.floor(x[:, 1] * 64) / 64
    x[:, 1] = x[:, 5]  # two that are the same
    rows = [row(i, v) for i, v in enumerate(x.tolist())]
    assert check(spark, rows) in (4, 5)  # rounding to whole numbers leaves x[:, 4] some variance of its own


def test_one_vector_has_no_component(spark):
    assert W.components(spark.createDataFrame([row(1, [1.0, 2.0])] * 3, SCHEMA)).collect() == []
    empty = W.components(spark.createDataFrame([row(1, None)], SCHEMA))
    assert empty.collect() == [] and empty.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_null_and_repeated_ids(spark):
    rows = [row(None if i < 5 else i // 2, v) for i, v in enumerate(vectors(40, 3, 5).tolist())]
    got = W.components(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 40 * 3 and sum(r["vec_id"] is None for r in got) == 15


def test_large_entries_are_added_exactly():
    rng = random.Random(1)
    x = np.array([[rng.randint(-(1 << 50), 1 << 50) if k % 7 == 0 else rng.randint(-300, 300) for _ in range(4)] for k in range(5000)], np.int64)
    assert W._products(x).tolist() == (x.astype(object).T @ x.astype(object)).tolist()
    assert W._added(x) == x.astype(object).sum(axis=0).tolist()


def test_deviation_that_is_no_long_is_null():
    n, d = 1 << 20, np.array([[1, 2], [1 << 11, 5], [1 << 12, 1], [2896, 2896]], np.int64)
    known = W.Fit(n, [n * W.OFFSET + 3, n * W.OFFSET - 4], None, None, None)
    exact = [(n * a - 3) ** 2 + (n * b + 4) ** 2 for a, b in d.tolist()]
    assert W._deviations(d, known) == [v if v < 1 << 63 else None for v in exact] and None in W._deviations(d, known)


@pytest.mark.parametrize("kind", ["random", "repeated", "identity", "diagonal", "clusters", "rank"])
def test_eigenvectors(kind):
    rng = np.random.default_rng(3)
    n = 24
    q = np.linalg.qr(rng.standard_normal((n, n)))[0]
    values = {"random": rng.random(n), "repeated": np.repeat([3.0, 2.0, 1.0], 8), "identity": np.ones(n), "diagonal": np.arange(n) + 1.0, "clusters": np.repeat([5.0, 1.0], 12) + 1e-9 * np.arange(n), "rank": np.where(np.arange(n) < 5, 4.0 + np.arange(n), 0)}[kind]
    a = np.diag(values) if kind in ("identity", "diagonal") else (q * values) @ q.T
    a = (a + a.T) / 2
    got, rows = W.components_of(a, 10)
    want = np.sort(np.linalg.eigvalsh(a))[::-1][: len(got)]
    assert len(got) == (10 if kind != "rank" else 5) or kind == "rank"
    assert np.abs(got - want).max() < 1e-12
    assert np.abs(rows @ rows.T - np.eye(len(rows))).max() < 1e-15
    assert np.abs(a @ rows.T - rows.T * got).max() < 1e-12


def test_sturm_counts():
    rng = np.random.default_rng(7)
    d, e = rng.standard_normal(30), rng.standard_normal(29)
    values = np.linalg.eigvalsh(np.diag(d) + np.diag(e, 1) + np.diag(e, -1))
    x = np.linspace(-4, 4, 41)
    assert W.above(d.astype(W.REAL), (e * e).astype(W.REAL), x.astype(W.REAL), W.REAL(1e-300)).tolist() == [(values > v).sum() for v in x]
