"""Whitening against numpy's eigenvectors of the explicit covariance, with whole numbers by Python."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from atlasframe.llm import queries, whitening

from . import cases


def whole(vector):
    return [int(np.floor(64 * float(c))) + 1_000_000 for c in vector]


def check(rows, vectors, components=32):
    """rows of whiten() against vectors, a list of (id, entries) that take part."""
    x = np.array([whole(v) for _, v in vectors], object)
    n, sums = len(x), x.sum(0)
    scaled = n * x - sums
    centred = (scaled / n).astype(float)
    cov = centred.T @ centred / n
    value, axis = np.linalg.eigh(cov)
    value, axis = value[::-1], axis[:, ::-1]
    kept = min(components, int((value > 1e-11 * value[0]).sum()))
    assert len(rows) == n and {r["n"] for r in rows} == {n} and {len(r["whitened"]) for r in rows} == {kept} == {len(r["explained"]) for r in rows}
    assert sorted((r["vec_id"], int(r["deviation"])) for r in rows) == sorted((i, sum(int(v) ** 2 for v in d)) for (i, _), d in zip(vectors, scaled, strict=True))
    assert len({r["identity_error"] for r in rows}) == 1 and rows[0]["identity_error"] < 1e-9
    np.testing.assert_allclose(rows[0]["explained"], value[:kept] / value.sum(), rtol=1e-9)
    order = np.argsort([i for i, _ in vectors], kind="stable")
    got = np.array([r["whitened"] for r in sorted(rows, key=lambda r: (r["vec_id"], r["deviation"], r["whitened"]))])
    want = centred @ axis[:, :kept] / np.sqrt(value[:kept])
    if len(np.unique([i for i, _ in vectors])) == n:
        for k in range(kept):
            own, other = got[:, k], want[order, k]
            gap = min((abs(value[k] - value[j]) for j in range(len(value)) if j != k), default=value[0]) / value[0]
            if gap > 1e-6:  # equal eigenvalues leave directions open
                assert min(np.abs(own - other).max(), np.abs(own + other).max()) < 1e-7
    return kept


def frame(spark, rows):
    return spark.createDataFrame([(i, v if v is None else [None if c is None else float(c) for c in v], 3, "a") for i, v in rows], "vec_id long, embedding array<double>, n int, x string")


def vectors(n, size, seed=1, rank=None):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n, rank or size)) * np.linspace(3, 0.2, rank or size)
    return [(k, row.tolist()) for k, row in enumerate(base @ np.linalg.qr(rng.standard_normal((size, rank or size)))[0].T)]


@pytest.mark.parametrize(("n", "size", "block"), [(500, 40, 16), (300, 7, 16), (200, 64, 5), (20, 33, 4), (1, 3, 16), (40, 1, 16)])
def test_equals_numpy(spark, n, size, block):
    rows = vectors(n, size)
    got = whitening.whiten(frame(spark, rows).repartition(3), block=block).collect()
    if n == 1:
        assert [(int(r["deviation"]), r["whitened"], r["explained"], r["identity_error"]) for r in got] == [(0, [], [], 0.0)]
    else:
        assert check(got, rows) == min(32, size, n - 1)


def test_rows_that_take_part(spark):
    rows = vectors(60, 6)
    odd = [(100, None), (101, []), (102, [1.0, None, 2.0, 3.0, 4.0, 5.0]), (103, [float("nan")] * 6), (104, [float("-inf")] + [0.0] * 5), (105, [1.0] * 5)]
    kept = [(106, [0.0] * 6), (7, rows[7][1]), (7, rows[7][1]), (7, rows[8][1])]
    assert check(whitening.whiten(frame(spark, rows + odd + kept)).collect(), rows + kept) == 6


def test_directions_without_variance_and_equal_vectors(spark):
    rng = np.random.default_rng(3)
    flat = [(k, [float(a), 2.0 * a, 5.0, float(b)]) for k, (a, b) in enumerate(rng.integers(-5, 5, (80, 2)))]
    assert check(whitening.whiten(frame(spark, flat)).collect(), flat) == 2
    same = whitening.whiten(frame(spark, [(k, [1.0, 2.0]) for k in range(9)])).collect()
    assert [(r["whitened"], int(r["deviation"])) for r in same] == [([], 0)] * 9
    third = vectors(60, 5) + [(k, [0.5] * 5) for k in range(60, 100)]
    assert check(whitening.whiten(frame(spark, third)).collect(), third) == 5


def test_entries_far_from_zero_stay_exact(spark):
    rows = [(k, [1e9 * (k % 7), -3e9 * k, 0.25 * k]) for k in range(30)]
    got = whitening.whiten(frame(spark, rows)).collect()
    x = np.array([whole(v) for _, v in rows], object)
    scaled = len(x) * x - x.sum(0)
    assert sorted((r["vec_id"], int(r["deviation"])) for r in got) == [(k, sum(v * v for v in d)) for k, d in enumerate(scaled.tolist())]
    assert all(np.isfinite(r["identity_error"]) for r in whitening.whiten(frame(spark, [*rows, (99, [1e300, -1e300, 1.0])])).collect())


def test_breakdown_and_passes_without_spark():
    """Blocks that lose rank go on with random directions; a fast falling spectrum needs few passes of many dimensions."""
    rng = np.random.default_rng(2)
    q = np.linalg.qr(rng.standard_normal((400, 400)))[0]
    falling = np.concatenate([2.0 ** -np.arange(40), np.full(360, 1e-9)])
    value, axis, passes = whitening.block_lanczos(lambda b: (q * falling) @ (q.T @ b), 400, 12, 8)
    np.testing.assert_allclose(value, falling[:12], rtol=1e-11)
    np.testing.assert_allclose(np.abs((axis * q[:, :12]).sum(0)), 1, atol=1e-11)
    assert passes < 20
    few = np.concatenate([np.full(3, 5.0), np.full(2, 2.0), np.zeros(45)])
    p = np.linalg.qr(rng.standard_normal((50, 50)))[0]
    value, axis, _ = whitening.block_lanczos(lambda b: (p * few) @ (p.T @ b), 50, 32, 8)
    np.testing.assert_allclose(value, [5, 5, 5, 2, 2], rtol=1e-12)
    np.testing.assert_allclose(axis.T @ axis, np.eye(5), atol=1e-12)


def test_whole_query(spark):
    table = cases.small(spark, "embeddings")
    rows = [(r["vec_id"], r["embedding"]) for r in table.collect()]
    check(whitening.whiten(table).collect(), rows)
    got = queries.op11_whitening(spark, cases.SMALL)
    assert dict(got.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    assert got.count() == 32 * len(rows) and got.agg(F.min("component"), F.max("component")).first() == (1, 32)


def test_empty_table(spark):
    assert whitening.whiten(frame(spark, [])).count() == 0
    assert whitening.whiten(frame(spark, [(1, None), (2, [])])).count() == 0
