"""Whitening of embeddings by the leading components of their covariance, found by block Lanczos.

Entries become whole numbers, so that sums and deviations are exact. The covariance is never formed: each step multiplies it with a
block of vectors in one distributed pass, sum over rows of c (c . Q) with c a row's centred entries; tasks add up their own rows, Spark adds up
the tasks' sums, and the driver gets one block, of the size of the vectors alone. New blocks are orthogonalised twice against all earlier ones.
Where a block loses rank, random directions orthogonal to all take the place of what broke down. The search ends when the
residuals V u - e u of the wanted components, which the products at hand give, are small, or when the whole space is spanned.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import materialize, workers_import_us

COMPONENTS, BLOCK = 32, 16
SCALE, SHIFT = 64, 1_000_000
#: Entries beyond this, as whole numbers, stand at it: sums of ROWS of them fit 64 bits.
MOST = 1 << 50
#: Residuals, and components without variance, in shares of the largest eigenvalue.
RESIDUAL, NO_VARIANCE = 1e-13, 1e-11
#: Rows whose products a task holds at once.
ROWS = 4096


def finite(vector: Column, size: int) -> Column:
    return vector.isNotNull() & (F.size(vector) == size) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def _matrix(lists: pa.Array, size: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def _totals(rows: DataFrame, x: str, size: int) -> tuple[int, list[int], int, int]:
    """Number of rows; per dimension their sum, exact; the least and the largest entry of all."""

    def add(batches):
        n, total, low, high = 0, [0] * size, MOST, -MOST
        for b in batches:
            own = _matrix(b.column(0), size)
            for a in range(0, len(own), ROWS):
                part = own[a : a + ROWS]
                n, low, high = n + len(part), min(low, int(part.min())), max(high, int(part.max()))
                total = [s + int(t) for s, t in zip(total, part.sum(0), strict=True)]
        if n:
            values = [n, low, high, *total]
            yield pa.RecordBatch.from_arrays([pa.array(range(-3, size), pa.int32()), pa.array([Decimal(v) for v in values], pa.decimal128(38, 0))], names=["at", "v"])

    found = rows.select(x).mapInArrow(add, "at int, v decimal(38,0)").groupBy("at").agg(F.sum("v").cast("decimal(38,0)").alias("sum"), F.min("v").alias("low"), F.max("v").alias("high")).collect()  # size + 3 rows
    by = {r["at"]: r for r in found}
    return (int(by[-3]["sum"]), [int(by[k]["sum"]) for k in range(size)], int(by[-2]["low"]), int(by[-1]["high"])) if by else (0, [], 0, 0)


class Centre:
    """The mean as whole part and rest of n, so that differences from it are exact before they are rounded once."""

    def __init__(self, n: int, sums: list[int], low: int, high: int):
        self.n = n
        self.whole, self.rest = np.array([s // n for s in sums], np.int64), np.array([s % n for s in sums], np.int64)
        far = max(max(high - int(w), int(w) - low) for w in self.whole) + 1
        #: Whether n x - S, its square and the squares' sum fit 64 bits.
        self.fits = (n * far) ** 2 * len(sums) < 1 << 63

    def of(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole) - self.rest / self.n

    def deviations(self, x: np.ndarray) -> pa.Array:
        """Per row the sum of (n x - S)^2; null where it has more than 38 digits."""
        d = x - self.whole
        if self.fits:
            return pa.array(((self.n * d - self.rest) ** 2).sum(1)).cast(pa.decimal128(38, 0), safe=False)
        exact = [sum((self.n * int(v) - int(r)) ** 2 for v, r in zip(row, self.rest, strict=True)) for row in d]
        return pa.array([Decimal(v) if v < 10**38 else None for v in exact], pa.decimal128(38, 0))


def _summed(rows: DataFrame, x: str, size: int, shape: tuple[int, int], of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of of(rows) over all rows: each task adds up its own, Spark adds up the tasks' entries."""

    def add(batches):
        total = np.zeros(shape)
        for b in batches:
            own = _matrix(b.column(0), size)
            for a in range(0, len(own), ROWS):
                total += of(own[a : a + ROWS])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.ravel())], names=["at", "v"])

    found = rows.select(x).mapInArrow(add, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).toPandas()  # as many rows as the shape has entries
    out = np.zeros(shape[0] * shape[1])
    out[found["at"].to_numpy()] = found["v"].to_numpy()
    return out.reshape(shape)


def _orthonormal(block: np.ndarray, basis: np.ndarray, scale: float, rng: np.random.Generator) -> np.ndarray:
    """Columns orthonormal to basis and each other that span block; random ones for those that vanish against scale. Fewer columns where the space is full."""
    out = basis
    for k in range(min(block.shape[1], len(basis) - basis.shape[1])):
        v, least = block[:, k], 1e-10 * scale
        while True:
            for _ in range(2):
                v = v - out @ (out.T @ v)
            norm = float(np.linalg.norm(v))
            if norm > least:
                v = v / norm
                v = v - out @ (out.T @ v)
                out = np.column_stack([out, v / np.linalg.norm(v)])
                break
            v, least = rng.standard_normal(len(v)), 1e-3
    return out[:, basis.shape[1] :]


def block_lanczos(times: Callable[[np.ndarray], np.ndarray], size: int, components: int = COMPONENTS, block: int = BLOCK, seed: int = 11) -> tuple[np.ndarray, np.ndarray, int]:
    """(eigenvalues, falling; unit eigenvectors as columns; passes) of a symmetric matrix that is known by its products with blocks alone.

    components at most; those without variance are left out.
    """
    rng = np.random.default_rng(seed)
    basis = np.zeros((size, 0))
    products = np.zeros((size, 0))
    fresh = _orthonormal(rng.standard_normal((size, block)), basis, 1e-3, rng)
    passes = 0
    while True:
        new = times(fresh)
        passes += 1
        basis, products = np.column_stack([basis, fresh]), np.column_stack([products, new])
        small = basis.T @ products
        value, turn = np.linalg.eigh((small + small.T) / 2)
        value, turn = value[::-1], turn[:, ::-1]
        want = turn[:, :components]
        largest = max(float(value[0]), 0.0)
        residual = np.linalg.norm(products @ want - (basis @ want) * value[:components], axis=0)
        done = basis.shape[1] > components and float(residual.max(initial=0.0)) <= RESIDUAL * largest
        if done or largest == 0.0 or basis.shape[1] == size:
            break
        fresh = _orthonormal(new, basis, max(largest, float(np.abs(new).max())), rng)
    keep = value[:components] > NO_VARIANCE * largest
    vectors = (basis @ want)[:, keep]
    return value[:components][keep], vectors / np.linalg.norm(vectors, axis=0), passes


def whiten(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, block: int = BLOCK) -> DataFrame:
    """(vec_id, n, deviation decimal(38,0), whitened array<double>, explained array<double>, identity_error): a row for each vector that takes part.

    Vectors that are null, empty, of another length than most (of equally frequent lengths the largest counts) or hold null or non-finite components take no part; zero vectors
    and rows that repeat, in id or vector, do. An entry c counts as floor(SCALE c) + SHIFT, no further than MOST from zero. whitened and explained follow the components, by falling eigenvalue;
    directions without variance (NO_VARIANCE of the largest eigenvalue) are no components, so there can be fewer than asked for, and none where
    all vectors are equal. Equal eigenvalues leave their components' directions open; one choice holds for all rows. A deviation of over 38 digits is null. A table without vectors gives no rows.
    """
    spark = vectors.sparkSession
    workers_import_us(spark)
    kind = "vec_id long, n long, deviation decimal(38,0), whitened array<double>, explained array<double>, identity_error double"
    sizes = vectors.where(F.size(vector) > 0).groupBy(F.size(vector).alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    if not sizes:
        return spark.createDataFrame([], kind)
    size = sizes["size"]
    entry = lambda c: F.greatest(F.least(F.floor(c.cast("double") * SCALE), F.lit(MOST)), F.lit(-MOST)) + SHIFT
    rows = materialize(vectors.where(finite(F.col(vector), size)).select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(vector, entry).alias("x")))
    n, sums, low, high = _totals(rows, "x", size)
    if not n:
        return spark.createDataFrame([], kind)
    centre = Centre(n, sums, low, high)
    measured = rows.select("x", "vec_id")

    def product(q: np.ndarray) -> np.ndarray:
        shared = spark.sparkContext.broadcast(q)

        def of(x: np.ndarray) -> np.ndarray:
            c = centre.of(x)
            return c.T @ (c @ shared.value)

        return _summed(measured, "x", size, q.shape, of) / n

    values, axes, _ = block_lanczos(product, size, components, block)
    scaled = axes / np.sqrt(values)
    shared = spark.sparkContext.broadcast(scaled)

    def outer(x: np.ndarray) -> np.ndarray:
        w = centre.of(x) @ shared.value
        return np.column_stack([w.T @ w, w.sum(0)])

    def project(batches):
        for b in batches:
            x = _matrix(b.column(1), size)
            w = centre.of(x) @ shared.value
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * w.shape[1]), pa.array(w.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), centre.deviations(x), lists], names=["vec_id", "deviation", "whitened"])

    placed = materialize(rows.select("vec_id", "x").mapInArrow(project, "vec_id long, deviation decimal(38,0), whitened array<double>"))
    error = 0.0
    if len(values):
        sums_of = _summed(measured, "x", size, (len(values), len(values) + 1), outer) / n
        error = float(np.abs(sums_of[:, :-1] - np.outer(sums_of[:, -1], sums_of[:, -1]) - np.eye(len(values))).max())
    # trace(V) = sum of all deviations / n^3; where one of them has too many digits, the entries' squares are summed as doubles.
    total = placed.agg(F.sum("deviation").alias("sum"), F.count("deviation").alias("known")).first()
    trace = int(total["sum"]) / n**3 if total["known"] == n and total["sum"] is not None else float(_summed(measured, "x", size, (1, 1), lambda x: (centre.of(x) ** 2).sum().reshape(1, 1))[0, 0]) / n
    shares = F.array(*[F.lit(float(e / trace)) for e in values]) if len(values) else F.array().cast("array<double>")
    return placed.select("vec_id", F.lit(n).cast("long").alias("n"), "deviation", "whitened", shares.alias("explained"), F.lit(error).alias("identity_error"))
