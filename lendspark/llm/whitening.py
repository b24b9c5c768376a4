"""Whitening of embeddings by polarisation of exact variances.

For integers the variance of a sum of two dimensions says their covariance:
cov(i, j) = (var(i + j) - var(i) - var(j)) / 2. So squares of centred values
are all that is aggregated, one sum for each dimension and each pair of
dimensions. They are exact integers, taken from values that are centred at the
integer next to their mean; the rest of the mean is put right in the end by
exact arithmetic on the driver, which sees d (d + 1) / 2 sums of d dimensions,
however many rows there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, written

#: Steps a unit: x = floor(SCALE * c).
SCALE = 256
#: A component whose eigenvalue is under this share of the largest has no variance but rounding.
FLAT = 1e-12
_LONG = 2.0**62


def integer_vectors(vectors: DataFrame, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(key, x array of long) of the vectors that take part.

    Null and empty vectors, those that hold null, NaN, infinite or (scaled)
    longer than 62-bit entries take no part, nor do vectors of another length
    than most have (of equally frequent lengths: the shorter).
    """
    scaled = F.transform(F.col(column).cast("array<double>"), lambda c: F.floor(c * SCALE))
    good = F.transform(F.col(column).cast("array<double>"), lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < _LONG / SCALE))
    sound = F.coalesce(F.size(column) > 0, F.lit(False)) & F.coalesce(F.forall(good, lambda g: g), F.lit(False))
    rows = vectors.select(F.col(key), F.when(sound, scaled).alias("x")).where("x is not null")
    length = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("x") == (length["d"] if length else 0))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """rows x dimensions of a list column."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def square_sums(fit: DataFrame, middle: list[int]) -> DataFrame:
    """(i, j, q decimal): sums of (y_i + y_j) squared for i < j and of y_i squared for i = j; y = x - middle."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d, mid = len(middle), np.array(middle, dtype=np.int64)
        total = {i: [0] * (d - i) for i in range(d)}
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                y = _matrix(batch.column(0).slice(at, 4096)) - mid
                if y.size and float(np.abs(y).max()) ** 2 * 4 * len(y) >= _LONG:
                    y = y.astype(object)  # squares beyond a long: Python's integers, exact and slow
                for i in range(d):
                    pair = y[:, i:] + y[:, i : i + 1]
                    pair[:, 0] = y[:, i]
                    total[i] = [a + int(b) for a, b in zip(total[i], (pair * pair).sum(axis=0), strict=True)]
        rows = [(i, i + k, Decimal(q)) for i in range(d) for k, q in enumerate(total[i])]
        i, j, q = zip(*rows, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(q, pa.decimal128(38, 0))], ["i", "j", "q"])

    parts = fit.select("x").mapInArrow(sums, "i int, j int, q decimal(38,0)")
    return parts.groupBy("i", "j").agg(F.sum("q").alias("q"))


def covariance(fit: DataFrame) -> tuple[int, list[int], list[list[Fraction]]]:
    """n, sums and the exact covariance matrix (divisor n) of the vectors x of ``fit``; n is 0 without rows."""
    at = fit.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("s"), F.count("*").alias("n")).orderBy("i").collect()
    if not at:
        return 0, [], []
    n, sums = at[0]["n"], [int(r["s"]) for r in at]
    middle = [round(Fraction(s, n)) for s in sums]
    rest = [s - n * m for s, m in zip(sums, middle, strict=True)]  # what centring at an integer leaves
    raw = {(r["i"], r["j"]): int(r["q"]) for r in square_sums(fit, middle).collect()}
    var = {(i, j): n * q - (rest[i] + (rest[j] if j > i else 0)) ** 2 for (i, j), q in raw.items()}  # n squared times a variance
    d = len(sums)
    cov = [[Fraction(0)] * d for _ in range(d)]
    for (i, j), v in var.items():
        twice = 2 * v if i == j else v - var[i, i] - var[j, j]
        cov[i][j] = cov[j][i] = Fraction(twice, 2 * n * n)
    return n, sums, cov


def whiten(vectors: DataFrame, components: int = 4, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """One row for each vector and component: how far the vector lies along it, in standard deviations.

    key, component (from 1, by falling eigenvalue), n (distinct integer
    vectors, over which all is fitted), deviation (sum of (n x - S) squared,
    exact; null beyond a long), whitened, explained (share of the variance),
    identity_error (of the whitened covariance, over the fit list, against the
    identity). Repeated and null keys keep their rows; components without
    variance aren't given, so a single distinct vector, or none, gives no row.
    Which vectors take part: see ``integer_vectors``.
    """
    rows = integer_vectors(vectors, key, column)
    empty = f"{key} {vectors.schema[key].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    with scratch([]):
        fit = written(rows.select("x").distinct(), "fit")
        n, sums, cov = covariance(fit)
        if not n:
            return vectors.sparkSession.createDataFrame([], empty)
        trace = float(sum(cov[i][i] for i in range(len(sums))))
        values, axes = np.linalg.eigh(np.array([[float(v) for v in row] for row in cov]))
        order = [k for k in np.argsort(-values, kind="stable")[:components] if values[k] > FLAT * values.max() and values[k] > 0]
        values, axes = values[order], axes[:, order] / np.sqrt(values[order])
        explained = [float(v) / trace for v in values]
        mean = np.array([float(Fraction(s, n)) for s in sums])

        def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            k = axes.shape[1]
            total = np.zeros((k, k))
            for batch in batches:
                w = (_matrix(batch.column(0)) - mean) @ axes
                total += w.T @ w
            a, b = np.divmod(np.arange(k * k), max(k, 1))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(total.ravel())], ["a", "b", "s"])

        sent = fit.mapInArrow(products, "a int, b int, s double").groupBy("a", "b").agg(F.sum("s").alias("s")).collect()
        error = max((abs(r["s"] / n - (r["a"] == r["b"])) for r in sent), default=0.0)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = axes.shape[1]
        for batch in batches:
            x = _matrix(batch.column(1)) if batch.num_rows else np.zeros((0, len(sums)), dtype=np.int64)
            far = ((x.astype(float) * n - np.array(sums, dtype=float)) ** 2).sum(axis=1)
            small = far < _LONG
            exact = np.zeros(len(x), dtype=np.int64)
            exact[small] = ((x[small] * n - np.array(sums if small.any() else [0] * len(sums), dtype=np.int64)) ** 2).sum(axis=1)
            w = (x - mean) @ axes
            rows = np.repeat(np.arange(len(x)), k)
            out = [
                batch.column(0).take(pa.array(rows)),
                pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()),
                pa.array(np.full(len(rows), n), pa.int64()),
                pa.array(exact[rows], mask=~small[rows]),
                pa.array(w.ravel()),
                pa.array(np.tile(np.array(explained), len(x))),
                pa.array(np.full(len(rows), error)),
            ]
            yield pa.RecordBatch.from_arrays(out, [key, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.select(key, "x").mapInArrow(project, empty)
