"""Whitening against numpy, and its edge cases."""

import math

import numpy as np
import pytest

from lendspark.llm import queries, whitening
from lendspark.llm.common import table

DIR = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>"


def brute(rows):
    """(key, component) -> (n, deviation, |whitened|, explained), by the definition."""
    kept = [(k, np.floor(256 * np.array(v, dtype=float)).astype(np.int64)) for k, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in kept}))
    n, s = len(fit), fit.sum(axis=0)
    c = fit - s / n
    e, axes = np.linalg.eigh(c.T @ c / n)
    e, axes = e[::-1], axes[:, ::-1]
    return {
        (k, a + 1): (n, int(((n * x - s) ** 2).sum()), abs((x - s / n) @ axes[:, a]) / math.sqrt(e[a]), e[a] / e.sum())
        for k, x in kept
        for a in range(min(4, len(e)))
        if e[a] > 1e-12 * e[0]
    }


def agrees(got, want):
    got = {(r["vec_id"], r["component"]): r for r in got}
    assert set(got) == set(want)
    for k, (n, deviation, whitened, explained) in want.items():
        r = got[k]
        assert (r["n"], r["deviation"]) == (n, deviation)
        assert abs(r["whitened"]) == pytest.approx(whitened, abs=1e-9) and r["explained"] == pytest.approx(explained, rel=1e-9)
        assert r["identity_error"] < 1e-9


def test_query_equals_numpy(spark):
    rows = [(r[0], r[1]) for r in table(spark, DIR, "embeddings").select("vec_id", "embedding").collect()]
    agrees(queries.QUERIES["op13_whitening"](spark, DIR).collect(), brute(rows))


def test_edges(spark):
    """Nulls, NaN, infinities, other lengths, copies, repeated and null keys, further columns of the operator's own names."""
    rng = np.random.default_rng(3)
    rows = [(k, [float(x) for x in rng.normal(size=3)]) for k in range(40)]
    rows += [(1, rows[0][1]), (None, rows[5][1])] + [(100 + k, rows[7][1]) for k in range(30)]
    odd = [(900, None), (901, [1.0, None, 2.0]), (902, [math.nan, 0.0, 0.0]), (903, [math.inf, 0.0, 0.0]), (904, []), (905, [1.0]), (906, [1.0, 2.0, 3.0, 4.0])]
    df = spark.createDataFrame(rows + odd, SCHEMA).selectExpr("*", "1 AS x", "2 AS component", "'a' AS n")
    got = whitening.whiten(df).collect()
    assert len(got) == 3 * len(rows)
    unique = [(k, v) for k, v in rows if k not in (None, 1)]
    want = brute(rows)
    agrees([r for r in got if r["vec_id"] not in (None, 1)], {k: v for k, v in want.items() if k[0] in dict(unique)})
    assert sum(r["vec_id"] is None for r in got) == 3 and sum(r["vec_id"] == 1 for r in got) == 6


def test_few_rows(spark):
    assert whitening.whiten(spark.createDataFrame([], SCHEMA)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], SCHEMA)).count() == 0  # no variance
    two = whitening.whiten(spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 1.0])], SCHEMA)).collect()
    assert sorted(round(r["whitened"], 9) for r in two) == [-1, 1] and {r["component"] for r in two} == {1}


def test_squares_beyond_a_long_stay_exact(spark):
    rng = np.random.default_rng(5)
    x = [[int(v) for v in rng.integers(-(2**45), 2**45, size=2)] for _ in range(50)]
    n, s, cov = whitening.covariance(spark.createDataFrame([(v,) for v in x], "x array<long>").distinct())
    assert n == 50 and s == [sum(v[d] for v in x) for d in range(2)]
    want = sum((n * v[0] - s[0]) * (n * v[1] - s[1]) for v in x)
    assert cov[0][1] * n**3 == want
