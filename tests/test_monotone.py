"""Isotonic fits and corrected factors against numpy."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.operators import monotone


def test_pooling_equals_the_minimax_formula():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 10, 10, 10):
        y = rng.integers(0, 6, n).astype(float)
        expected = [max(min(y[a : b + 1].mean() for b in range(k, n)) for a in range(k + 1)) for k in range(n)]
        assert np.allclose(monotone.pool_adjacent(y.tolist()), expected)
    assert monotone.pool_adjacent([]) == []


def test_rising_steps_and_monotone():
    assert monotone.rising_steps([1, 2, 2, 1, 3]) == 3 and monotone.rising_steps([1, None, 2, 3, None]) == 1
    assert monotone.is_monotone([1, 1, 2, 2, 3]) and not monotone.is_monotone([1, 2, 3, 4, None]) and not monotone.is_monotone([1, 2, 1.9, 3, 4])


def test_interpolation_is_clipped(spark):
    points = [(0.0, 1.0), (1.0, 1.0), (3.0, 5.0)]
    x = [None, -1.0, 0.0, 0.5, 1.0, 2.0, 3.0, 9.0]
    got = [r["y"] for r in spark.createDataFrame([(k, v) for k, v in enumerate(x)], "k int, x double").select("k", monotone.interpolated(F.col("x"), points).alias("y")).orderBy("k").collect()]
    assert got[0] is None and np.allclose(got[1:], np.interp(x[1:], [0, 1, 3], [1, 1, 5]))


def average_ranks(v):
    return np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])


def plain(f, t, z):
    """The correction by numpy, for rows without nulls or equal values."""

    def means(v, bins):
        q = np.quantile(v, [k / bins for k in range(1, bins)])
        b = (v[:, None] > q[None]).sum(1)
        return [v[b == k].mean() for k in range(bins)], [t[b == k].mean() for k in range(bins)]

    base = means(f, 5)[1]
    if monotone.is_monotone(base):
        return f
    w = np.array([abs(np.corrcoef(average_ranks(c), average_ranks(t))[0, 1]) for c in z])
    candidate = np.round((z * w[:, None]).sum(0) / w.sum(), 9)
    if monotone.rising_steps(means(candidate, 5)[1]) >= monotone.rising_steps(base):
        f, base = candidate, means(candidate, 5)[1]
    x, y = means(f, 10)
    g = np.round(np.interp(f, x, monotone.pool_adjacent(y)), 9)
    share = min(0.9, 0.6 + 0.1 * max(0, 3 - monotone.rising_steps(base)))
    blend = (share * average_ranks(g) + (1 - share) * average_ranks(f)) / len(f) * 100
    return np.clip((blend - blend.mean()) / blend.std(ddof=1) * 10 + 50, 0, 100)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_corrected_equals_numpy(spark, seed):
    rng = np.random.default_rng(seed)
    n = 120
    t = rng.normal(size=n)
    f = np.round(np.abs(t) * (1 if seed > 1 else -1) + rng.normal(size=n) * 0.3, 9)
    z = np.stack([t + rng.normal(size=n), rng.normal(size=n)])
    df = spark.createDataFrame([(i, float(f[i]), float(t[i]), float(z[0, i]), float(z[1, i])) for i in range(n)], "id int, f double, t double, a double, b double")
    got = {r["id"]: r["corrected"] for r in monotone.corrected(df, "id", "f", "t", ["a", "b"]).collect()}
    assert np.allclose([got[i] for i in range(n)], plain(f, t, z), atol=1e-6)


def test_rows_without_target_few_rows_and_monotone_factors(spark):
    rising = spark.createDataFrame([(i, float(i), float(i)) for i in range(40)], "id int, f double, t double")
    assert {r["id"]: r["corrected"] for r in monotone.corrected(rising, "id", "f", "t", []).collect()} == {i: float(i) for i in range(40)}
    few = spark.createDataFrame([(i, float(i), float(-i)) for i in range(12)] + [(99, None, None)], "id int, f double, t double")
    assert {r["id"]: r["corrected"] for r in monotone.corrected(few, "id", "f", "t", []).collect()} == {i: float(i) for i in range(12)} | {99: None}
    falling = spark.createDataFrame([(i, float(i), float(-i)) for i in range(60)] + [(98, None, 1.0), (99, 30.0, None)], "id int, f double, t double")
    got = {r["id"]: r["corrected"] for r in monotone.corrected(falling, "id", "f", "t", []).collect()}
    # A wholly falling factor has a flat fit: only a tenth of its own rank is left.
    assert got[98] == 50.0 and got[0] < got[30] < got[59] and len(got) == 62
