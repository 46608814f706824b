"""Rank correlations near 0 keep their digits."""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pytest

from panelforge.operators.inference import rank_correlation


def test_a_coefficient_near_zero_is_exact(spark):
    rng = np.random.default_rng(3)
    n = 9000
    x, y = rng.permutation(n), rng.permutation(n)
    rows = [("a", float(a), float(b)) for a, b in zip(x, y, strict=True)] + [("b", 1.0, float(k)) for k in range(3)] + [("c", float(k // 2), -float(k // 2)) for k in range(6)]  # one that is constant, one that falls
    got = {r["g"]: r["rho"] for r in rank_correlation(spark.createDataFrame(rows, "g string, x double, y double").repartition(16), ["g"]).collect()}
    p, q = [2 * int(v) - n + 1 for v in x], [2 * int(v) - n + 1 for v in y]
    exact = float(Fraction(sum(a * b for a, b in zip(p, q, strict=True)), sum(a * a for a in p)))
    assert 0 < abs(exact) < 0.1 and math.isclose(got["a"], exact, rel_tol=1e-15)
    assert got["b"] is None and got["c"] == pytest.approx(-1.0, abs=0)
