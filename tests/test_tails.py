"""Tails of distributions at many degrees of freedom, against sums of Poisson probabilities."""

from __future__ import annotations

from math import lgamma

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.functions import tails


def chi_square_tail(x: float, df: int) -> float:
    """P(X >= x) for an even number of degrees: at most df / 2 - 1 events of a Poisson process up to x / 2."""
    k, rate = df // 2, x / 2
    i = np.arange(max(0, k - 40 * int(k**0.5) - 60), k)
    logs = np.concatenate([[0.0], np.cumsum(np.log(rate / i[1:]))]) + i[0] * np.log(rate) - rate - lgamma(i[0] + 1)
    return float(np.exp(logs).sum())


@pytest.mark.parametrize("df", [2, 50, 1_000, 3_998, 4_002, 100_000, 400_000, 10_000_000])
def test_chi_square_tail(spark, df):
    places = [df + z * (2 * df) ** 0.5 for z in (-4, -1, -0.001, 0, 0.0001, 0.5, 2, 6) if df + z * (2 * df) ** 0.5 > 0]
    got = [r["p"] for r in spark.createDataFrame([(k, float(x)) for k, x in enumerate(places)], "k int, x double").select("k", tails.chi_square_tail(F.col("x"), F.lit(df)).alias("p")).orderBy("k").collect()]
    assert np.allclose(got, [chi_square_tail(x, df) for x in places], rtol=1e-3, atol=3e-7)


def test_f_tail_of_many_groups(spark):
    """With endless degrees below, F times its degrees is a chi-square."""
    for df in (1_000, 200_000):
        f = 1 + 1.5 * (2 / df) ** 0.5
        got = spark.range(1).select(tails.f_tail(F.lit(f), F.lit(df), F.lit(10**12)).alias("p")).head()["p"]
        assert abs(got - chi_square_tail(f * df, df)) < 1e-5
