"""Rules at their limits, each on a few rows, and statistics against plain Python."""

from __future__ import annotations

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.functions import tails
from panelforge.operators import cleaning, inference, multivariate, portfolio, profiling, resampling, scoring, series
from panelforge.plans.multivariate import mv_components, mv_projection
from panelforge.sources.panels import INDICATORS, entity_panel


def test_hard_flags_fail(spark):
    long = spark.createDataFrame([("x", 5.0)] * 90 + [("x", 99.0)] * 10 + [("y", 5.0)] * 97 + [("y", 99.0)] * 3, "indicator string, value double")
    ranges = spark.createDataFrame([("x", 0.0, 10.0, -1.0, 50.0), ("y", 0.0, 10.0, -1.0, 50.0)], "indicator string, low double, high double, hard_low double, hard_high double")
    assert {r["indicator"]: r["verdict"] for r in profiling.range_verdicts(long, ranges).collect()} == {"x": "FAIL", "y": "PASS"}


def test_low_confidence_is_drawn_by_the_confidence_itself(spark):
    rows = [(1, "a", 60.0, 0.2), (2, "a", 40.0, 0.9), (3, "a", 50.0, 0.9), (4, None, 80.0, 0.1), (5, "a", 45.0, None)]
    df = spark.createDataFrame(rows, "id int, sector string, score double, confidence double")
    got = {r["id"]: r["out"] for r in scoring.shrunk(df, "score", "confidence", "sector", "out").collect()}
    assert got == pytest.approx({1: 0.2 * 60 + 0.8 * 47.5, 2: 40.0, 3: 50.0, 4: 0.1 * 80 + 0.9 * 50, 5: 45.0})


def test_shrinkage_never_spreads(spark):
    frame = lambda values: spark.createDataFrame([(k, v, 40) for k, v in enumerate(values)], "k int, rho double, n int")
    few = {r["k"]: r["shrunk"] for r in inference.shrunken(frame([0.1, 0.3])).collect()}
    assert few == {0: 0.1, 1: 0.3}
    values = [0.1, 0.3, -0.2, 0.25, 0.4]
    mean, spread = np.mean(values), np.sum((np.array(values) - np.mean(values)) ** 2)
    keep = min(1, max(0, 1 - 2 / 37 / spread))
    for r in inference.shrunken(frame(values)).collect():
        assert r["shrunk"] == pytest.approx(mean + keep * (values[r["k"]] - mean)) and r["intensity"] == pytest.approx(1 - keep)


def test_gini_starts_at_the_minimum(spark):
    def brute(x):
        x = np.sort(np.array(x) - min(x) + 1e-6)
        c = np.cumsum(x) / x.sum()
        return 1 - 2 * np.trapezoid(c, dx=1 / len(x))

    for values in ([40.0, 50.0, 60.0, 70.0, 70.0, 90.0], [-3.0, 0.0, 5.0, 5.0, 5.0, 6.0]):
        assert portfolio.gini(spark.createDataFrame([(v,) for v in values], "x double"), "x").head()["gini"] == pytest.approx(brute(values))
    assert portfolio.gini(spark.createDataFrame([(1.0,)] * 4, "x double"), "x").head()["gini"] is None


def prices(spark, n):
    rows = [("e", d, 100.0 + (d * 7) % 13, 10.0) for d in range(n)]
    return spark.createDataFrame(rows, "entity string, d int, close double, volume double").select("entity", F.date_add(F.lit("2020-01-01").cast("date"), F.col("d")).alias("day"), "close", "volume")


@pytest.mark.parametrize(("n", "there"), [(6, set()), (31, {"momentum_1m"}), (32, {"momentum_1m", "volatility_30"}), (253, {"max_drawdown", "momentum_12m"}), (254, {"sharpe", "sortino"})])
def test_short_series_have_no_long_measures(spark, n, there):
    r = series.trailing_measures(prices(spark, n)).head()
    assert all(r[c] is not None for c in there)
    limits = {"volatility_30": 32, "max_drawdown": 253, "sharpe": 254, "sortino": 254, "volume_90": 91, "momentum_1m": 22, "momentum_12m": 253}
    assert {c for c in limits if r[c] is not None} == {c for c, k in limits.items() if n >= k}
    assert r["volume_30"] == 10.0


@pytest.mark.parametrize("n", [5, 6])
def test_partial_forward_returns(spark, n):
    p = prices(spark, n)
    r = series.forward_returns(p, spark.createDataFrame([("2020-01-01",)], "s string").select(F.col("s").cast("date").alias("snapshot")), {"1m": 21}).head()
    assert (r["fwd_1m"] is not None) == (n > 5) and r["partial_1m"]


def test_gate_shuts_out_nulls(spark):
    df = spark.createDataFrame([(i, 50.0, float(i) if i else None) for i in range(30)], "id int, score double, gate double")
    got = {r["id"]: r["gated"] for r in scoring.gated(df, "score", "gate").collect()}
    assert got[0] == 0.0 and got[1] == 0.0 and got[29] == pytest.approx(100 * 0.5**1.5)


def test_impact_and_blend(spark):
    one = spark.range(1)
    impact = lambda value, volume: one.select(resampling.market_impact(F.lit(value), F.lit(volume), F.lit(0.02))).head()[0]
    assert impact(100.0, 400.0) == pytest.approx(100.0) and impact(100.0, 0.0) == 0.0
    df = spark.createDataFrame([(1, "a", 120.0), (2, "a", -80.0), (3, "a", None)], "id int, g string, s double")
    assert {r["id"]: r["b"] for r in scoring.sector_blend(df, "s", "g", "b").collect()} == {1: 100.0, 2: 0.0, 3: None}


def test_fill_by_type_rounds_observed_ordinals(spark):
    long = spark.createDataFrame([("o", "a", 1.4), ("o", "a", None), ("b", "a", None), ("b", None, None), ("b", "z", 1.0)], "indicator string, sector string, value double")
    types = spark.createDataFrame([("o", "ordinal"), ("b", "binary")], "indicator string, vtype string")
    assert sorted(((r["indicator"], str(r["sector"])), r["value"]) for r in cleaning.filled_by_type(long, types, "sector").collect()) == [
        (("b", "None"), 1.0), (("b", "a"), 0.0), (("b", "z"), 1.0), (("o", "a"), 1.0), (("o", "a"), 1.0),
    ]


def test_tails_on_known_values(spark):
    #: From tables of the distributions.
    for column, expected in (
        (tails.t_two_sided(F.lit(2.228138852), F.lit(10)), 0.05), (tails.f_tail(F.lit(4.102821), F.lit(2), F.lit(10)), 0.05), (tails.chi_square_tail(F.lit(18.307038), F.lit(10)), 0.05),
        (tails.t_two_sided(F.lit(1.959963985), F.lit(10**8)), 0.05), (tails.chi_square_tail(F.lit(0.0), F.lit(3)), 1.0), (tails.t_two_sided(F.lit(0.0), F.lit(5)), 1.0),
    ):
        assert spark.range(1).select(column).head()[0] == pytest.approx(expected, abs=1e-7)
    assert spark.range(1).select(tails.t_two_sided(F.lit(1.0), F.lit(0))).head()[0] is None


@pytest.mark.parametrize(("ranges", "kinds"), [(4, 9), (3, 40), (256, 1000)])
def test_pair_counts_equal_all_pairs(spark, monkeypatch, ranges, kinds):
    monkeypatch.setattr(inference, "GRID_RANGES", ranges)
    rnd = random.Random(ranges)
    rows = [(float(rnd.randint(0, kinds)) if rnd.random() < 0.7 else 3.0, float(rnd.randint(0, kinds))) for _ in range(160)]
    sign = lambda v: (v > 0) - (v < 0)
    expected = sum(sign(a[0] - b[0]) * sign(a[1] - b[1]) for a, b in itertools.combinations(rows, 2))
    frame = spark.createDataFrame(rows, "x double, y double")
    assert inference.pair_sign(frame).head()["s"] == expected
    ties = [sum(1 for a, b in itertools.combinations(rows, 2) if a[k] == b[k]) for k in (0, 1)]
    n = len(rows) * (len(rows) - 1) / 2
    assert inference.kendall(frame, "x", "y").head()["tau_b"] == pytest.approx(expected / math.sqrt((n - ties[0]) * (n - ties[1])))


def test_components_and_scores_equal_numpy(spark, sf_dir):
    rows = entity_panel(spark, sf_dir).dropna(subset=INDICATORS).orderBy("entity_id").collect()
    x = np.array([[r[c] for c in INDICATORS] for r in rows])
    values, vectors = np.linalg.eigh(np.corrcoef(x.T))
    values, vectors = values[::-1], vectors[:, ::-1]
    vectors = vectors * np.where(vectors.sum(0) < 0, -1, 1)
    got = mv_components(spark, sf_dir).orderBy("component").collect()
    assert [r["eigenvalue"] for r in got] == pytest.approx(values, abs=1e-4)
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    scores = {r["entity_id"]: [r[f"pc{k}"] for k in range(1, 5)] for r in mv_projection(spark, sf_dir).collect()}
    assert np.array([scores[r["entity_id"]] for r in rows]) == pytest.approx(z @ vectors[:, :4], abs=1e-3)


def test_regression_equals_numpy(spark):
    rnd = np.random.default_rng(4)
    x = rnd.normal(50, 3, (40, 2))
    y = 2 * x[:, 0] - x[:, 1] + rnd.normal(0, 4, 40)
    rows = [(float(a), float(b), float(c)) for (a, b), c in zip(x, y, strict=True)]
    got = {r["term"]: r for r in inference.multiple_regression(spark.createDataFrame(rows, "a double, b double, y double"), ["a", "b"], "y").collect()}
    z = np.column_stack([np.ones(40), (x - x.mean(0)) / x.std(0, ddof=1)])
    beta = np.linalg.lstsq(z, y, rcond=None)[0]
    rest = y - z @ beta
    se = np.sqrt(np.diag(np.linalg.inv(z.T @ z)) * (rest @ rest) / 37)
    assert [got[t]["coefficient"] for t in ("intercept", "a", "b")] == pytest.approx(beta)
    assert [got[t]["se"] for t in ("intercept", "a", "b")] == pytest.approx(se)
    assert inference.multiple_regression(spark.createDataFrame([(1.0, 2.0, 3.0)], "a double, b double, y double"), ["a", "b"], "y").count() == 0
    assert multivariate.correlation(spark.createDataFrame(rows, "a double, b double, y double"), ["a", "b"]) == pytest.approx(np.corrcoef(x.T))
