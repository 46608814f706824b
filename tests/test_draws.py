"""Replicates as vectors against plain loops; rank intervals against numpy."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.functions import uniforms
from panelforge.operators import draws, rank_intervals, resampling


def uniform(*parts):
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:8], 16) / 2**32


def poisson(u, most=8):
    p = total = 2.718281828459045**-1
    for k in range(most):
        if u < total:
            return k
        p /= k + 1
        total += p
    return most


def ranks(values, weights):
    """Weighted average ranks, ascending."""
    return np.array([weights[values < v].sum() + (weights[values == v].sum() + 1) / 2 for v in values])


@pytest.fixture(scope="module")
def scores():
    rng = np.random.default_rng(6)
    return np.round(rng.normal(size=50), 1), np.round(rng.normal(size=50), 0)


@pytest.mark.parametrize("cells", [4_000_000, 40])
def test_rank_correlations_of_replicates(spark, scores, monkeypatch, cells):
    monkeypatch.setattr(draws, "RANGE_CELLS", cells)
    x, y = scores
    rows = [(i, float(x[i]), float(y[i])) for i in range(50)] + [(90, None, 1.0), (91, 1.0, None)]
    got = {r["replicate"]: (r["rho"], r["n"]) for r in draws.rank_correlations(spark.createDataFrame(rows, "entity_id int, x double, y double"), (3, 12), 5).collect()}
    assert sorted(got) == list(range(3, 13))
    for r in got:
        m = np.array([poisson(uniform(5, r, i)) for i in range(50)])
        a, b = np.repeat(ranks(x, m), m), np.repeat(ranks(y, m), m)
        assert got[r][1] == m.sum() and abs(got[r][0] - np.corrcoef(a, b)[0, 1]) < 1e-9


def test_as_the_row_by_row_version(spark, scores):
    x, y = scores
    rows = spark.createDataFrame([(i, float(x[i]), float(y[i])) for i in range(50)], "entity_id int, x double, y double")
    old = {r["replicate"]: r["rho"] for r in resampling.weighted_rank_correlation(resampling.bootstrap(rows, (0, 5), 5), ["replicate"]).collect()}
    new = {r["replicate"]: r["rho"] for r in draws.rank_correlations(rows, (0, 5), 5).collect()}
    assert all(abs(old[r] - new[r]) < 1e-9 for r in range(6)) and len(old) == len(new) == 6


def test_parts_of_a_value_meet(spark, monkeypatch):
    """A value that many rows share, in tasks that pass on what they hold after every batch."""
    rows = spark.createDataFrame([(i, 7.0 if i % 3 else float(i)) for i in range(90)], "entity_id int, v double").repartition(6)
    drawn = draws.with_draws(rows, (0, 3), 1)
    got = {r["value"]: (r["ranks"], r["n"]) for r in draws.value_counts(drawn, "v").select("value", draws.average_ranks().alias("ranks"), "n").collect()}
    v = np.array([7.0 if i % 3 else float(i) for i in range(90)])
    for r in range(4):
        m = np.array([poisson(uniform(1, r, i)) for i in range(90)])
        expected = ranks(v, m)
        assert all(abs(got[v[i]][0][r] - expected[i]) < 1e-9 for i in range(90))
    assert got[7.0][1] == 60


def test_empty_rows(spark):
    rows = spark.createDataFrame([], "entity_id int, x double, y double")
    assert draws.rank_correlations(rows, (0, 3), 1).count() == 0


def test_uniforms_are_the_portable_ones():
    keys = ["", "7", "123", "x" * 60, "\u00e4"]
    got = uniforms.uniforms(42, range(8, 12), keys)
    assert got.tolist() == [[uniform(42, r, k) for r in range(8, 12)] for k in keys]


def test_chunks_and_ranges_change_no_rank(spark, scores, monkeypatch):
    """Values that several chunks share, several ranges and replicates in groups, against one chunk and one range."""
    x, _ = scores
    rows = spark.createDataFrame([(f"k{i}", 0.5 if i % 3 == 0 else float(x[i])) for i in range(50)] + [("null", None)], "entity_id string, score double")
    whole = sorted(map(tuple, rank_intervals.intervals(rows, 30, 1).collect()))
    for name, size in (("CHUNK", 4), ("RANGE", 20), ("CELLS", 60)):
        monkeypatch.setattr(rank_intervals, name, size)
    parted = sorted(map(tuple, rank_intervals.intervals(rows, 30, 1).collect()))
    assert len(whole) == 51 and parted == whole


def test_rank_intervals(spark, scores):
    x, _ = scores
    n, replicates = 30, 40
    rows = [(i, None if i == 4 else float(x[i])) for i in range(n)]
    got = {r["entity_id"]: r.asDict() for r in rank_intervals.intervals(spark.createDataFrame(rows, "entity_id int, score double"), replicates, 42).collect()}
    v = x[:n].copy()
    v[4] = np.median(np.delete(v, 4))
    own, weighted = [[] for _ in range(n)], [[] for _ in range(n)]
    for r in range(replicates):
        m = np.array([poisson(uniform(42, r, i)) for i in range(n)])
        z = np.array([np.round(v[i] * -np.log(max(uniform(59, r, i), 1e-12)), 8) for i in range(n)])
        a, b = m.sum() + 1 - ranks(v, m), n + 1 - ranks(z, np.ones(n))
        for i in range(n):
            own[i] += [a[i]] * int(m[i] > 0)
            weighted[i].append(b[i])
    original = n + 1 - ranks(v, np.ones(n))
    assert set(got) == {i for i in range(n) if len(own[i]) >= 10}
    for i, g in got.items():
        both = own[i] + weighted[i]
        assert g["original_rank"] == original[i] and g["n_drawn"] == len(own[i])
        lo, hi = np.quantile(both, [0.025, 0.975])
        expected = {
            "bootstrap_rank": np.mean(own[i]), "bootstrap_std": np.std(own[i]), "bayesian_rank": np.mean(weighted[i]), "bayesian_std": np.std(weighted[i]), "consensus_rank": np.mean(both), "rank_std": np.std(both),
            "bootstrap_lower": np.quantile(own[i], 0.025), "bootstrap_upper": np.quantile(own[i], 0.975), "ci_lower": lo, "ci_upper": hi, "ci_width": hi - lo,
        }
        assert all(abs(g[k] - e) < 1e-6 for k, e in expected.items())
        assert (g["stable"], g["stable_relaxed"]) == (np.std(own[i]) < 5, np.std(own[i]) < 0.15 * n) and (g["stable_strict"], g["stable_moderate"]) == (hi - lo < 0.2 * n, hi - lo < 0.35 * n)
