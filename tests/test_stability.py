"""Stability of ranks over draws and changed weights against plain loops; no row is copied for the replicates."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest

from panelforge.operators import rank_intervals
from panelforge.operators import resampling as W


def uniform(*parts):
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:8], 16) / 2**32


def ranks(v):
    """Descending average ranks."""
    return np.array([(v > x).sum() + ((v == x).sum() + 1) / 2 for x in v])


@pytest.fixture(params=["one chunk", "many"])
def sizes(request, monkeypatch):
    if request.param == "many":
        for name, size in (("CHUNK", 4), ("RANGE", 20), ("CELLS", 60)):
            monkeypatch.setattr(rank_intervals, name, size)


@pytest.fixture
def uncopied(monkeypatch):
    def fail(*_):
        raise AssertionError("rows are copied for the replicates")

    monkeypatch.setattr(W, "subsample", fail)
    monkeypatch.setattr(W, "evaluated", fail)


def test_draw_stability(spark, sizes, uncopied):
    v = np.round(np.random.default_rng(3).normal(size=50), 1)
    rows = [(i, float(x)) for i, x in enumerate(v)] + [(77, None)]
    got = {r["metric"]: (r["mean"], r["std"]) for r in W.draw_stability(spark.createDataFrame(rows, "entity_id int, score double"), 30, 11, (3, 8), 2).collect()}
    best = sorted(range(50), key=lambda i: (-v[i], i))
    drawn = [[i for i in range(50) if uniform(11, r, i) < 1 - 2.718281828459045**-1] for r in range(30)]
    expected = {f"top{n}_overlap": [len(set(best[:n]) & set(sorted(d, key=lambda i: (-v[i], i))[:n])) for d in drawn] for n in (3, 8)}
    expected |= {"successive_correlation": [], "pct_within_2": []}
    for before, after in zip(drawn, drawn[1:], strict=False):
        a, b = (dict(zip(d, ranks(v[d]), strict=True)) for d in (before, after))
        x, y = (np.array([s[i] for i in a if i in b]) for s in (a, b))
        expected["successive_correlation"].append(np.corrcoef(ranks(x), ranks(y))[0, 1])
        expected["pct_within_2"].append(100 * np.mean(np.abs(x - y) <= 2))
    assert set(got) == set(expected)
    assert all(abs(got[k][0] - np.mean(e)) < 1e-9 and abs(got[k][1] - np.std(e)) < 1e-9 for k, e in expected.items())


def test_draws_of_equal_scores_have_no_correlation(spark):
    got = {r["metric"]: r["mean"] for r in W.draw_stability(spark.createDataFrame([(i, 1.0) for i in range(9)], "entity_id int, score double"), 5, 11, (2,), 2).collect()}
    assert got["successive_correlation"] is None and got["pct_within_2"] > 0


def test_rank_stability(spark, sizes, uncopied):
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(50, 2)), 1)
    long = spark.createDataFrame([(f"k{i:02d}", f, float(x[i, k])) for i in range(50) for k, f in enumerate("ab")] + [("none", "a", None)], "entity_id string, factor string, x double")
    got = {r["entity_id"]: r for r in W.rank_stability(long, W.weight_rows(spark, {"even": {"a": 1, "b": 1}}), 20, 0.5, 6, 42, 3.0).collect()}
    own, kept = [], np.zeros(50)
    for r in range(20):
        w = np.array([0.5 * (1 + 0.5 * (2 * uniform(42, r, "even", f) - 1)) for f in "ab"])
        s = np.round(x @ (w / w.sum()), 8)
        own.append(ranks(s))
        kept[sorted(range(50), key=lambda i: (-s[i], i))[:6]] += 1 / 20
    own = np.array(own)
    assert len(got) == 51 and got["none"]["mean_rank"] is None and got["none"]["kept"] == 0
    for i in range(50):
        g = got[f"k{i:02d}"]
        expected = (own[:, i].mean(), own[:, i].std(), own[:, i].min(), own[:, i].max(), kept[i])
        assert np.allclose((g["mean_rank"], g["std_rank"], g["low_rank"], g["high_rank"], g["kept"]), expected, atol=1e-9) and g["stable"] == (own[:, i].std() < 3)
