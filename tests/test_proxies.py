"""Percentiles among a reference, calibration and validation of proxies against plain loops."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from panelforge.operators import proxies


def test_places_among_a_reference(spark):
    rng = np.random.default_rng(1)
    ref = [(g, "s", float(rng.integers(0, 30))) for g in "abc" for _ in range(40)] + [("d", "s", 1.0), ("a", None, 5.0), ("a", None, 7.0)]
    out = [(k, g, s, v) for k, (g, s, v) in enumerate([(g, "s", float(v)) for g in "abc" for v in (-1, 0, 7, 7, 29, 30)] + [("a", "s", None), ("d", "s", 2.0), ("e", "s", 2.0), ("a", None, 6.0)])]
    reference = spark.createDataFrame(ref, "g string, s string, v double")
    outside = spark.createDataFrame(out, "id int, g string, s string, v double")
    got = {r["id"]: r["placed"] for r in proxies.placed_among(outside, reference, ["g", "s"], "v").collect()}
    assert set(got) == {r[0] for r in out}
    for k, g, s, v in out:
        own = np.array([x for a, b, x in ref if (a, b) == (g, s)])
        want = None if v is None else 50.0 if len(own) < 2 else float(np.clip(100 * ((own < v).sum() + (own == v).sum() / 2) / len(own), 5, 95))
        assert got[k] == want, (k, g, v)


def test_calibration_and_validation_with_few_rows(spark):
    rng = np.random.default_rng(2)
    rows = [("x", float(v), k % 3 == 0) for k, v in enumerate(rng.normal(size=60))] + [("few", 1.0, True), ("few", 2.0, False)]
    got = {r["indicator"]: r for r in proxies.calibration(spark.createDataFrame(rows, "indicator string, value double, proxy boolean"), ["x", "few"]).collect()}
    assert got["few"]["note"] == "insufficient data" and got["few"]["rho"] is None and (got["few"]["n_real"], got["few"]["n_proxy"]) == (1, 1)
    real, made = (np.array([v for i, v, p in rows if i == "x" and p == kind]) for kind in (False, True))
    pooled = ((len(real) - 1) * real.var(ddof=1) + (len(made) - 1) * made.var(ddof=1)) / 58
    places = np.sort(np.concatenate([real, made]))
    ks = max(abs((real <= p).mean() - (made <= p).mean()) for p in places)
    assert abs(got["x"]["d"] - (real.mean() - made.mean()) / pooled**0.5) < 1e-9 and abs(got["x"]["ks"] - ks) < 1e-9 and got["x"]["effect"] in ("negligible", "small", "medium")
    pairs = [("x", float(k), float(k) + rng.normal()) for k in range(40)] + [("y", float(k), -float(k)) for k in range(20)] + [("few", 1.0, 1.0), ("x", None, 1.0)]
    out = {r["indicator"]: r for r in proxies.held_out_validation(spark.createDataFrame(pairs, "indicator string, real double, proxy double"), ["x", "y", "few"]).collect()}
    assert (out["x"]["note"], out["y"]["note"], out["few"]["note"]) == ("agrees with real", "inverse to real", "too few real values")
    assert out["y"]["tau"] == -1 and out["x"]["n"] == 40 and out["few"]["rho"] is None
    both = [(a, b) for i, a, b in pairs if i == "x" and a is not None]
    signs = [np.sign(a - c) * np.sign(b - d) for k, (a, b) in enumerate(both) for c, d in both[:k]]
    assert abs(out["x"]["tau"] - sum(signs) / len(signs)) < 1e-9


def test_labels_of_effects(spark):
    got = spark.createDataFrame([(0.1,), (-0.3,), (0.6,), (-2.0,), (None,)], "d double").select(proxies.effect_label(F.col("d")).alias("e")).collect()
    assert [r["e"] for r in got] == ["negligible", "small", "medium", "large", "N/A"]
