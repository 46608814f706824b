"""Statistics of splits, folds and weights against numpy on copied rows."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.operators import splits


def average_ranks(v):
    return np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    out = []
    for pair, shift in (("a~t", 0.5), ("b~t", -0.2), ("c~t", 0.0)):
        for _ in range(140):
            x = round(float(rng.normal()), 1)
            out.append((pair, rng.choice(["p", "q", "r", "s"]).item(), x, float(rng.normal() + shift * x)))
    # A frequent value, a small group, missing numbers, a pair and a group that are not asked for.
    out += [("a~t", "p", 0.0, float(k)) for k in range(60)] + [("c~t", "z", 1.0, float(k)) for k in range(5)] + [("a~t", "q", None, 1.0), ("a~t", "q", 1.0, None), ("d~t", "q", 1.0, 1.0), ("a~t", "y", 1.0, 1.0)]
    return out


def expected(rows, pairs, groups, tests):
    out = {}
    for pair in pairs:
        own = [(g, x, y) for p, g, x, y in rows if p == pair and g in groups and x is not None and y is not None]
        for split, names in tests.items():
            for side in ("train", "test"):
                part = [(x, y) for g, x, y in own if (g in names) == (side == "test")]
                if not part:
                    continue
                x, y = np.array(part).T
                rho = np.corrcoef(average_ranks(x), average_ranks(y))[0, 1] if len(x) >= 10 and len(set(x)) > 1 else None
                q = np.quantile(x, [0.2, 0.8])
                low, high = y[x <= q[0]], y[x > q[1]]
                spread = high.mean() - low.mean() if len(x) >= 15 and len(low) and len(high) else None
                out[pair, split, side] = (len(x), rho, spread)
    return out


def test_statistics_of_all_splits(spark, rows):
    groups, pairs = ["p", "q", "r", "s", "z"], ["a~t", "b~t", "c~t"]
    tests = {"p": ["p"], "none": [], "z": ["z"]} | splits.held_out_sets(groups, 2)
    df = spark.createDataFrame(rows, "pair string, `group` string, x double, y double")
    got = {(r["pair"], r["split"], r["side"]): (r["n"], r["rho"], r["spread"]) for r in splits.split_statistics(df, pairs, groups, tests).collect()}
    want = expected(rows, pairs, groups, tests)
    assert set(got) == set(want) and len(splits.held_out_sets(groups, 2)) == 10
    for k, (n, rho, spread) in want.items():
        assert got[k][0] == n
        for a, b in ((got[k][1], rho), (got[k][2], spread)):
            assert (a is None) == (b is None) and (a is None or abs(a - b) < 1e-9), k


def test_no_task_needs_a_whole_group(spark):
    df = spark.range(2000).select(F.col("id"), (F.col("id") % 3).alias("g"), (F.col("id") * 7919 % 2003).alias("v"))
    got = splits.numbered(df, ["g"], ["v", "id"]).collect()
    for g in range(3):
        own = sorted((r for r in got if r["g"] == g), key=lambda r: r["place"])
        assert [r["place"] for r in own] == list(range(len(own))) and [r["v"] for r in own] == sorted(r["v"] for r in own)
    plan = splits.numbered(df, ["g"], ["v", "id"])._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number" not in plan and "rangepartitioning" not in plan  # the order is settled before
    assert splits.numbered(df.limit(0), ["g"], ["v", "id"]).count() == 0


def test_quasi_temporal_folds(spark):
    rng = np.random.default_rng(5)
    rows = [(i, None if i % 10 == 3 else float(rng.integers(0, 20)), None if i % 7 == 2 else float(rng.integers(0, 50))) for i in range(83)]
    got = {r["entity_id"]: r["fold"] for r in splits.quasi_temporal_folds(spark.createDataFrame(rows, "entity_id int, size double, age double"), "size", "age", 4).collect()}
    ms, mo = (np.median([r[k] for r in rows if r[k] is not None]) for k in (1, 2))
    filled = sorted((ms if s is None else s, i, mo if a is None else a) for i, s, a in rows)
    rank = np.arange(1, 84)
    bins = np.searchsorted(np.quantile(rank, [0.25, 0.5, 0.75]), rank, "left")
    for b in range(4):
        own = sorted((a, i) for (_, i, a), k in zip(filled, bins, strict=True) if k == b)
        assert [got[i] for _, i in own] == [k % 4 for k in range(len(own))]


def test_bounded_weights_and_shrinkage(spark):
    drawn = spark.createDataFrame([("a", "x", 0.5), ("a", "y", 0.3), ("a", "z", 0.2), ("b", "x", 1.0), ("b", "y", 0.0), ("b", "z", 0.0)], "candidate string, factor string, w double")
    kept = {r["factor"]: r["w"] for r in splits.bounded_weights(drawn, 3, 0.02, 0.6).collect()}
    assert kept == pytest.approx({"x": 0.02 + 0.94 * 0.5, "y": 0.02 + 0.94 * 0.3, "z": 0.02 + 0.94 * 0.2}) and sum(kept.values()) == pytest.approx(1)
    ics = [("s", f"f{k}", v, 100) for k, v in enumerate([0.3, 0.1, -0.2, 0.05, 0.0])] + [("t", f"f{k}", 0.1, 100) for k in range(5)] + [("u", f"f{k}", 0.1 * k, 100) for k in range(3)]
    out = splits.shrunken_within(spark.createDataFrame(ics, "split string, factor string, ic double, n int"), ["split"], "ic", "n", "s").collect()
    got = {(r["split"], r["factor"]): r["s"] for r in out}
    v = np.array([0.3, 0.1, -0.2, 0.05, 0.0])
    keep = np.clip(1 - 2 / 97 / ((v - v.mean()) ** 2).sum(), 0, 1)
    assert np.allclose([got["s", f"f{k}"] for k in range(5)], v.mean() + keep * (v - v.mean()))
    assert np.allclose([got["t", f"f{k}"] for k in range(5)], 0.1) and np.allclose([got["u", f"f{k}"] for k in range(3)], [0, 0.1, 0.2])
