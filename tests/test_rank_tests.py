"""Rank tests against a reference group, against all pairs."""

from __future__ import annotations

import numpy as np

from panelforge.operators import rank_tests


def test_statistics_equal_all_pairs(spark):
    rng = np.random.default_rng(4)
    rows = [(s, g, float(np.round(rng.normal() + shift, 1))) for s in ("a", "b") for g, shift, n in (("ref", 0, 40), ("x", 0.5, 30), ("y", 0, 25), ("few", 1, 3)) for _ in range(n)]
    rows += [("b", "x", None), ("c", "x", 1.0), ("a", None, 1.0), ("a", "z", 1.0)]
    got = {(r["score"], r["group"]): r for r in rank_tests.against_reference(spark.createDataFrame(rows, "score string, `group` string, value double"), ["a", "b"], ["x", "ref", "few", "y"], "ref").collect()}
    assert len(got) == 8
    of = lambda s, g: np.array([v for a, b, v in rows if (a, b) == (s, g) and v is not None])
    for (s, g), r in got.items():
        own, ref = of(s, g), of(s, "ref")
        assert r["n"] == len(own) and abs(r["mean"] - own.mean()) < 1e-9
        if g in ("ref", "few"):
            assert r["u"] is None and r["p"] is None and r["risk"] is None
            continue
        u = sum((ref > v).sum() + (ref == v).sum() / 2 for v in own)
        every, n = np.concatenate([own, ref]), len(own) + len(ref)
        ties = sum(int(c) ** 3 - int(c) for c in np.unique(every, return_counts=True)[1])
        z = (u - len(own) * len(ref) / 2) / np.sqrt(len(own) * len(ref) / 12 * ((n + 1) - ties / (n * (n - 1))))
        assert abs(r["u"] - u) < 1e-9 and abs(r["z"] - z) < 1e-9 and abs(r["rank_biserial"] - (1 - 2 * u / len(own) / len(ref))) < 1e-9
        assert r["risk"] == ("LOW" if r["p"] >= 0.05 else "HIGH" if abs(r["rank_biserial"]) > 0.3 else "MODERATE")
