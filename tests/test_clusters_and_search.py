"""Measures of cluster cuts against numpy, the weight search against plain loops."""

from __future__ import annotations

import numpy as np
import pytest

from panelforge.operators import multivariate, weight_search


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(7)
    return np.concatenate([rng.normal(c, 0.6, size=(25, 3)) for c in ((0, 0, 0), (4, 0, 1), (0, 5, 2), (4, 5, 9))])


def test_cut_measures(spark, points):
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)] + [(999, None, 1.0, 1.0)], "id int, a double, b double, c double")
    # The second cut is given: a cluster of one row.
    alone = spark.createDataFrame([(2, i, int(i == 7)) for i in range(len(points))], "k int, id int, cluster int")
    assigned = multivariate.cuts(df, "id", ["a", "b", "c"], [3, 4, 6]).unionByName(alone)
    got = {r["k"]: r for r in multivariate.cut_measures(df, assigned, "id", ["a", "b", "c"]).collect()}
    rows = [r for r in df.collect() if r["a"] is not None]
    m = np.array([df.agg({c: "avg"}).head()[0] for c in "abc"])
    sd = np.array([df.agg({c: "stddev_samp"}).head()[0] for c in "abc"])
    z = (np.array([[r[c] for c in "abc"] for r in rows]) - m) / sd
    assert got[4]["silhouette"] > max(got[3]["silhouette"], got[6]["silhouette"]) and got[4]["clusters"] == 4
    for k in (2, 3, 4, 6):
        label = {r["id"]: r["cluster"] for r in assigned.where(f"k = {k}").collect()}
        of = np.array([label[r["id"]] for r in rows])
        names, n = np.unique(of, return_counts=True)
        far = ((z[:, None] - z[None]) ** 2).sum(2)
        width = []
        for i in range(len(z)):
            own = of == of[i]
            inside = far[i, own].sum() / max(1, own.sum() - 1)
            outside = min(far[i, of == c].mean() for c in names if c != of[i])
            width.append(0.0 if own.sum() == 1 else (outside - inside) / max(inside, outside))
        means = np.array([z[of == c].mean(0) for c in names])
        between = (n[:, None] * (means - z.mean(0)) ** 2).sum() / (len(names) - 1)
        within = sum(((z[of == c] - means[j]) ** 2).sum() for j, c in enumerate(names)) / (len(z) - len(names))
        assert (got[k]["clusters"], got[k]["n"]) == (len(names), len(z))
        assert abs(got[k]["silhouette"] - np.mean(width)) < 1e-9 and abs(got[k]["calinski_harabasz"] - between / within) < 1e-6


def test_best_by_cluster(spark):
    assigned = spark.createDataFrame([(i, i % 4) for i in range(40)], "id int, cluster int")
    best = spark.createDataFrame([("p", 0), ("p", 4), ("p", 1), ("q", 2)], "profile string, id int")
    got = {(r["profile"], r["cluster"]): (r["n"], r["share"], r["expected"], r["lift"]) for r in multivariate.best_by_cluster(best, assigned, "id").collect()}
    assert got["p", 0] == pytest.approx((2, 2 / 3, 0.25, 8 / 3)) and got["q", 0] == (0, 0.0, 0.25, 0.0) and len(got) == 8


def test_steps_stay_within_bounds():
    assert weight_search.steps_around(0.2) == pytest.approx([0.15, 0.175, 0.2, 0.225, 0.25])
    assert weight_search.steps_around(0.03) == pytest.approx([0.02, 0.045, 0.07]) and weight_search.steps_around(0.39) == pytest.approx([0.34, 0.365, 0.39])
    out = weight_search.scaled({"a": 1.0, "b": 3.0}, {"c": 0.2})
    assert out == pytest.approx({"a": 0.2, "b": 0.6, "c": 0.2})


def test_coordinate_search(spark):
    rng = np.random.default_rng(9)
    x, ret = np.round(rng.random((40, 3)), 6), np.round(rng.normal(size=40), 6)
    factors, start, fixed = ["a", "b"], {"a": 0.3, "b": 0.35}, {"c": 0.1}
    long = spark.createDataFrame([(i, f, float(x[i, k])) for i in range(40) for k, f in enumerate([*factors, "c"])], "entity_id int, factor string, x double")
    returns = spark.createDataFrame([(i, float(r)) for i, r in enumerate(ret)], "entity_id int, ret double")

    def ratio(weights):
        w = weight_search.scaled(weights, fixed)
        score = np.round(sum(w[f] * x[:, k] for k, f in enumerate([*factors, "c"])), 8)
        best = ret[np.lexsort((np.arange(40), -score))[:8]]
        return round(best.mean() / best.std(ddof=1), 9)

    current, best, count = dict(start), ratio(start), 1
    for _ in range(3):
        improved = False
        for f in factors:
            for w in weight_search.steps_around(start[f]):
                count += 1
                r = ratio(current | {f: w})
                if r > best:
                    best, chosen, improved = r, w, True
                    found = chosen
                else:
                    continue
            if improved and "found" in locals():
                current[f] = found
                del found
        if not improved:
            break
    weights, got, n = weight_search.coordinate_search(long, returns, start, 8, fixed)
    assert got == pytest.approx(best, abs=1e-8) and n == count and weights == pytest.approx(weight_search.scaled(current, fixed))
