"""Cutoffs against known quantiles."""

from __future__ import annotations

import pytest

from panelforge.operators import cleaning


@pytest.mark.parametrize(("dimensions", "level", "quantile"), [(1, 0.975, 5.023886), (2, 0.975, 7.377759), (3, 0.975, 9.348404), (11, 0.975, 21.920049), (30, 0.95, 43.772972)])
def test_chi_square_cutoff(dimensions, level, quantile):
    assert abs(cleaning.chi_square_cutoff(dimensions, level) - quantile) < 1e-5


def test_outliers_of_three_columns(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(60, 3)), [[9.0, -9.0, 9.0]]])
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)] + [(99, None, 1.0, 1.0)], "entity_id int, a double, b double, c double")
    got = {r["entity_id"]: r for r in cleaning.mahalanobis_outliers(df, ["a", "b", "c"]).collect()}
    away = x - x.mean(0)
    d = np.einsum("ij,jk,ik->i", away, np.linalg.inv(np.cov(x.T)), away)
    assert all(got[i]["outlier"] == (d[i] > 9.348404) and abs(got[i]["distance"] ** 2 - d[i]) < 1e-6 for i in range(61)) and got[60]["outlier"] and 99 not in got
