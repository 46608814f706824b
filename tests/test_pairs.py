"""Signs of pairs by sorted runs against all pairs."""

from __future__ import annotations

import numpy as np
import pytest

from panelforge.operators.inference import merge_sign


@pytest.mark.parametrize("n", [0, 1, 2, 5, 60, 200])
@pytest.mark.parametrize("kinds", [1, 3, 1000])
def test_merge_sign(n, kinds):
    rng = np.random.default_rng(n + kinds)
    a, b, w, other = rng.integers(0, kinds, n).astype(float), rng.integers(0, kinds, n).astype(float), rng.integers(1, 4, n), rng.integers(0, 3, n)
    pairs = [(i, j) for i in range(n) for j in range(i)]
    sign = lambda i, j: w[i] * w[j] * np.sign(a[i] - a[j]) * np.sign(b[i] - b[j])
    assert merge_sign(a, b, w) == sum(sign(i, j) for i, j in pairs)
    assert merge_sign(a, b, w, other) == sum(sign(i, j) for i, j in pairs if other[i] != other[j])
