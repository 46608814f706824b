"""Cells of vectors of few dimensions give what pairs of blocks give."""

from __future__ import annotations

import numpy as np
import pytest

from panelforge.operators import similarity, space


def _vectors(rng, kind: str) -> np.ndarray:
    v = rng.normal(size=(500, 4)) * [1, 0.2, 0.01, 0.1]
    if kind == "cone":
        v += [2, 0, 0, 0]
    if kind == "tails":
        v[:20] *= 50
    if kind == "ties":
        v = np.concatenate([v.round(1), v[:40] * 2, np.zeros((3, 4)), v[:30] * (1 + 1e-10)])
    return v


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
@pytest.mark.parametrize("kind", ["cloud", "cone", "tails", "ties"])
def test_cells_change_no_peer(spark, monkeypatch, metric, kind):
    rng = np.random.default_rng(8)
    v = _vectors(rng, kind)
    ids = rng.permutation(len(v))
    df = spark.createDataFrame([(int(i), x.tolist()) for i, x in zip(ids, v, strict=True)], "id bigint, v array<double>")
    monkeypatch.setattr(space, "CELL", 25)
    met, compared = space.Space.met, []

    def counted(self, probes, most):
        out = met(self, probes, 40)
        compared.append(probes.count())
        return out

    monkeypatch.setattr(space.Space, "met", counted)
    weights = [1.0, 2.0, 0.5, 1.0] if kind == "tails" else None
    got: dict = {}
    for r in similarity.nearest(df, "id", "v", 4, metric=metric, weights=weights).collect():
        got.setdefault(r["id"], set()).add((r["peer"], r["similarity"]))
    assert compared and compared[0] < 0.6 * len(v) * len(v) / 25  # cells visited; all would be rows * cells
    w = v * weights if weights else v
    sim = np.round(similarity.METRICS[metric](w, w), 9)
    for row, i in enumerate(ids):
        assert got[int(i)] == {(j, -s) for s, j in sorted((-s, int(j)) for s, j in zip(sim[row], ids, strict=True) if j != i)[:4]}
    assert tuple(similarity.extremes(df, "id", "v", metric=metric, weights=weights).head()) == (sim.min(), sim.max())


def test_few_pairs_are_taken_one_by_one(monkeypatch):
    """Pairs whose similarity is taken in full, of 200 queries and 20,000 points: 16,000 were sorted for each query before."""
    rng = np.random.default_rng(9)
    a, b = rng.normal(size=(200, 16)), rng.normal(size=(20_000, 16))
    taken, of_pairs = [], similarity._of_pairs
    monkeypatch.setattr(similarity, "_of_pairs", lambda a, b, metric: taken.append(len(a)) or of_pairs(a, b, metric))
    for metric in similarity.METRICS:
        taken.clear()
        i, j, s = similarity._best(a, b, metric, 6)
        sim = np.round(similarity.METRICS[metric](a, b), 9)
        order = np.argsort(-sim, axis=1, kind="stable")[:, :6]
        assert (j.reshape(200, 6) == order).all() and np.array_equal(s, np.take_along_axis(sim, order, 1).ravel())
        assert metric == "jaccard" or sum(taken) < 200 * 300


def test_splits_of_equal_values():
    x = np.array([[0.0, 1.0]] * 50 + [[0.0, 2.0]] * 2)
    splits = space.Splits(x, 8)
    assert splits.cells == 2 and len(set(splits.of(x).tolist())) == 2 and space.Splits(x[:50], 8).cells == 1
