"""Bucket tables against the exact search; mean fill and output scale against plain loops."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from panelforge.operators import neighbours, similarity


def pairs(df):
    return {(r["vec_id"], r["peer"]) for r in df.collect()}


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_on_the_embeddings(spark, sf):
    """Queries are the rows whose id is divisible by 100 (by 10 on the smaller table), against all rows."""
    every = 10 if sf == "sf0.01" else 100
    e = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").select("vec_id", "embedding")
    exact = pairs(similarity.nearest(e, "vec_id", "embedding", 15, queries=e.where(F.col("vec_id") % every == 0)))
    found = similarity.nearest(e, "vec_id", "embedding", 15, approximate=True)
    assert found.count() == 15 * e.count()
    got = pairs(found.where(F.col("vec_id") % every == 0))
    assert len(exact & got) >= 0.9 * len(exact)


def test_copies_nulls_zeros_and_few_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(60)] + [(100 + i, [1.0, 2.0, 3.0, 4.0]) for i in range(40)] + [(200, None), (201, [0.0] * 4), (202, [0.0] * 4)]
    df = spark.createDataFrame(rows, "id bigint, v array<double>")
    got = similarity.nearest(df, "id", "v", 3, approximate=True).collect()
    by = {}
    for r in sorted(got, key=lambda r: (-r["similarity"], r["peer"])):
        by.setdefault(r["id"], []).append((r["peer"], r["similarity"]))
    assert set(by) == {r[0] for r in rows} - {200} and all(len(v) == 3 for v in by.values())
    # Every copy has the smallest other copies as peers.
    assert by[139] == [(100, 1.0), (101, 1.0), (102, 1.0)] and by[100] == [(101, 1.0), (102, 1.0), (103, 1.0)]
    few = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id bigint, v array<double>")
    assert sorted(map(tuple, similarity.nearest(few, "id", "v", 5, approximate=True).collect())) == [(1, 2, 0.0), (2, 1, 0.0)]
    assert similarity.nearest(few.limit(0), "id", "v", 5, approximate=True).count() == 0


def test_work_does_not_grow_with_the_square_of_the_rows(spark):
    rng = np.random.default_rng(2)
    frame = lambda n: spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(n)], "id bigint, v array<double>")
    work = []
    for n in (1000, 8000):
        nodes, _ = neighbours.distinct_vectors(frame(n), "v")
        work.append(neighbours.work(nodes, nodes, neighbours.tables_for(nodes)))
    assert work[1] < 14 * work[0]  # 64 times for all pairs


def test_probes_are_the_nearest_buckets():
    rng = np.random.default_rng(3)
    index = neighbours.Tables(np.zeros(6), 5, 2, 6)
    v = rng.normal(size=(20, 6))
    p = (neighbours.unit(v) @ index.directions).reshape(20, 2, 5)
    for row in range(20):
        for t in range(2):
            cost = {}
            for code in range(32):
                signs = np.array([code >> b & 1 for b in range(5)], bool)
                turned = signs != (p[row, t] > 0)
                if turned.sum() <= 3:
                    cost[code] = (p[row, t][turned] ** 2).sum()
            best = sorted(cost, key=cost.get)[:7]
            assert set(index.probed(v)[row, t].tolist()) == set(best) and index.buckets(v)[row, t] == best[0]


def test_cells_cut_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CELL", 7)
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(i, rng.normal(size=3).tolist()) for i in range(80)], "id bigint, v array<double>")
    exact = {(r["id"], r["peer"]) for r in similarity.nearest(df, "id", "v", 4).collect()}
    # One bit and a probe of the other bucket: every pair meets, so the result is exact.
    got = {(r["id"], r["peer"]) for r in neighbours.approximate(df, "id", "v", 4, tables=1, probes=1, bucket=40).collect()}
    assert got == exact


def test_mean_fill_and_output_scale(spark):
    rows = [(1, 1.0, None, None), (2, 3.0, 2.0, None), (3, None, 4.0, None), (4, -1.0, 0.5, None)]
    df = spark.createDataFrame(rows, "id bigint, a double, b double, c double")
    filled = similarity.mean_filled(df, "id", ["a", "b", "c", "absent"])
    assert {r["id"]: r["vector"] for r in filled.collect()} == {1: [1.0, 6.5 / 3, 0.0], 2: [3.0, 2.0, 0.0], 3: [1.0, 4.0, 0.0], 4: [-1.0, 0.5, 0.0]}
    with pytest.raises(ValueError, match="no feature"):
        similarity.mean_filled(df, "id", ["absent"])
    with pytest.raises(ValueError, match="unknown metric"):
        similarity.nearest(filled, "id", "vector", 1, metric="manhattan")
    v = np.array([r["vector"] for r in filled.orderBy("id").collect()])
    for metric in similarity.METRICS:
        m = np.round(similarity.METRICS[metric](v, v), 9)
        ends = similarity.extremes(filled, "id", "vector", block=2, metric=metric)
        assert tuple(ends.head()) == (m.min(), m.max())
        scaled = similarity.rescaled(similarity.nearest(filled, "id", "vector", 3, metric=metric), ends, -1.0, 3.0)
        got = {(r["id"], r["peer"]): r["similarity"] for r in scaled.collect()}
        lo, hi = m.min(), m.max()
        assert all(abs(got[i + 1, j + 1] - ((m[i, j] - lo) / (hi - lo) * 4 - 1 if hi > lo else m[i, j])) < 1e-6 for i in range(4) for j in range(4) if i != j)
    assert similarity.rescaled(filled, None, 0.0, 1.0) is filled


def test_distances_by_products_equal_plain_ones():
    rng = np.random.default_rng(5)
    a = rng.normal(size=(50, 7)) * 100 + 1e4
    b = np.concatenate([a[:20] + 1e-5, rng.normal(size=(30, 7))])
    plain = 1 / (1 + np.sqrt(((a[:, None] - b[None]) ** 2).sum(2)))
    assert np.allclose(similarity._closeness(a, b), plain, rtol=1e-7, atol=1e-9)


@pytest.mark.parametrize("metric", ["cosine", "euclidean", "jaccard"])
def test_exact_search_compares_vectors_once_whatever_their_copies(spark, monkeypatch, metric):
    rng = np.random.default_rng(6)
    base = np.concatenate([rng.normal(size=(30, 5)), np.zeros((1, 5)), 1 + 1e-6 * rng.normal(size=(9, 5))])
    v = base[np.concatenate([np.arange(40), rng.integers(0, 40, 360)])]
    ids = rng.permutation(400)
    df = spark.createDataFrame([(int(i), x.tolist()) for i, x in zip(ids, v, strict=True)] + [(900, None)], "id bigint, v array<double>")
    moved, blocked = [], similarity._blocked

    def counted(*args):
        out = blocked(*args)
        moved.append(out.count())
        return out

    monkeypatch.setattr(similarity, "_blocked", counted)
    asked = df.where("id % 3 = 0")
    got = {}
    for r in similarity.nearest(df, "id", "v", 4, block=20, metric=metric).collect():
        got.setdefault(r["id"], set()).add((r["peer"], r["similarity"]))
    some = similarity.nearest(df.where("v is not null"), "id", "v", 4, block=20, metric=metric, queries=asked).collect()
    sim = np.round(similarity.METRICS[metric](v, v), 9)
    for row, i in enumerate(ids):
        best = sorted((-s, int(j)) for s, j in zip(sim[row], ids, strict=True) if j != i)[:4]
        assert got[int(i)] == {(j, -s) for s, j in best}
        assert i % 3 or {(r["peer"], r["similarity"]) for r in some if r["id"] == i} == got[int(i)]
    assert set(got) == set(range(400))
    assert tuple(similarity.extremes(df, "id", "v", block=20, metric=metric).head()) == (sim.min(), sim.max())
    assert max(moved) <= 2 * 2 * 40  # two blocks of 40 vectors; 400 rows made 20 blocks and 16,000 rows


def test_few_queries_are_spread_at_once():
    rng = np.random.default_rng(7)
    v = rng.normal(size=(1000, 6))
    index = neighbours.Tables(np.zeros(6), 5, 4, 6)
    whole = pa.RecordBatch.from_pydict({"node": np.arange(1000), "v": v.tolist()})
    out = list(neighbours.spread([whole], index, True))
    assert max(b.num_rows for b in out) <= neighbours.SPREAD * 4 * 7
    t = pa.Table.from_batches(out)
    assert t.column("node").to_numpy().tolist() == np.repeat(np.arange(1000), 28).tolist()
    assert t.column("code").to_numpy().tolist() == index.probed(v).ravel().tolist() and t.column("v").to_pylist() == v[t.column("node").to_numpy()].tolist()
