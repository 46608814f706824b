"""Blocks of the exact search: how often vectors are sent, and what tiles of points give."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from panelforge.operators import similarity


def test_vectors_are_sent_a_few_times_until_blocks_are_full(spark, monkeypatch):
    nodes = spark.range(4096).select(F.col("id").alias("node"), F.col("id").alias("first"), F.array(F.lit(1.0), F.lit(2.0)).alias("v"))
    assert similarity._blocked(nodes, nodes, 64).count() <= 2 * 4096 * 3
    monkeypatch.setattr(similarity, "MOST_ROWS", 512)
    assert similarity._blocked(nodes, nodes, 64).count() == 2 * 4096 * 8


def test_tiles_change_no_peer(spark, monkeypatch):
    v = np.random.default_rng(5).normal(size=(70, 3)).round(1)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id bigint, v array<double>")
    for metric in similarity.METRICS:
        whole = sorted(map(tuple, similarity.nearest(df, "id", "v", 4, metric=metric).collect()))
        ends = similarity.extremes(df, "id", "v", metric=metric).collect()
        with monkeypatch.context() as m:
            m.setattr(similarity, "BLOCK", 8)
            m.setattr(similarity, "STRIP", 16)
            assert sorted(map(tuple, similarity.nearest(df, "id", "v", 4, block=30, metric=metric).collect())) == whole and len(whole) == 280
            assert similarity.extremes(df, "id", "v", block=30, metric=metric).collect() == ends
