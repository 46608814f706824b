"""The best rows of subsamples and of candidate weights against copies of rows for each."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.operators import resampling as W


@pytest.mark.parametrize("cells", [1_000_000, 7])
def test_tops_equal_copies_of_rows(spark, monkeypatch, cells):
    monkeypatch.setattr(W, "CELLS", cells)
    rng = np.random.default_rng(3)
    scores = spark.createDataFrame([(i, float(np.round(rng.normal(), 1))) for i in range(80)] + [(80, None)], "entity_id long, score double").repartition(3)
    sub = W.subsample(scores, (0, 11), 0.5, 9)
    inside = {r[0]: r[1] for r in W.top_sets(sub, 6, ["replicate"]).groupBy("entity_id").count().collect()}
    drawn = {r[0]: r[1] for r in sub.groupBy("entity_id").count().collect()}
    assert {r["entity_id"]: (r["drawn"], r["n"]) for r in W.subsample_tops(scores, 12, 0.5, 6, 9).collect()} == {k: (n, inside.get(k, 0)) for k, n in drawn.items()}

    long = spark.createDataFrame([(i, f, None if i == 5 and f == "a" else float(rng.integers(0, 4))) for i in range(60) for f in "abc"], "entity_id long, factor string, x double").repartition(3)
    weights = W.random_weights(spark, ["a", "b", "c"], 9, 2).localCheckpoint()
    top = lambda s: sorted(W.top_sets(s, 5, ["candidate"]).select("candidate", "position", "entity_id", F.round("score", 7)).collect())
    assert top(W.candidate_tops(long, weights, 5)) == top(W.evaluated(long, weights))


def test_tops_take_no_copies(spark):
    """Before, a row was copied for every replicate and candidate."""
    scores = spark.range(3000).select(F.col("id").alias("entity_id"), (F.col("id") * 1.0).alias("score")).coalesce(1)
    long = scores.select("entity_id", F.lit("a").alias("factor"), F.col("score").alias("x"))
    assert W.candidate_tops(long, W.random_weights(spark, ["a"], 40, 1), 5).count() < 3000 * 40 / 4
