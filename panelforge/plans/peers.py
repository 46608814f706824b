"""Registered queries: peers by bucket tables, similarities of mean-filled columns on an output scale."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelforge.functions.tables import settled
from panelforge.operators import similarity as M
from panelforge.plans.clean import rounded
from panelforge.sources.panels import PANEL_SQL, entity_panel

#: Columns and what is taken off them, so that signs differ and no mean is near 0.
FEATURES = {"momentum": 0.1, "return_rate": 0.2, "mean_discount": 0.045, "urgent_share": 0.15}
LOW, HIGH = -1.0, 1.0


def sim_approximate(spark, sf_dir):
    """The 15 nearest peers of every embedding by bucket tables; recall against the exact search is measured in tests/test_neighbours.py."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return rounded(M.nearest(e, "vec_id", "embedding", 15, approximate=True), 5)


def sim_peer_excess_approximate(spark, sf_dir):
    """Excess over the 15 nearest peers that bucket tables find."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").withColumn("label", F.col("label").cast("double"))
    return rounded(M.peer_excess(e, "vec_id", "embedding", "label", 15, approximate=True), 5)


def _filled(spark, sf_dir):
    shifted = entity_panel(spark, sf_dir).select("entity_id", *[(F.col(c) - k).alias(c) for c, k in FEATURES.items()])
    return settled(M.mean_filled(shifted, "entity_id", [*FEATURES, "absent"]), "filled")


def _scaled(metric: str):
    def query(spark, sf_dir):
        """The 5 entities most like each by columns filled with their means, on a scale that all pairs span."""
        v = _filled(spark, sf_dir)
        near = M.nearest(v, "entity_id", "vector", 5, metric=metric)
        return rounded(M.rescaled(near, M.extremes(v, "entity_id", "vector", metric=metric), LOW, HIGH), 5)

    return query


_VECTORS = f"""WITH {PANEL_SQL}, c AS (
  SELECT entity_id, {", ".join(f"coalesce({c} - {k}::DOUBLE, avg({c} - {k}::DOUBLE) OVER ()) AS {c}" for c, k in FEATURES.items())} FROM panel
), m AS (
  SELECT entity_id, [{", ".join(FEATURES)}] AS v FROM c
)"""
_MEASURES = {
    "cosine": "list_cosine_similarity(a.v, b.v)",
    "euclidean": "1 / (1 + list_distance(a.v, b.v))",
    "jaccard": f"({' + '.join(f'(a.v[{k}] > 0 AND b.v[{k}] > 0)::INT' for k in range(1, 5))}) / nullif({' + '.join(f'(a.v[{k}] > 0 OR b.v[{k}] > 0)::INT' for k in range(1, 5))}, 0)",
}


def _scaled_sql(metric: str) -> str:
    return f"""{_VECTORS}, p AS (
  SELECT a.entity_id, b.entity_id AS peer, ROUND(coalesce({_MEASURES[metric]}, 0), 9) AS s FROM m a, m b
), e AS (
  SELECT min(s) AS low, max(s) AS high FROM p
), k AS (
  SELECT * FROM p WHERE entity_id <> peer QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY s DESC, peer) <= 5
)
SELECT entity_id, peer, round((s - low) / (high - low) * {HIGH - LOW} + {LOW}, 5) AS similarity FROM k, e"""


QUERIES = {
    "sim_approximate": (sim_approximate, None),
    "sim_peer_excess_approximate": (sim_peer_excess_approximate, None),
    **{f"sim_scaled_{m}": (_scaled(m), _scaled_sql(m)) for m in _MEASURES},
}
