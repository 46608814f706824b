"""Registered queries: principal components and clusters; held against numpy in the tests, as SQL has no eigenvectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelforge.functions.tables import settled
from panelforge.operators import multivariate as M
from panelforge.operators import weight_search as S
from panelforge.operators.portfolio import members
from panelforge.plans.clean import rounded
from panelforge.plans.score import FACTORS, _preference
from panelforge.plans.series_and_weights import _factors
from panelforge.sources.panels import INDICATORS, entity_panel

COLUMNS = ["revenue", "return_rate", "mean_discount", "urgent_share"]


def _panel(spark, sf_dir):
    return entity_panel(spark, sf_dir).dropna(subset=COLUMNS)


def mv_components(spark, sf_dir):
    """Eigenvalues, shares and loadings of all indicators."""
    return rounded(M.principal_components(entity_panel(spark, sf_dir), INDICATORS))


def mv_projection(spark, sf_dir):
    """Scores of every entity with all indicators on the first four components."""
    return rounded(M.projected(entity_panel(spark, sf_dir), "entity_id", INDICATORS, 4))


def mv_elbow(spark, sf_dir):
    return rounded(M.elbow(settled(_panel(spark, sf_dir).select(*COLUMNS), "panel"), COLUMNS, list(range(2, 10))), 4)


def mv_clusters(spark, sf_dir):
    p = _panel(spark, sf_dir)
    assigned = M.clusters(p, "entity_id", COLUMNS, 4)
    return rounded(M.cluster_profiles(p, assigned, "entity_id", COLUMNS).crossJoin(F.broadcast(M.variance_ratio(p, assigned, "entity_id", COLUMNS))), 4)


def mv_cuts(spark, sf_dir):
    """Silhouette and Calinski-Harabasz ratio of the cluster tree cut at 3 to 6 clusters."""
    p = settled(_panel(spark, sf_dir), "panel")
    return rounded(M.cut_measures(p, M.cuts(p, "entity_id", COLUMNS, [3, 4, 5, 6]), "entity_id", COLUMNS), 4)


def mv_best_by_cluster(spark, sf_dir):
    """Where the 20 best of every profile lie among four clusters."""
    p = settled(_panel(spark, sf_dir), "panel")
    best = members(_preference(spark, sf_dir), 20, "profile").select("profile", "entity_id")
    return rounded(M.best_by_cluster(best, settled(M.clusters(p, "entity_id", COLUMNS, 4), "clusters"), "entity_id"), 4)


def res_coordinate_search(spark, sf_dir):
    """Weights near those that squared loadings suggest, searched one at a time for the best ratio of the 20 best."""
    panel = settled(entity_panel(spark, sf_dir), "panel")
    start = M.loading_weights(panel, FACTORS)
    return rounded(S.search_table(_factors(spark, sf_dir), panel.select("entity_id", F.col("momentum").alias("ret")), start, 20))


QUERIES = {
    "mv_cuts": (mv_cuts, None),
    "mv_best_by_cluster": (mv_best_by_cluster, None),
    "res_coordinate_search": (res_coordinate_search, None),
    "mv_components": (mv_components, None),
    "mv_projection": (mv_projection, None),
    "mv_elbow": (mv_elbow, None),
    "mv_clusters": (mv_clusters, None),
}
