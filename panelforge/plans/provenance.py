"""Registered queries: scores by the source of their data, each source against a reference."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelforge.operators import rank_tests as T
from panelforge.plans.clean import rounded
from panelforge.plans.tests_and_fits import two_sided_sql
from panelforge.sources.panels import PANEL_SQL, entity_panel, long_sql

SCORES = ["revenue", "n_orders", "momentum", "return_rate"]
#: sources by a rule that leans on size, so that they differ; ``rare`` has few entities
GROUPS = ["real", "proxy", "imputed", "rare"]
RULE = "CASE WHEN entity_id % 500 = 7 THEN 'rare' WHEN entity_id % 4 = 0 OR n_orders > 18 THEN 'real' WHEN entity_id % 4 = 1 THEN 'imputed' ELSE 'proxy' END"


def agg_provenance(spark, sf_dir):
    """Moments of every score by source, and rank tests of each source against the real one."""
    p = entity_panel(spark, sf_dir)
    long = p.select(F.expr(RULE).alias("group"), *SCORES).unpivot("group", SCORES, "score", "value")
    return rounded(T.against_reference(long, SCORES, GROUPS, "real"), 4)


AGG_PROVENANCE = f"""WITH {PANEL_SQL}, cells AS ({long_sql(SCORES)}), given AS (
  SELECT indicator AS score, {RULE} AS grp, value FROM cells JOIN (SELECT entity_id, n_orders FROM panel) USING (entity_id) WHERE value IS NOT NULL
), moments AS (
  SELECT score, grp, count(*) AS n, avg(value) AS mean, stddev_samp(value) AS sd FROM given GROUP BY ALL
), pairs AS (
  SELECT m.score, m.grp, m.n AS n2, r.n AS n1, r.mean - m.mean AS difference FROM moments m JOIN moments r ON r.score = m.score AND r.grp = 'real' WHERE m.grp <> 'real' AND m.n >= 5 AND r.n >= 5
), joint AS (
  SELECT p.score, p.grp, g.grp = 'real' AS ref, g.value FROM pairs p JOIN given g ON g.score = p.score AND g.grp IN (p.grp, 'real')
), ranked AS (
  SELECT *, rank() OVER (PARTITION BY score, grp ORDER BY value) + (count(*) OVER (PARTITION BY score, grp, value) - 1) / 2.0 AS r FROM joint
), ties AS (
  SELECT score, grp, sum(t * t * t - t) AS t FROM (SELECT score, grp, count(*)::DOUBLE AS t FROM joint GROUP BY score, grp, value) GROUP BY ALL
), us AS (
  SELECT score, grp, sum(r) FILTER (ref) - any_value(n1) * (any_value(n1) + 1) / 2 AS u, any_value(n1)::DOUBLE AS n1, any_value(n2)::DOUBLE AS n2, any_value(difference) AS difference, any_value(t) AS t
  FROM ranked JOIN pairs USING (score, grp) JOIN ties USING (score, grp) GROUP BY ALL
), zs AS (
  SELECT *, (u - n1 * n2 / 2) / sqrt(n1 * n2 / 12 * ((n1 + n2 + 1) - t / ((n1 + n2) * (n1 + n2 - 1)))) AS z, 1 - 2 * u / (n1 * n2) AS rb FROM us
), ps AS (
  SELECT *, {two_sided_sql("z")} AS p FROM zs
)
SELECT m.score, m.grp AS "group", m.n, round(m.mean, 4) AS mean, round(m.sd, 4) AS std, round(difference, 4) AS difference, round(u, 4) AS u, round(z, 4) AS z, round(p, 4) AS p, round(rb, 4) AS rank_biserial,
  p < 0.05 AS significant, CASE WHEN p < 0.05 AND abs(rb) > 0.3 THEN 'HIGH' WHEN p < 0.05 THEN 'MODERATE' WHEN p IS NOT NULL THEN 'LOW' END AS risk FROM moments m LEFT JOIN ps ON ps.score = m.score AND ps.grp = m.grp"""

QUERIES = {"agg_provenance": (agg_provenance, AGG_PROVENANCE)}
