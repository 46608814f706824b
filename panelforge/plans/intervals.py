"""Registered queries: intervals of ranks over bootstrap draws and random weights."""

from __future__ import annotations

from panelforge.operators import rank_intervals as I
from panelforge.plans.clean import rounded
from panelforge.plans.score import sql_rank
from panelforge.plans.series_and_weights import BASE, _candidates_sql, _even, _limits, uniform_sql

REPLICATES = 1000


def res_rank_intervals(spark, sf_dir):
    """Rank intervals of every entity over 1,000 bootstrap draws and 1,000 random weightings."""
    return rounded(I.intervals(_even(spark, sf_dir), REPLICATES, 42), 3)


_U = uniform_sql("'42'", "replicate::VARCHAR", "entity_id::VARCHAR")
_POISSON = f"CASE {' '.join(f'WHEN u < {limit!r}::DOUBLE THEN {k}' for k, limit in enumerate(_limits))} ELSE 8 END"
RES_RANK_INTERVALS = f"""{_candidates_sql({"even": BASE})}, r AS (
  SELECT unnest(range({REPLICATES}))::INT AS replicate
), u AS (
  SELECT entity_id, score, replicate, {_U} AS u, {uniform_sql("'59'", "replicate::VARCHAR", "entity_id::VARCHAR")} AS v FROM s, r
), m AS (
  SELECT *, {_POISSON} AS m FROM u
), g AS (
  SELECT replicate, score, sum(m) AS k, sum(sum(m)) OVER (PARTITION BY replicate ORDER BY score DESC) AS c FROM m GROUP BY replicate, score
), a AS (
  SELECT m.entity_id, (g.c - g.k + (g.k + 1) / 2.0)::DOUBLE AS rank FROM m JOIN g USING (replicate, score) WHERE m > 0
), moved AS (
  SELECT entity_id, replicate, -ROUND(score * -ln(greatest(v, 1e-12)), 8) AS z FROM u
), b AS (
  SELECT entity_id, ({sql_rank("z", "replicate", False)})::DOUBLE AS rank FROM moved
), o AS (
  SELECT entity_id, {sql_rank("z", pct=False)} AS original_rank FROM (SELECT entity_id, -score AS z FROM s)
), ga AS (
  SELECT entity_id, count(*)::INT AS n_drawn, avg(rank) AS mean, stddev_pop(rank) AS sd, quantile_cont(rank, 0.025) AS lo, quantile_cont(rank, 0.975) AS hi FROM a GROUP BY entity_id HAVING count(*) >= 10
), gb AS (
  SELECT entity_id, avg(rank) AS mean, stddev_pop(rank) AS sd FROM b GROUP BY entity_id
), gc AS (
  SELECT entity_id, avg(rank) AS mean, stddev_pop(rank) AS sd, quantile_cont(rank, 0.025) AS lo, quantile_cont(rank, 0.975) AS hi FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY entity_id
), n AS (
  SELECT count(*) AS n FROM s
)
SELECT entity_id, round(original_rank, 3) AS original_rank, n_drawn, round(ga.mean, 3) AS bootstrap_rank, round(ga.sd, 3) AS bootstrap_std, round(gb.mean, 3) AS bayesian_rank, round(gb.sd, 3) AS bayesian_std,
  round(gc.mean, 3) AS consensus_rank, round(gc.sd, 3) AS rank_std, round(ga.lo, 3) AS bootstrap_lower, round(ga.hi, 3) AS bootstrap_upper, round(gc.lo, 3) AS ci_lower, round(gc.hi, 3) AS ci_upper,
  round(gc.hi - gc.lo, 3) AS ci_width, ga.sd < 5 AS stable, ga.sd < 0.15 * n AS stable_relaxed, gc.hi - gc.lo < 0.2 * n AS stable_strict, gc.hi - gc.lo < 0.35 * n AS stable_moderate
FROM ga JOIN gb USING (entity_id) JOIN gc USING (entity_id) JOIN o USING (entity_id), n"""

QUERIES = {"res_rank_intervals": (res_rank_intervals, RES_RANK_INTERVALS)}
