"""Registered queries: factors made monotone in a target."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelforge.operators import monotone as M
from panelforge.operators import scoring as S
from panelforge.plans.clean import rounded
from panelforge.plans.score import probit_sql, sql_rank
from panelforge.sources.panels import PANEL_SQL, entity_panel

#: Factor, target and indicators of each query.
CASES = {"revenue": ("momentum", ["quantity", "mean_order", "urgent_share"]), "unit_price": ("return_rate", ["mean_discount", "acctbal"])}


def _corrected(factor: str):
    target, indicators = CASES[factor]

    def query(spark, sf_dir):
        """A factor, its indicators as normal scores within the sector, made monotone in the target."""
        p = entity_panel(spark, sf_dir)
        z = p.select("entity_id", factor, target)
        for c in indicators:
            z = z.join(S.normal_scores(p, c, f"z_{c}", ["sector"]).select("entity_id", f"z_{c}"), "entity_id")
        return rounded(M.corrected(z, "entity_id", factor, target, [f"z_{c}" for c in indicators]), 4)

    return query


def _bins_sql(value: str, bins: int) -> str:
    return "1 + " + " + ".join(f"({value} > q[{k}])::INT" for k in range(1, bins))


def _means_sql(name: str, column: str, frame: str, bins: int) -> str:
    shares = ", ".join(f"{k / bins}" for k in range(1, bins))
    return f"""{name}_q AS (
  SELECT quantile_cont({column}, [{shares}]) AS q FROM {frame} WHERE {column} IS NOT NULL AND t IS NOT NULL
), {name} AS (
  SELECT {_bins_sql(column, bins)} AS bin, avg({column}) AS x, avg(t) AS y, count(*) AS n FROM {frame}, {name}_q WHERE {column} IS NOT NULL AND t IS NOT NULL GROUP BY 1
), {name}_steps AS (
  SELECT count(*) FILTER (WHERE up >= 0) AS rising, coalesce(bool_and(up >= -1e-10), false) AND max(bins) = {bins} AS monotone
  FROM (SELECT y - lag(y) OVER (ORDER BY bin) AS up, count(*) OVER () AS bins FROM {name})
)"""


def _corrected_sql(factor: str) -> str:
    target, indicators = CASES[factor]
    z = lambda c: f"CASE WHEN {c} IS NOT NULL THEN {probit_sql(f'least(0.99, greatest(0.01, {c}_p))')} END"
    ic = lambda c: f"(SELECT abs(corr(a, b)) FROM (SELECT {sql_rank(f'z_{c}')} AS a, {sql_rank('t')} AS b FROM given WHERE z_{c} IS NOT NULL AND t IS NOT NULL))"
    return f"""WITH {PANEL_SQL}, ranked AS (
  SELECT entity_id, ROUND({factor}, 9) AS f0, {target} AS t, {", ".join(indicators)}, {", ".join(f"{sql_rank(c, 'sector')} AS {c}_p" for c in indicators)} FROM panel
), given AS (
  SELECT entity_id, f0, t, {", ".join(f"{z(c)} AS z_{c}" for c in indicators)} FROM ranked
), ics AS (
  SELECT {", ".join(f"{ic(c)} AS w_{c}" for c in indicators)}
), both_ways AS (
  SELECT entity_id, t, f0, ROUND(({" + ".join(f"coalesce(z_{c}, 0) * w_{c}" for c in indicators)}) / ({" + ".join(f"w_{c}" for c in indicators)}), 9) AS f1 FROM given, ics
), {_means_sql("base", "f0", "both_ways", 5)}, {_means_sql("cand", "f1", "both_ways", 5)}, chosen AS (
  SELECT entity_id, t, CASE WHEN c.rising >= b.rising THEN f1 ELSE f0 END AS f, f0, b.monotone, greatest(c.rising, b.rising) AS rising FROM both_ways, base_steps b, cand_steps c
), {_means_sql("dec", "f", "chosen", 10)}, points AS (
  SELECT row_number() OVER (ORDER BY x) AS k, x, y FROM dec
), pooled AS (
  SELECT a.k AS a, b.k AS b, (SELECT avg(y) FROM points p WHERE p.k BETWEEN a.k AND b.k) AS m FROM points a, points b WHERE a.k <= b.k
), iso AS (
  SELECT k, x, max(m) AS y FROM (SELECT p.k, p.x, o.a, min(o.m) AS m FROM points p, pooled o WHERE o.a <= p.k AND o.b >= p.k GROUP BY ALL) GROUP BY k, x
), segments AS (
  SELECT k, x AS x0, y AS y0, lead(x) OVER (ORDER BY k) AS x1, lead(y) OVER (ORDER BY k) AS y1 FROM iso
), fitted AS (
  SELECT c.*, ROUND(CASE WHEN f <= (SELECT min(x) FROM iso) THEN (SELECT min_by(y, x) FROM iso) WHEN f >= (SELECT max(x) FROM iso) THEN (SELECT max_by(y, x) FROM iso)
    ELSE (SELECT y0 + (y1 - y0) * (c.f - x0) / (x1 - x0) FROM segments WHERE x0 <= c.f AND c.f < x1) END, 9) AS g FROM chosen c
), placed AS (
  SELECT entity_id, f0, monotone, f, CASE WHEN f IS NOT NULL AND t IS NOT NULL THEN f END AS own, CASE WHEN f IS NOT NULL AND t IS NOT NULL THEN g END AS fit,
    least(0.9, 0.6 + 0.1 * greatest(0, 3 - rising))::DOUBLE AS share FROM fitted
), blended AS (
  SELECT entity_id, f0, monotone, CASE WHEN own IS NOT NULL THEN (share * ({sql_rank("fit", pct=False)}) + (1 - share) * ({sql_rank("own", pct=False)})) / count(own) OVER () * 100 ELSE f END AS x FROM placed
)
SELECT entity_id, round(CASE WHEN monotone THEN f0 ELSE coalesce(least(100, greatest(0, (x - avg(x) OVER ()) / stddev_samp(x) OVER () * 10 + 50)), 50) END, 4) AS corrected FROM blended"""


QUERIES = {f"scr_monotone_{factor}": (_corrected(factor), _corrected_sql(factor)) for factor in CASES}
