"""Registered queries: methods at the survey's full counts and cutoffs."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelforge.operators import cleaning as C
from panelforge.operators import resampling as W
from panelforge.operators import scoring as S
from panelforge.plans.clean import rounded
from panelforge.plans.series_and_weights import BASE, TOP, _candidates_sql, _even, uniform_sql
from panelforge.sources.panels import PANEL_SQL, entity_panel

LEVELS = [0.1, 0.2, 0.3]
SIMULATIONS = 200


def res_turnover_levels(spark, sf_dir):
    """Turnover of the 20 best over 200 random changes of scores at each of three levels."""
    return rounded(W.turnover_levels(_even(spark, sf_dir), LEVELS, SIMULATIONS, TOP, 42))


RES_TURNOVER_LEVELS = f"""{_candidates_sql({"even": BASE})}, draws AS (
  SELECT entity_id, level, replicate, ROUND(score * (1 + level * (2 * {uniform_sql("'42'", "level::VARCHAR", "replicate::VARCHAR", "entity_id::VARCHAR")} - 1)), 8) AS z
  FROM s, (SELECT unnest({LEVELS}::DOUBLE[]) AS level), (SELECT unnest(range({SIMULATIONS}))::INT AS replicate)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY level, replicate ORDER BY z DESC, entity_id) AS pos FROM draws
), shares AS (
  SELECT level, replicate, count(b.entity_id) / {TOP}.0::DOUBLE AS o FROM placed LEFT JOIN (SELECT entity_id FROM top WHERE position <= {TOP}) b USING (entity_id) WHERE pos <= {TOP} GROUP BY ALL
)
SELECT level, round(avg(o), 5) AS overlap, round(avg(1 - o), 5) AS turnover, round(stddev_pop(1 - o), 5) AS std, round(quantile_cont(1 - o, 0.25), 5) AS low, round(quantile_cont(1 - o, 0.75), 5) AS high FROM shares GROUP BY level"""


def out_mahalanobis_flags(spark, sf_dir):
    """Distances of two indicators from their means, and whether they lie beyond the 97.5 pct quantile of chi-square."""
    return rounded(C.mahalanobis_outliers(entity_panel(spark, sf_dir), ["momentum", "return_rate"]), 4)


OUT_MAHALANOBIS_FLAGS = f"""WITH {PANEL_SQL}, w AS (
  SELECT entity_id, momentum AS x, return_rate AS y FROM panel WHERE momentum IS NOT NULL AND return_rate IS NOT NULL
), s AS (
  SELECT avg(x) AS mx, avg(y) AS my, var_samp(x) AS vx, var_samp(y) AS vy, covar_samp(x, y) AS c FROM w
), d AS (
  SELECT entity_id, sqrt(greatest(((x - mx) * (x - mx) * vy - 2 * (x - mx) * (y - my) * c + (y - my) * (y - my) * vx) / (vx * vy - c * c), 0)) AS distance FROM w, s
)
SELECT entity_id, round(distance, 4) AS distance, round(sqrt(-2 * ln(0.025::DOUBLE)), 4) AS cutoff, distance > sqrt(-2 * ln(0.025::DOUBLE)) AS outlier FROM d"""

PILLARS = {"activity": ["n_orders", "quantity", "absent"], "care": ["return_rate", "mean_discount"], "prices": ["unit_price", "urgent_share", "momentum"]}
CELLS = [c for columns in PILLARS.values() for c in columns]
SOURCES = [name for name, _ in S.SOURCE_LABELS]


def scr_simple_pillars(spark, sf_dir):
    """Plain pillar means, one lifted by the share of filed cells, and each entity's most trusted source; some entities have no sources."""
    p = entity_panel(spark, sf_dir)
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.lit(k).alias("k")) for k, c in enumerate(CELLS)])).alias("cell")
    name = F.get(F.array(*map(F.lit, SOURCES)), ((F.col("entity_id") * 5 + F.col("cell.k") * 3) % 11).cast("int"))
    sources = p.where("entity_id % 13 <> 0").select("entity_id", cells).select("entity_id", "cell.column", name.alias("source")).where("source is not null")
    return rounded(S.simple_pillars(p, "entity_id", PILLARS, sources, "prices"), 4)


_SOURCES_SQL = " UNION ALL ".join(f"SELECT entity_id, '{c}' AS col, ({SOURCES})[(entity_id * 5 + {k * 3}) % 11 + 1] AS source FROM panel WHERE entity_id % 13 <> 0" for k, c in enumerate(CELLS))
_MEAN_SQL = lambda columns: f"({' + '.join(f'coalesce({c}, 0)' for c in columns)}) / nullif({' + '.join(f'({c} IS NOT NULL)::INT' for c in columns)}, 0)"
SCR_SIMPLE_PILLARS = f"""WITH {PANEL_SQL}, sources AS ({_SOURCES_SQL}), own AS (
  SELECT entity_id, count(*) FILTER (source = 'real_sec' AND col IN ('unit_price', 'urgent_share', 'momentum')) / 3.0::DOUBLE AS filed,
    min(list_position({SOURCES}, source)) AS place FROM sources GROUP BY entity_id
)
SELECT entity_id, round({_MEAN_SQL(PILLARS["activity"][:2])}, 4) AS activity, round({_MEAN_SQL(PILLARS["care"])}, 4) AS care,
  round(least(100, greatest(0, coalesce({_MEAN_SQL(PILLARS["prices"])}, 50) * (0.9::DOUBLE + 0.2::DOUBLE * coalesce(filed, 0)))), 4) AS prices, coalesce(({[label for _, label in S.SOURCE_LABELS]})[place], 'imputed') AS source
FROM panel LEFT JOIN own USING (entity_id)"""

QUERIES = {
    "scr_simple_pillars": (scr_simple_pillars, SCR_SIMPLE_PILLARS),
    "res_turnover_levels": (res_turnover_levels, RES_TURNOVER_LEVELS),
    "out_mahalanobis_flags": (out_mahalanobis_flags, OUT_MAHALANOBIS_FLAGS),
}
