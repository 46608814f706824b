"""Registered queries: held-out entities among the others, calibration of proxies and their validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelforge.operators import proxies as P
from panelforge.plans.clean import rounded
from panelforge.plans.score import sql_rank
from panelforge.plans.tests_and_fits import two_sided_sql
from panelforge.sources.panels import PANEL_SQL, entity_panel, long_sql

#: proxy -> the indicator that it stands for
STANDS_FOR = {"unit_price": "mean_order", "momentum": "quantity", "return_rate": "urgent_share"}
PROXIES = list(STANDS_FOR)


def _placed(spark, sf_dir):
    """Every third entity is held out and placed among the others of its sector."""
    p = entity_panel(spark, sf_dir)
    long = p.unpivot(["entity_id", "sector", *STANDS_FOR.values()], PROXIES, "indicator", "value").where("value is not null")
    return P.placed_among(long.where("entity_id % 3 = 0"), long.where("entity_id % 3 <> 0"), ["indicator", "sector"], "value")


def trf_held_out(spark, sf_dir):
    """Proxies of held-out entities: their percentile among the others of the sector, kept within 5 and 95."""
    return rounded(_placed(spark, sf_dir).select("entity_id", "indicator", "placed"), 4)


def _real():
    return F.coalesce(*[F.when(F.col("indicator") == k, F.col(v)) for k, v in STANDS_FOR.items()])


def test_held_out_proxies(spark, sf_dir):
    """Agreement of held-out entities' proxies with what they stand for."""
    return rounded(P.held_out_validation(_placed(spark, sf_dir).select("indicator", _real().alias("real"), F.col("placed").alias("proxy")), PROXIES), 4)


def test_calibration(spark, sf_dir):
    """Real values of some entities against proxies of the others, on the scale of the real ones."""
    p = entity_panel(spark, sf_dir).select("entity_id", *STANDS_FOR, *STANDS_FOR.values())
    long = p.unpivot(["entity_id", *STANDS_FOR.values()], PROXIES, "indicator", "own")
    proxy = F.col("entity_id") % 4 != 0
    value = F.when(proxy, 0.9 * _real() + 0.1 * F.abs("own")).otherwise(_real())
    return rounded(P.calibration(long.select("indicator", value.alias("value"), proxy.alias("proxy")), PROXIES), 4)


_PLACED_SQL = f"""WITH {PANEL_SQL}, cells AS ({long_sql(PROXIES)}), given AS (
  SELECT * FROM cells WHERE value IS NOT NULL
), sizes AS (
  SELECT indicator, sector, count(*) AS n FROM given WHERE entity_id % 3 <> 0 GROUP BY ALL
), placed AS (
  SELECT h.entity_id, h.indicator, CASE WHEN coalesce(n, 0) >= 2 THEN least(95, greatest(5, 100 * (SELECT count(*) FILTER (r.value < h.value) + count(*) FILTER (r.value = h.value) / 2.0 FROM given r
    WHERE r.entity_id % 3 <> 0 AND r.indicator = h.indicator AND r.sector = h.sector) / n)) ELSE 50 END::DOUBLE AS placed
  FROM given h LEFT JOIN sizes USING (indicator, sector) WHERE h.entity_id % 3 = 0
)"""
_KENDALL = """
  SELECT indicator, sum(sign(a.x - b.x) * sign(a.y - b.y))::DOUBLE AS s FROM {rows} a JOIN {rows} b USING (indicator) WHERE a.id < b.id GROUP BY indicator"""


def _taus_sql(rows: str) -> str:
    ties = lambda c, k: f"{k} AS (SELECT indicator, sum(t) AS n, sum(t * (t - 1) / 2) AS t, sum(t * (t - 1) * (t - 2)) AS u, sum(t * (t - 1) * (2 * t + 5)) AS w FROM (SELECT indicator, count(*)::DOUBLE AS t FROM {rows} GROUP BY indicator, {c}) GROUP BY indicator)"
    return f"""signs AS ({_KENDALL.format(rows=rows)}
), {ties("x", "tx")}, {ties("y", "ty")}, taus AS (
  SELECT indicator, s / sqrt((tx.n * (tx.n - 1) / 2 - tx.t) * (tx.n * (tx.n - 1) / 2 - ty.t)) AS tau,
    s / sqrt((tx.n * (tx.n - 1) * (2 * tx.n + 5) - tx.w - ty.w) / 18 + 2 * tx.t * ty.t / (tx.n * (tx.n - 1)) + tx.u * ty.u / (9 * tx.n * (tx.n - 1) * (tx.n - 2))) AS z
  FROM signs JOIN tx USING (indicator) JOIN ty USING (indicator)
)"""


_RHO = f"""rhos AS (
  SELECT indicator, corr(rx, ry) AS rho, count(*) AS n FROM (SELECT indicator, {sql_rank("x", "indicator", False)} AS rx, {sql_rank("y", "indicator", False)} AS ry FROM pairs) GROUP BY indicator
), limits AS (
  SELECT *, {two_sided_sql("(atanh(rho) * sqrt(n - 3))")} AS p, tanh(atanh(rho) - 1.959963984540054 / sqrt(n - 3)) AS low, tanh(atanh(rho) + 1.959963984540054 / sqrt(n - 3)) AS high FROM rhos
), adjusted AS (
  SELECT indicator, least(1, min(q) OVER (ORDER BY p DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS bh FROM (SELECT indicator, p, p * count(p) OVER () / row_number() OVER (ORDER BY p) AS q FROM limits)
)"""
_LABEL = "CASE WHEN abs(d) < 0.2 THEN 'negligible' WHEN abs(d) < 0.5 THEN 'small' WHEN abs(d) < 0.8 THEN 'medium' ELSE 'large' END"

TEST_HELD_OUT = f"""{_PLACED_SQL}, pairs AS (
  SELECT entity_id AS id, indicator, CASE indicator {" ".join(f"WHEN '{k}' THEN {v}" for k, v in STANDS_FOR.items())} END AS x, placed AS y FROM placed JOIN panel USING (entity_id) WHERE x IS NOT NULL
), {_taus_sql("pairs")}, {_RHO}, effects AS (
  SELECT indicator, avg(x) AS mx, avg(y) AS my, (avg(x) - avg(y)) / sqrt((var_samp(x) + var_samp(y)) / 2) AS d FROM pairs GROUP BY indicator
)
SELECT indicator, n, round(rho, 4) AS rho, round(p, 4) AS p, round(low, 4) AS low, round(high, 4) AS high, round(tau, 4) AS tau, round({two_sided_sql("z")}, 4) AS tau_p, round(d, 4) AS d, round(mx, 4) AS mean_real, round(my, 4) AS mean_proxy,
  round(bh, 4) AS p_adjusted, {_LABEL} AS effect, bh < 0.05 AS significant, CASE WHEN p >= 0.05 THEN 'ordering not validated' WHEN rho > 0 THEN 'agrees with real' ELSE 'inverse to real' END AS note
FROM limits JOIN taus USING (indicator) JOIN effects USING (indicator) JOIN adjusted USING (indicator)"""

TEST_CALIBRATION = f"""WITH {PANEL_SQL}, own AS ({" UNION ALL ".join(f"SELECT entity_id, '{k}' AS indicator, {k} AS own, {v} AS real FROM panel" for k, v in STANDS_FOR.items())}), pairs AS (
  SELECT entity_id AS id, indicator, CASE WHEN entity_id % 4 <> 0 THEN 0.9::DOUBLE * real + 0.1::DOUBLE * abs(own) ELSE real END AS x, (entity_id % 4 <> 0)::INT::DOUBLE AS y FROM own WHERE x IS NOT NULL
), {_taus_sql("pairs")}, {_RHO}, effects AS (
  SELECT indicator, count(*) FILTER (y = 0) AS n1, count(*) FILTER (y = 1) AS n2, avg(x) FILTER (y = 0) AS m1, avg(x) FILTER (y = 1) AS m2, var_samp(x) FILTER (y = 0) AS v1, var_samp(x) FILTER (y = 1) AS v2 FROM pairs GROUP BY indicator
), sized AS (
  SELECT *, (m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)) AS d FROM effects
), steps AS (
  SELECT indicator, x, sum(k1) OVER w AS c1, sum(k2) OVER w AS c2 FROM (SELECT indicator, x, count(*) FILTER (y = 0) AS k1, count(*) FILTER (y = 1) AS k2 FROM pairs GROUP BY indicator, x) WINDOW w AS (PARTITION BY indicator ORDER BY x)
), ks AS (
  SELECT indicator, max(abs(c1 / n1::DOUBLE - c2 / n2::DOUBLE)) AS ks, max(abs(c1 / n1::DOUBLE - c2 / n2::DOUBLE)) * sqrt(max(n1) * max(n2) / (max(n1) + max(n2))::DOUBLE) AS t FROM steps JOIN effects USING (indicator) GROUP BY indicator
)
SELECT indicator, n1 AS n_real, n2 AS n_proxy, round(m1, 4) AS mean_real, round(m2, 4) AS mean_proxy, round(d, 4) AS d, round(ks, 4) AS ks,
  round(CASE WHEN t < 0.2 THEN 1 ELSE least(1, greatest(0, list_sum(list_transform(range(1, 21), lambda i: 2 * (-1.0) ** (i - 1) * exp(-2.0 * i * i * t * t))))) END, 4) AS ks_p,
  round(rho, 4) AS rho, round(p, 4) AS p, round(low, 4) AS low, round(high, 4) AS high, round(tau, 4) AS tau, round(bh, 4) AS p_adjusted, {_LABEL} AS effect, bh < 0.05 AS significant,
  CASE WHEN p < 0.05 THEN 'proxies are offset' ELSE 'proxies lie where real values do' END AS note
FROM sized JOIN ks USING (indicator) JOIN limits USING (indicator) JOIN taus USING (indicator) JOIN adjusted USING (indicator)"""

QUERIES = {
    "trf_held_out": (trf_held_out, f"{_PLACED_SQL} SELECT entity_id, indicator, round(placed, 4) AS placed FROM placed"),
    "test_held_out_proxies": (test_held_out_proxies, TEST_HELD_OUT),
    "test_calibration": (test_calibration, TEST_CALIBRATION),
}
