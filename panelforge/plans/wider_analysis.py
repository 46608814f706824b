"""Registered queries: wider correlation, regression, portfolio and join analyses."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelforge.functions.tables import settled
from panelforge.functions.tails import chi_square_tail_sql, t_two_sided_sql
from panelforge.operators import analysis as A
from panelforge.operators import inference as I
from panelforge.operators import portfolio as P
from panelforge.operators import scoring as S
from panelforge.operators.ranking import rank_columns, with_bin
from panelforge.plans.clean import rounded
from panelforge.plans.portfolios import BIN_SQL, MEMBERS_SQL, TOP, _scores
from panelforge.plans.score import FACTORS, PROFILES, RANKED_SQL, sql_rank
from panelforge.plans.tests_and_fits import IC_SQL, XS, YS, two_sided_sql
from panelforge.sources.panels import INDICATORS, PANEL_SQL, entity_panel, long_panel, long_sql

ALL = [*XS, *YS]


def _ic_sql(rows: str, by: str, before: str = "") -> str:
    """CTEs that turn rows (by, x, y) into a table ic (by, rho, n, z, se, p)."""
    return f"""{before} rows AS ({rows}), ranked AS (SELECT *, {sql_rank("x", by, False)} AS rx, {sql_rank("y", by, False)} AS ry FROM rows), c AS (SELECT {by}, corr(rx, ry) AS rho, count(*) AS n FROM ranked GROUP BY {by}),
zs AS (SELECT *, atanh(greatest(least(rho, 1 - 1e-12), -1 + 1e-12)) AS z, 1 / sqrt(n - 3) AS se FROM c), ic AS (SELECT *, CASE WHEN n > 3 THEN {two_sided_sql("(z / se)")} END AS p FROM zs)"""


def corr_spearman(spark, sf_dir):
    return rounded(A.rank_matrix(settled(entity_panel(spark, sf_dir), "panel"), "entity_id", ALL).select("a", "b", "rho", "n", "p"))


_ROWS = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {a} AS x, {b} AS y FROM panel WHERE {a} IS NOT NULL AND {b} IS NOT NULL" for i, a in enumerate(ALL) for b in ALL[i + 1 :])
CORR_SPEARMAN = f"WITH {PANEL_SQL}, {_ic_sql(_ROWS, 'a, b')} SELECT a, b, round(rho, 5) AS rho, n, round(p, 5) AS p FROM ic"


def _pairs(panel, target="momentum"):
    rows = panel.select("entity_id", "sector", F.col(target).alias("y"), *XS).unpivot(["entity_id", "sector", "y"], XS, "factor", "x")
    return rows.where("x is not null and y is not null")


def corr_demeaned(spark, sf_dir):
    """Rank correlation of factors less their sector means with the return."""
    return rounded(A.demeaned_correlation(settled(_pairs(entity_panel(spark, sf_dir)), "pairs"), ["factor"], "sector").select("factor", "rho", "n", "p"))


_DEMEANED = " UNION ALL ".join(f"SELECT '{x}' AS factor, {x} - avg({x}) OVER (PARTITION BY sector) AS x, momentum AS y FROM panel WHERE {x} IS NOT NULL AND momentum IS NOT NULL" for x in XS)
CORR_DEMEANED = f"WITH {PANEL_SQL}, {_ic_sql(_DEMEANED, 'factor')} SELECT factor, round(rho, 5) AS rho, n, round(p, 5) AS p FROM ic"
HORIZONS = {"1m": "momentum", "3m": "momentum + mean_discount * 3", "6m": "momentum + return_rate", "12m": "momentum - urgent_share * 2"}


def corr_decay(spark, sf_dir):
    """Rank correlations over four horizons: what the last keeps of the first, variability and sign stability."""
    panel = entity_panel(spark, sf_dir).select("entity_id", *XS, *[F.expr(e).alias(h) for h, e in HORIZONS.items()])
    rows = I.pair_rows(panel, "entity_id", XS, list(HORIZONS))
    ics = I.rank_correlation(settled(rows, "pairs"), ["factor", "target"]).withColumnRenamed("target", "horizon")
    return rounded(A.correlation_decay(ics, "1m", "12m"), 4)


_HORIZON_ROWS = " UNION ALL ".join(f"SELECT '{x}' AS factor, '{h}' AS horizon, {x} AS x, {e} AS y FROM panel WHERE {x} IS NOT NULL AND ({e}) IS NOT NULL" for x in XS for h, e in HORIZONS.items())
CORR_DECAY = f"""WITH {PANEL_SQL}, {_ic_sql(_HORIZON_ROWS, "factor, horizon")}, d AS (SELECT factor, avg(rho) AS m, stddev_pop(rho) AS s, abs(avg(sign(rho))) AS g, abs(max(rho) FILTER (horizon = '12m')) / abs(max(rho) FILTER (horizon = '1m')) AS r FROM ic GROUP BY factor)
SELECT factor, round(m, 4) AS mean_ic, round(s, 4) AS ic_variability, round(g, 4) AS sign_stability, round(r, 4) AS retention, CASE WHEN r >= 0.7 THEN 'slow_decay' WHEN r >= 0.4 THEN 'moderate_decay' ELSE 'fast_decay' END AS decay_class FROM d"""
SIGNS = [("revenue", "momentum", 1), ("return_rate", "momentum", -1), ("mean_discount", "unit_price", -1), ("revenue", "unit_price", 1)]


def _signs(spark, sf_dir):
    ics = I.rank_correlation(settled(I.pair_rows(entity_panel(spark, sf_dir), "entity_id", XS, YS), "pairs"), ["factor", "target"]).select("factor", "target", "rho", "n", "p")
    return A.sign_verdicts(ics, spark.createDataFrame(SIGNS, "factor string, target string, sign int"))


def corr_signs(spark, sf_dir):
    """Whether rank correlations have the expected sign."""
    return rounded(_signs(spark, sf_dir))


SIGNS_SQL = f"""{IC_SQL}, e(factor, target, sign) AS (VALUES {", ".join(f"('{a}', '{b}', {s})" for a, b, s in SIGNS)}), q AS (SELECT factor, target, sign, rho, n, {two_sided_sql("(z / se)")} AS p FROM e JOIN z USING (factor, target)),
signs AS (SELECT *, CASE WHEN n < 10 THEN 'INSUFFICIENT_DATA' WHEN rho * sign > 0 AND p < 0.05 THEN 'CONSISTENT' WHEN rho * sign > 0 THEN 'WEAK_CONSISTENT' ELSE 'INCONSISTENT' END AS verdict FROM q)"""
CORR_SIGNS = f"{SIGNS_SQL} SELECT factor, target, sign, round(rho, 5) AS rho, n, round(p, 5) AS p, verdict FROM signs"


def corr_countries(spark, sf_dir):
    """Rank correlation of sector means between each pair of countries."""
    means = entity_panel(spark, sf_dir).groupBy("country", "sector").agg(F.avg("revenue").alias("m"))
    a, b = means.toDF("a", "sector", "x"), means.toDF("b", "sector", "y")
    return rounded(I.rank_correlation(settled(a.join(b, "sector").where("a < b"), "means"), ["a", "b"]).select("a", "b", "rho", "n"))


CORR_COUNTRIES = f"WITH {PANEL_SQL}, m AS (SELECT country, sector, avg(revenue) AS m FROM panel GROUP BY ALL), {_ic_sql('SELECT p.country AS a, q.country AS b, p.m AS x, q.m AS y FROM m p JOIN m q ON p.sector = q.sector AND p.country < q.country', 'a, b')} SELECT a, b, round(rho, 5) AS rho, n FROM ic"


def corr_within_shift(spark, sf_dir):
    """How far percentiles over all rows are from those within a country."""
    return rounded(A.percentile_shift(settled(long_panel(entity_panel(spark, sf_dir), XS), "cells"), "country"), 4)


CORR_WITHIN_SHIFT = f"""WITH {PANEL_SQL}, cells AS ({long_sql(XS)}), r AS (SELECT indicator, country, 100 * ({sql_rank("value", "indicator")}) AS a, 100 * ({sql_rank("value", "indicator, country")}) AS o FROM cells)
SELECT indicator, country, count(a) AS n, round(avg(a), 4) AS mean_pooled, round(avg(o), 4) AS mean_within, round(avg(a - o), 4) AS mean_shift, round(avg(abs(a - o)), 4) AS mean_abs_shift, round(max(abs(a - o)), 4) AS max_abs_shift FROM r WHERE a IS NOT NULL GROUP BY ALL"""


def corr_circularity(spark, sf_dir):
    """Correlation with the return of a profile's score with and without the factor that holds the return."""
    norms = S.factor_norms(entity_panel(spark, sf_dir), "entity_id", FACTORS, "rank")
    scores = S.preference(norms, "entity_id", {"with": PROFILES["growth"], "without": S.without_factor(PROFILES["growth"], "momentum")})
    rows = scores.join(entity_panel(spark, sf_dir).select("entity_id", "momentum", "unit_price"), "entity_id").unpivot(["entity_id", "profile", "score"], ["momentum", "unit_price"], "target", "y")
    rows = rows.where("y is not null").select("entity_id", F.col("profile").alias("factor"), "target", F.round("score", 8).alias("x"), "y")
    return rounded(A.with_and_without(I.rank_correlation(settled(rows, "pairs"), ["factor", "target"])), 4)


_CIRCULAR = " UNION ALL ".join(f"SELECT '{n}' AS factor, '{t}' AS target, ROUND({e}, 8) AS x, p.{t} AS y FROM f JOIN panel p USING (entity_id) WHERE p.{t} IS NOT NULL" for t in ("momentum", "unit_price") for n, e in (("with", "f.revenue * 0.2::DOUBLE + f.momentum * 0.6::DOUBLE + f.unit_price * 0.2::DOUBLE"), ("without", "f.revenue * 0.5::DOUBLE + f.unit_price * 0.5::DOUBLE")))
CORR_CIRCULARITY = f"""{RANKED_SQL}, {_ic_sql(_CIRCULAR, "factor, target")}, w AS (SELECT target, max(rho) FILTER (factor = 'with') AS a, max(rho) FILTER (factor = 'without') AS b FROM ic GROUP BY target)
SELECT target, round(a, 4) AS rho_with, round(b, 4) AS rho_without, round(a - b, 4) AS change, round(abs(b) / abs(a), 4) AS kept FROM w"""


def reg_robust(spark, sf_dir):
    """Return on two factors and sector dummies, with errors that hold without equal variances."""
    panel = settled(entity_panel(spark, sf_dir), "panel")
    return rounded(A.robust_regression(panel, ["return_rate", "mean_discount"], "momentum", "sector"), 6)


REG_ROBUST = f"""WITH {PANEL_SQL}, d AS (SELECT return_rate - avg(return_rate) OVER w AS a, mean_discount - avg(mean_discount) OVER w AS b, momentum - avg(momentum) OVER w AS y, sector FROM panel WHERE return_rate IS NOT NULL AND mean_discount IS NOT NULL AND momentum IS NOT NULL WINDOW w AS (PARTITION BY sector)),
s AS (SELECT sum(a * a) AS aa, sum(b * b) AS bb, sum(a * b) AS ab, sum(a * y) AS ay, sum(b * y) AS yb, count(*) AS n, count(DISTINCT sector) AS g FROM d), c AS (SELECT *, aa * bb - ab * ab AS det, (bb * ay - ab * yb) / (aa * bb - ab * ab) AS p, (aa * yb - ab * ay) / (aa * bb - ab * ab) AS q FROM s),
m AS (SELECT sum((y - p * a - q * b) ** 2 * a * a) AS maa, sum((y - p * a - q * b) ** 2 * a * b) AS mab, sum((y - p * a - q * b) ** 2 * b * b) AS mbb FROM d, c),
v AS (SELECT *, n::DOUBLE / (n - 2 - g) * (bb * bb * maa - 2 * bb * ab * mab + ab * ab * mbb) / (det * det) AS va, n::DOUBLE / (n - 2 - g) * (ab * ab * maa - 2 * ab * aa * mab + aa * aa * mbb) / (det * det) AS vb FROM c, m),
t AS (SELECT 'return_rate' AS term, p AS coefficient, sqrt(va) AS se, n FROM v UNION ALL SELECT 'mean_discount', q, sqrt(vb), n FROM v)
SELECT term, round(coefficient, 6) AS coefficient, round(se, 6) AS se, n, round(coefficient / se, 6) AS z, round({two_sided_sql("(coefficient / se)")}, 6) AS p FROM t"""


def reg_country(spark, sf_dir):
    """Difference of one country in each factor, with sector dummies, Bonferroni over the factors."""
    return rounded(A.controlled_difference(entity_panel(spark, sf_dir), ALL, "country", "ASIA", "sector"))


_COUNTRY = " UNION ALL ".join(f"SELECT '{c}' AS factor, sector, (country = 'ASIA')::INT::DOUBLE AS x, {c} AS y FROM panel WHERE {c} IS NOT NULL AND country IS NOT NULL" for c in ALL)
REG_COUNTRY = f"""WITH {PANEL_SQL}, r AS ({_COUNTRY}), g AS (SELECT factor, sector, count(*) AS n, regr_sxx(y, x) AS xx, regr_sxy(y, x) AS xy, regr_syy(y, x) AS yy FROM r GROUP BY ALL), s AS (SELECT factor, sum(n)::BIGINT AS n, sum(n)::BIGINT - count(*) - 1 AS free, sum(xx) AS xx, sum(xy) AS xy, sum(yy) AS yy FROM g GROUP BY factor),
t AS (SELECT *, xy / xx AS b, xy / xx / sqrt((yy - xy * xy / xx) / free / xx) AS t FROM s), p AS (SELECT *, {t_two_sided_sql("t", "free")} AS p FROM t) SELECT factor, round(b, 5) AS coefficient, round(t, 5) AS t, round(p, 5) AS p, p < 0.05 / {len(ALL)} AS significant, n FROM p"""


def test_welch_anova(spark, sf_dir):
    return rounded(A.welch_anova(entity_panel(spark, sf_dir), "momentum", "sector"))


TEST_WELCH_ANOVA = f"""WITH {PANEL_SQL}, g AS (SELECT count(momentum)::DOUBLE AS n, avg(momentum) AS m, var_samp(momentum) AS v FROM panel WHERE momentum IS NOT NULL AND sector IS NOT NULL GROUP BY sector HAVING count(*) > 1), k AS (SELECT sum(n / v * m) / sum(n / v) AS mean FROM g),
t AS (SELECT (m - mean) / sqrt(v / n) AS t, n - 1 AS f, n - 1.5 AS a, 48 * (n - 1.5) ** 2 AS b FROM g, k), c AS (SELECT *, sqrt(a * ln(1 + t * t / f)) AS c FROM t),
z AS (SELECT c + (c ** 3 + 3 * c) / b - (4 * c ** 7 + 33 * c ** 5 + 240 * c ** 3 + 855 * c) / (10 * b * b + 8 * b * c ** 4 + 1000 * b) AS z FROM c), s AS (SELECT sum(z * z) AS x, count(*) AS k FROM z)
SELECT round(x, 5) AS statistic, k AS "groups", round({chi_square_tail_sql("x", "k - 1")}, 5) AS p FROM s"""


def test_monotone(spark, sf_dir):
    """Whether fifths of each factor have rising or falling mean returns."""
    return rounded(A.bin_monotonicity(settled(_pairs(entity_panel(spark, sf_dir)), "pairs")), 4)


_MONO_BINS = " UNION ALL ".join(f"SELECT '{x}' AS factor, 1 + " + " + ".join(f"({x} > (SELECT quantile_cont({x}, {k / 5}) FROM panel WHERE momentum IS NOT NULL))::INT" for k in range(1, 5)) + f" AS bin, momentum AS y FROM panel WHERE {x} IS NOT NULL AND momentum IS NOT NULL" for x in XS)
MONO_SQL = f"""WITH {PANEL_SQL}, b AS ({_MONO_BINS}), m AS (SELECT factor, bin, avg(y) AS y FROM b GROUP BY ALL), r AS (SELECT factor, bin, y, rank() OVER (PARTITION BY factor ORDER BY y) AS r FROM m),
s AS (SELECT factor, corr(bin, r) AS rho, count(*) AS n, max_by(y, bin) - min_by(y, bin) AS spread FROM r GROUP BY factor),
mono AS (SELECT *, CASE WHEN abs(rho) > 1 - 1e-12 THEN 0 ELSE {t_two_sided_sql("rho * sqrt((n - 2) / greatest(1 - rho * rho, 1e-300))", "n - 2")} END AS p FROM s)"""
TEST_MONOTONE = f"{MONO_SQL} SELECT factor, round(rho, 4) AS rho, round(p, 4) AS p, p < 0.05 AS monotonic, round(spread, 4) AS spread FROM mono"


def test_validity(spark, sf_dir):
    """Rank correlation, spread of fifths and monotonicity of each factor, with mean factor values in the outer fifths."""
    rows = settled(_pairs(entity_panel(spark, sf_dir)), "pairs")
    ic = I.rank_correlation(rows, ["factor"]).select("factor", "n", F.col("rho").alias("ic"), F.col("p").alias("ic_p"))
    ends = with_bin(rows, "x", 5, ["factor"]).groupBy("factor").agg(F.avg(F.when(F.col("bin") == 5, F.col("x"))).alias("top_mean"), F.avg(F.when(F.col("bin") == 1, F.col("x"))).alias("bottom_mean"))
    return rounded(ic.join(A.bin_monotonicity(rows).select("factor", "spread", "monotonic"), "factor").join(ends, "factor"), 4)


_VALID = " UNION ALL ".join(f"SELECT '{x}' AS factor, {x} AS x, momentum AS y FROM panel WHERE {x} IS NOT NULL AND momentum IS NOT NULL" for x in XS)
TEST_VALIDITY = f"""{MONO_SQL}, {_ic_sql(_VALID, "factor")}, q AS (SELECT factor, quantile_cont(x, 0.2) AS lo, quantile_cont(x, 0.8) AS hi FROM rows GROUP BY factor), e AS (SELECT factor, avg(x) FILTER (x > hi) AS t, avg(x) FILTER (x <= lo) AS b FROM rows JOIN q USING (factor) GROUP BY factor)
SELECT factor, ic.n, round(ic.rho, 4) AS ic, round(ic.p, 4) AS ic_p, round(spread, 4) AS spread, mono.p < 0.05 AS monotonic, round(t, 4) AS top_mean, round(b, 4) AS bottom_mean FROM ic JOIN mono USING (factor) JOIN e USING (factor)"""


def test_ordinal(spark, sf_dir):
    """An ordinal column: median, mode, range, rank correlation with a score and Kruskal-Wallis by sector."""
    panel = settled(entity_panel(spark, sf_dir), "panel")
    counts = panel.groupBy("n_orders").count()
    mode = counts.agg(F.max(F.struct("count", -F.col("n_orders"))).alias("m")).select((-F.col("m")["col2"]).alias("mode"))
    from panelforge.operators.ranking import medians

    shape = panel.agg(F.min("n_orders").alias("low"), F.max("n_orders").alias("high"), F.count_distinct("n_orders").alias("n_unique"))
    rho = I.rank_correlation(panel.select("entity_id", F.lit("n_orders").alias("variable"), F.col("n_orders").alias("x"), F.col("revenue").alias("y")).where("x is not null and y is not null"), ["variable"])
    tested = I.kruskal(panel, "n_orders", "sector").select(F.col("h").alias("kruskal_h"), F.col("p").alias("kruskal_p"))
    one = rho.select("variable", F.col("rho").alias("spearman_r"), F.col("p").alias("spearman_p"))
    for frame in (medians(panel, [], "n_orders"), mode, shape, tested):  # one row each
        one = one.crossJoin(F.broadcast(frame))
    return rounded(one, 4)


TEST_ORDINAL = f"""WITH {PANEL_SQL}, {_ic_sql("SELECT 'n_orders' AS variable, n_orders AS x, revenue AS y FROM panel WHERE revenue IS NOT NULL", "variable")},
r AS (SELECT sector, {sql_rank("n_orders", pct=False)} AS r FROM panel), t AS (SELECT sum(c * c * c - c)::DOUBLE AS t FROM (SELECT count(*) AS c FROM panel GROUP BY n_orders)), g AS (SELECT sum(r) * sum(r) / count(*) AS q, count(*) AS n FROM r GROUP BY sector), s AS (SELECT sum(q) AS q, sum(n)::DOUBLE AS n, count(*) AS k FROM g),
h AS (SELECT k, (12 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - t / (n * n * n - n)) AS h FROM s, t), m AS (SELECT n_orders AS mode FROM panel GROUP BY n_orders ORDER BY count(*) DESC, n_orders LIMIT 1), a AS (SELECT quantile_cont(n_orders, 0.5) AS median, min(n_orders) AS low, max(n_orders) AS high, count(DISTINCT n_orders) AS n_unique FROM panel)
SELECT variable, round(rho, 4) AS spearman_r, round(p, 4) AS spearman_p, round(median, 4) AS median, round(mode, 4) AS mode, round(low, 4) AS low, round(high, 4) AS high, n_unique, round(h, 4) AS kruskal_h, round({chi_square_tail_sql("h", "k - 1")}, 4) AS kruskal_p FROM ic, h, m, a"""


def agg_beta(spark, sf_dir):
    """Strategies' mean return less beta times the universe's; return rate stands for beta."""
    panel = entity_panel(spark, sf_dir)
    return rounded(A.beta_decomposition(P.members(_scores(spark, sf_dir), TOP), panel.withColumn("beta", F.col("return_rate") * 3), "momentum", "beta"))


AGG_BETA = f"""{MEMBERS_SQL}, a AS (SELECT avg(momentum) AS b FROM panel), s AS (SELECT strategy, avg(momentum) AS m, max(b) AS b, avg(return_rate * 3) AS beta, stddev_samp(momentum - b) AS te FROM members JOIN panel USING (entity_id), a GROUP BY strategy)
SELECT strategy, round(m, 5) AS mean, round(b, 5) AS benchmark, round(beta, 5) AS beta, round(te, 5) AS tracking_error, round(m - b, 5) AS excess, round(m - beta * b, 5) AS excess_over_beta, round((m - b) / (te + 1e-10), 5) AS information_ratio FROM s"""


def agg_windows(spark, sf_dir):
    """The 20 best by one score against all in four windows of returns."""
    panel = entity_panel(spark, sf_dir).select("entity_id", "mean_order", *[F.expr(e).alias(f"w{h}") for h, e in HORIZONS.items()])
    return rounded(A.windows_beaten(panel, "mean_order", [f"w{h}" for h in HORIZONS], TOP))


AGG_WINDOWS = f"""WITH {PANEL_SQL}, r AS ({" UNION ALL ".join(f"SELECT entity_id, mean_order AS s, 'w{h}' AS w, {e} AS ret FROM panel WHERE mean_order IS NOT NULL AND ({e}) IS NOT NULL" for h, e in HORIZONS.items())}), t AS (SELECT *, row_number() OVER (PARTITION BY w ORDER BY s DESC, entity_id) AS k FROM r),
g AS (SELECT w, avg(ret) AS u, avg(ret) FILTER (k <= {TOP}) AS p, count(*) FILTER (k <= {TOP}) AS size FROM t GROUP BY w) SELECT w AS "window", round(u, 5) AS universe, round(p, 5) AS portfolio, size, round(p - u, 5) AS excess, (p - u > 0)::INT AS beat FROM g"""


def agg_top_vs_bottom(spark, sf_dir):
    return rounded(A.ends_compared(settled(entity_panel(spark, sf_dir), "panel"), "revenue", ["momentum", "unit_price", "return_rate"], TOP))


AGG_TOP_VS_BOTTOM = f"""WITH {PANEL_SQL}, e AS (SELECT *, row_number() OVER (ORDER BY revenue DESC, entity_id) <= {TOP} AS t, row_number() OVER (ORDER BY revenue, entity_id) <= {TOP} AS b FROM panel WHERE revenue IS NOT NULL),
r AS ({" UNION ALL ".join(f"SELECT '{c}' AS metric, t, b, {c} AS x FROM e" for c in ("momentum", "unit_price", "return_rate"))}), s AS (SELECT metric, avg(x) FILTER (t) AS tm, avg(x) FILTER (b) AS bm, var_samp(x) FILTER (t) / count(x) FILTER (t) AS e1, var_samp(x) FILTER (b) / count(x) FILTER (b) AS e2, count(x) FILTER (t) AS n1, count(x) FILTER (b) AS n2 FROM r GROUP BY metric),
a AS ({" UNION ALL ".join(f"SELECT '{c}' AS metric, avg({c}) AS am FROM panel" for c in ("momentum", "unit_price", "return_rate"))}), f AS (SELECT *, (tm - bm) / sqrt(e1 + e2) AS t, (e1 + e2) ** 2 / (e1 * e1 / (n1 - 1) + e2 * e2 / (n2 - 1)) AS free FROM s JOIN a USING (metric))
SELECT metric, round(tm, 5) AS top_mean, round(bm, 5) AS bottom_mean, round(am, 5) AS all_mean, round(tm - bm, 5) AS difference, round(t, 5) AS t, round({t_two_sided_sql("t", "free")}, 5) AS p FROM f"""


def agg_against_base(spark, sf_dir):
    """Entities outside the base against its distribution, by indicator."""
    cells = long_panel(entity_panel(spark, sf_dir).withColumn("sector", F.col("entity_id") % 10 != 0)).withColumnRenamed("sector", "inside")
    return rounded(A.against_base(settled(cells, "cells"), "inside"), 4)


AGG_AGAINST_BASE = f"""WITH {PANEL_SQL}, cells AS ({long_sql(INDICATORS)}), b AS (SELECT indicator, avg(value) AS m, stddev_samp(value) AS s FROM cells WHERE entity_id % 10 <> 0 GROUP BY indicator), z AS (SELECT indicator, m, s, value, (value - m) / CASE WHEN s > 1e-10 THEN s END AS z FROM cells JOIN b USING (indicator) WHERE entity_id % 10 = 0 AND value IS NOT NULL)
SELECT indicator, round(max(m), 4) AS base_mean, round(max(s), 4) AS base_std, round(avg(value), 4) AS other_mean, round(avg(abs(z)), 4) AS mean_abs_z, sum((abs(z) > 2.5)::INT)::BIGINT AS n_flagged, round(avg(value) - max(m), 4) AS mean_deviation FROM z GROUP BY indicator"""


def agg_verdicts(spark, sf_dir):
    """Roll-up of the sign checks and of a range check by sector."""
    ranges = entity_panel(spark, sf_dir).groupBy("sector").agg(F.avg("return_rate").alias("r")).select(F.lit("ranges").alias("check"), F.when(F.col("r").between(0.2, 0.335), "PASS").otherwise("FAIL").alias("verdict"))
    signs = _signs(spark, sf_dir).select(F.lit("signs").alias("check"), "verdict")
    return rounded(A.verdict_summary(settled(ranges.unionByName(signs), "verdicts"), ["PASS", "CONSISTENT", "WEAK_CONSISTENT"]))


AGG_VERDICTS = f"""{SIGNS_SQL}, v AS (SELECT 'ranges' AS "check", CASE WHEN avg(return_rate) BETWEEN 0.2 AND 0.335 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM panel GROUP BY sector UNION ALL SELECT 'signs', verdict FROM signs),
gv AS (SELECT "check", count(*) AS n, sum((verdict IN ('PASS', 'CONSISTENT', 'WEAK_CONSISTENT'))::INT)::BIGINT AS k FROM v WHERE verdict <> 'SKIP' GROUP BY 1), ev AS (SELECT *, 100.0 * k / n AS share, CASE WHEN 100.0 * k / n >= 70 THEN 'PASS' WHEN 100.0 * k / n >= 50 THEN 'WARN' ELSE 'FAIL' END AS verdict FROM gv)
SELECT "check", n, k AS n_good, round(share, 5) AS share, verdict FROM ev UNION ALL
SELECT 'overall', sum(n)::BIGINT, sum(k)::BIGINT, round(100.0 * sum(k) / sum(n), 5), CASE WHEN count(*) FILTER (verdict = 'FAIL') > 0 OR count(*) FILTER (verdict = 'WARN') >= 3 THEN 'FAIL' WHEN count(*) FILTER (verdict = 'WARN') > 0 THEN 'CONDITIONAL_PASS' ELSE 'PASS' END FROM ev"""


def agg_entity_card(spark, sf_dir):
    """Score and rank of every entity in every factor."""
    norms = settled(S.factor_norms(entity_panel(spark, sf_dir), "entity_id", FACTORS, "rank"), "norms")
    return rounded(A.entity_card(rank_columns(norms, "entity_id", FACTORS, descending=True), norms, "entity_id"), 4)


AGG_ENTITY_CARD = f"{RANKED_SQL} " + " UNION ALL ".join(f"SELECT entity_id, '{f}' AS factor, round({f}, 4) AS score, round({sql_rank(f'-{f}', pct=False)}, 4) AS rank FROM f" for f in FACTORS)


def agg_builder(spark, sf_dir):
    """Mean of each factor over chosen entities, against all, with their number by sector."""
    panel = settled(entity_panel(spark, sf_dir), "panel")
    chosen = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_orderpriority = '1-URGENT' and o_totalprice > 300000").select(F.col("o_custkey").alias("entity_id")).distinct()
    inside = panel.join(chosen, "entity_id", "left_semi")
    mean = lambda df, name: df.select(*XS).unpivot([], XS, "factor", "x").groupBy("factor").agg(F.avg("x").alias(name))
    out = mean(inside, "mean").join(mean(panel, "universe"), "factor").withColumn("delta", F.col("mean") - F.col("universe"))
    sectors = inside.groupBy("sector").agg(F.count(F.lit(1)).cast("double").alias("mean")).select(F.concat(F.lit("n in "), "sector").alias("factor"), "mean", F.lit(None).cast("double").alias("universe"), F.lit(None).cast("double").alias("delta"))
    return rounded(out.unionByName(sectors), 4)


AGG_BUILDER = f"""WITH {PANEL_SQL}, c AS (SELECT DISTINCT o_custkey AS entity_id FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 300000), i AS (SELECT panel.* FROM panel SEMI JOIN c USING (entity_id))
{" UNION ALL ".join(f"SELECT '{x}' AS factor, round((SELECT avg({x}) FROM i), 4) AS mean, round(avg({x}), 4) AS universe, round((SELECT avg({x}) FROM i) - avg({x}), 4) AS delta FROM panel" for x in XS)} UNION ALL SELECT 'n in ' || sector, count(*)::DOUBLE, NULL, NULL FROM i GROUP BY sector"""


def agg_risk_quintiles(spark, sf_dir):
    """Mean of risk measures by fifths of a score, and whether the best fifth has less risk than the worst."""
    panel = with_bin(settled(entity_panel(spark, sf_dir), "panel"), "mean_order", 5).where("bin is not null")
    rows = panel.select("bin", "return_rate", "mean_discount").unpivot("bin", ["return_rate", "mean_discount"], "metric", "x")
    s = rows.groupBy("metric").agg(*[F.avg(F.when(F.col("bin") == k, F.col("x"))).alias(f"q{k}") for k in range(1, 6)])
    return rounded(s.withColumn("spread", F.col("q5") - F.col("q1")).withColumn("benefit", F.col("spread") < 0), 6)


_FIFTHS = ", ".join(f"round(avg(x) FILTER (bin = {k}), 6) AS q{k}" for k in range(1, 6))
AGG_RISK = f"""WITH {PANEL_SQL}, b AS (SELECT *, {BIN_SQL.format(v="mean_order")} AS bin FROM panel WHERE mean_order IS NOT NULL), r AS (SELECT bin, 'return_rate' AS metric, return_rate AS x FROM b UNION ALL SELECT bin, 'mean_discount', mean_discount FROM b)
SELECT metric, {_FIFTHS}, round(avg(x) FILTER (bin = 5) - avg(x) FILTER (bin = 1), 6) AS spread, avg(x) FILTER (bin = 5) - avg(x) FILTER (bin = 1) < 0 AS benefit FROM r GROUP BY metric"""


def agg_clean_selection(spark, sf_dir):
    """Performance of the 20 best by a profile with and without the factor that holds the return."""
    norms = S.factor_norms(entity_panel(spark, sf_dir), "entity_id", FACTORS, "rank")
    scores = S.preference(norms, "entity_id", {"contaminated": PROFILES["growth"], "clean": S.without_factor(PROFILES["growth"], "momentum")}).select("entity_id", F.col("profile").alias("strategy"), F.round("score", 8).alias("score"))
    returns = entity_panel(spark, sf_dir).select("entity_id", F.col("momentum").alias("ret"))
    return rounded(P.performance(P.members(settled(scores, "scores"), TOP), returns).select("strategy", "n", "mean", "std", "cs_ir", "excess"))


AGG_CLEAN = f"""{RANKED_SQL}, s AS (SELECT entity_id, 'contaminated' AS strategy, ROUND(revenue * 0.2::DOUBLE + momentum * 0.6::DOUBLE + unit_price * 0.2::DOUBLE, 8) AS score FROM f UNION ALL SELECT entity_id, 'clean', ROUND(revenue * 0.5::DOUBLE + unit_price * 0.5::DOUBLE, 8) FROM f),
m AS (SELECT entity_id, strategy FROM s QUALIFY row_number() OVER (PARTITION BY strategy ORDER BY score DESC, entity_id) <= {TOP}) SELECT strategy, count(momentum) AS n, round(avg(momentum), 5) AS mean, round(stddev_samp(momentum), 5) AS std, round(avg(momentum) / stddev_samp(momentum), 5) AS cs_ir, round(avg(momentum) - (SELECT avg(momentum) FROM panel), 5) AS excess FROM m JOIN panel USING (entity_id) GROUP BY strategy"""


def join_keyed(spark, sf_dir):
    """Inner join of customers and outside ratings on a normalised key."""
    from panelforge.sources.ingest import normalised_key

    own = entity_panel(spark, sf_dir).select(normalised_key(F.concat(F.lit("c"), "entity_id")).alias("key"), "revenue")
    other = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(normalised_key(F.concat(F.lit(" C"), "s_suppkey", F.lit(".ns "))).alias("key"), F.col("s_acctbal").alias("rating"))
    return rounded(own.join(other, "key"), 4)


JOIN_KEYED = f"WITH {PANEL_SQL} SELECT 'C' || entity_id AS key, round(revenue, 4) AS revenue, round(s_acctbal, 4) AS rating FROM panel JOIN supplier ON s_suppkey = entity_id"


def join_prefer_right(spark, sf_dir):
    p = entity_panel(spark, sf_dir)
    right = p.where("entity_id % 2 = 0").select("entity_id", F.when(F.col("entity_id") % 3 != 0, F.col("revenue") * 2).alias("revenue"), "sector")
    return rounded(A.merged_preferring_right(p.select("entity_id", "revenue", "country"), right, "entity_id"), 3)


JOIN_PREFER_RIGHT = f"WITH {PANEL_SQL} SELECT entity_id, round(CASE WHEN entity_id % 3 <> 0 AND revenue IS NOT NULL THEN revenue * 2 ELSE revenue END, 3) AS revenue, country, sector FROM panel WHERE entity_id % 2 = 0"


def join_membership(spark, sf_dir):
    """Entities of a list and the others, counted by country."""
    p = settled(entity_panel(spark, sf_dir).select("entity_id", "country"), "panel")
    listed = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_totalprice > 400000").select(F.col("o_custkey").alias("entity_id"))
    count = lambda how: p.join(listed, "entity_id", how).groupBy("country").agg(F.count(F.lit(1)).alias(how))
    both = count("left_semi").withColumnRenamed("left_semi", "listed").join(count("left_anti").withColumnRenamed("left_anti", "others"), "country", "full_outer")
    return both.select("country", F.coalesce("listed", F.lit(0)).alias("listed"), F.coalesce("others", F.lit(0)).alias("others"))


JOIN_MEMBERSHIP = f"WITH {PANEL_SQL}, l AS (SELECT DISTINCT o_custkey AS entity_id FROM orders WHERE o_totalprice > 400000) SELECT country, count(l.entity_id) AS listed, count(*) - count(l.entity_id) AS others FROM panel LEFT JOIN l USING (entity_id) GROUP BY country"


def join_summary(spark, sf_dir):
    """Rank correlations and fits by factor and target, side by side."""
    rows = settled(I.pair_rows(entity_panel(spark, sf_dir), "entity_id", XS, YS), "pairs")
    ic = I.rank_correlation(rows, ["factor", "target"]).select("factor", "target", "rho")
    return rounded(ic.join(I.simple_regression(rows, ["factor", "target"]).select("factor", "target", "r2", "t"), ["factor", "target"], "left"))


JOIN_SUMMARY = f"{IC_SQL}, g AS (SELECT factor, target, regr_r2(y, x) AS r2, regr_slope(y, x) / sqrt((1 - regr_r2(y, x)) * regr_syy(y, x) / (count(*) - 2) / regr_sxx(y, x)) AS t FROM pairs GROUP BY ALL) SELECT factor, target, round(rho, 5) AS rho, round(r2, 5) AS r2, round(t, 5) AS t FROM z LEFT JOIN g USING (factor, target)"

QUERIES = {
    "corr_spearman": (corr_spearman, CORR_SPEARMAN), "corr_demeaned": (corr_demeaned, CORR_DEMEANED), "corr_decay": (corr_decay, CORR_DECAY), "corr_signs": (corr_signs, CORR_SIGNS), "corr_countries": (corr_countries, CORR_COUNTRIES),
    "corr_within_shift": (corr_within_shift, CORR_WITHIN_SHIFT), "corr_circularity": (corr_circularity, CORR_CIRCULARITY), "reg_robust": (reg_robust, REG_ROBUST), "reg_country": (reg_country, REG_COUNTRY),
    "test_welch_anova": (test_welch_anova, TEST_WELCH_ANOVA), "test_monotone": (test_monotone, TEST_MONOTONE), "test_validity": (test_validity, TEST_VALIDITY), "test_ordinal": (test_ordinal, TEST_ORDINAL),
    "agg_beta": (agg_beta, AGG_BETA), "agg_windows": (agg_windows, AGG_WINDOWS), "agg_top_vs_bottom": (agg_top_vs_bottom, AGG_TOP_VS_BOTTOM), "agg_against_base": (agg_against_base, AGG_AGAINST_BASE), "agg_verdicts": (agg_verdicts, AGG_VERDICTS),
    "agg_entity_card": (agg_entity_card, AGG_ENTITY_CARD), "agg_builder": (agg_builder, AGG_BUILDER), "agg_risk_quintiles": (agg_risk_quintiles, AGG_RISK), "agg_clean_selection": (agg_clean_selection, AGG_CLEAN),
    "join_keyed": (join_keyed, JOIN_KEYED), "join_prefer_right": (join_prefer_right, JOIN_PREFER_RIGHT), "join_membership": (join_membership, JOIN_MEMBERSHIP), "join_summary": (join_summary, JOIN_SUMMARY),
}
