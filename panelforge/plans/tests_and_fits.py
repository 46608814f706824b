"""Registered queries: correlation, regression and hypothesis tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelforge.functions.tables import settled
from panelforge.functions.tails import chi_square_tail_sql, f_tail_sql, t_two_sided, t_two_sided_sql
from panelforge.operators import inference as I
from panelforge.plans.clean import LONG_SQL, rounded
from panelforge.plans.portfolios import BIN_SQL
from panelforge.plans.score import sql_rank
from panelforge.sources.panels import PANEL_SQL, entity_panel, long_panel

XS = ["revenue", "mean_discount", "return_rate"]
YS = ["momentum", "unit_price"]
PAIRS_SQL = f"WITH {PANEL_SQL}, pairs AS ({' UNION ALL '.join(f'''SELECT entity_id, '{x}' AS factor, '{y}' AS target, {x} AS x, {y} AS y FROM panel WHERE {x} IS NOT NULL AND {y} IS NOT NULL''' for x in XS for y in YS)})"


def normal_cdf_sql(z: str) -> str:
    """The distribution function as in functions.expressions."""
    from panelforge.functions import expressions as E

    t = f"(1 / (1 + 0.5 * abs({z}) / 1.4142135623730951))"
    poly = "(" * (len(E._ERFC) - 1) + f"({E._ERFC[0]!r}::DOUBLE)" + "".join(f" * {t} + ({c!r}::DOUBLE))" for c in E._ERFC[1:])
    upper = f"(0.5 * {t} * exp(-({z}) * ({z}) / 2 + {poly}))"
    return f"(CASE WHEN {z} > 0 THEN 1 - {upper} ELSE {upper} END)"


def two_sided_sql(z: str) -> str:
    return f"2 * {normal_cdf_sql(f'(-abs({z}))')}"


def corr_matrix(spark, sf_dir):
    return rounded(I.pearson_matrix(entity_panel(spark, sf_dir), [*XS, *YS]))


_COLS = [*XS, *YS]
CORR_MATRIX = f"WITH {PANEL_SQL} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 5) AS r, count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) AS n FROM panel" for i, a in enumerate(_COLS) for b in _COLS[i + 1 :])


def corr_rank_ic(spark, sf_dir):
    rows = I.pair_rows(entity_panel(spark, sf_dir), "entity_id", XS, YS)
    return rounded(I.rank_correlation(rows, ["factor", "target"]))


IC_SQL = f"""{PAIRS_SQL}, r AS (SELECT factor, target, {sql_rank("x", "factor, target", False)} AS rx, {sql_rank("y", "factor, target", False)} AS ry FROM pairs), c AS (SELECT factor, target, corr(rx, ry) AS rho, count(*) AS n FROM r GROUP BY factor, target), z AS (SELECT *, atanh(rho) AS z, 1 / sqrt(n - 3) AS se FROM c)"""
CORR_RANK_IC = f"{IC_SQL} SELECT factor, target, round(rho, 5) AS rho, n, round({two_sided_sql('(z / se)')}, 5) AS p, round((exp(2 * (z - 1.959963984540054 * se)) - 1) / (exp(2 * (z - 1.959963984540054 * se)) + 1), 5) AS low, round((exp(2 * (z + 1.959963984540054 * se)) - 1) / (exp(2 * (z + 1.959963984540054 * se)) + 1), 5) AS high FROM z"


def corr_shrunk(spark, sf_dir):
    rows = I.pair_rows(settled(entity_panel(spark, sf_dir).select("entity_id", *XS, *YS), "panel"), "entity_id", XS, YS)
    return rounded(I.shrunken(settled(I.rank_correlation(rows, ["factor", "target"]), "correlations")).select("factor", "target", "shrunk", "intensity"))


CORR_SHRUNK = f"""{IC_SQL}, m AS (SELECT avg(rho) AS m, count(*) AS k, avg(1.0 / greatest(n - 3, 1)) AS v FROM z), q AS (SELECT sum((rho - m) ** 2) AS q FROM z, m),
s AS (SELECT *, CASE WHEN k <= 3 THEN 1 WHEN q <= 1e-12 THEN 0 ELSE least(1, greatest(0, 1 - (k - 3) * v / q)) END AS keep FROM m, q) SELECT factor, target, round(CASE WHEN k <= 3 THEN rho ELSE m + keep * (rho - m) END, 5) AS shrunk, round(1 - keep, 5) AS intensity FROM z, s"""


def corr_within_sector(spark, sf_dir):
    return rounded(I.within_group_correlation(entity_panel(spark, sf_dir), "revenue", "momentum", "sector"))


CORR_WITHIN = f"WITH {PANEL_SQL} SELECT sector, round(corr(revenue, momentum), 5) AS r, count(*) AS n FROM panel WHERE revenue IS NOT NULL AND momentum IS NOT NULL GROUP BY sector"


def corr_kendall(spark, sf_dir):
    return rounded(I.kendall(entity_panel(spark, sf_dir), "return_rate", "mean_order"))


CORR_KENDALL = f"""WITH {PANEL_SQL}, d AS (SELECT entity_id, return_rate AS x, mean_order AS y FROM panel WHERE return_rate IS NOT NULL AND mean_order IS NOT NULL),
s AS (SELECT sum(sign(a.x - b.x) * sign(a.y - b.y))::DOUBLE AS s FROM d a JOIN d b ON a.entity_id < b.entity_id),
x AS (SELECT sum(t) AS n, sum(t * (t - 1) / 2) AS tx, sum(t * (t - 1) * (t - 2)) AS ux, sum(t * (t - 1) * (2 * t + 5)) AS wx FROM (SELECT count(*)::DOUBLE AS t FROM d GROUP BY x)),
y AS (SELECT sum(t * (t - 1) / 2) AS ty, sum(t * (t - 1) * (t - 2)) AS uy, sum(t * (t - 1) * (2 * t + 5)) AS wy FROM (SELECT count(*)::DOUBLE AS t FROM d GROUP BY y)),
z AS (SELECT *, s / sqrt((n * (n - 1) * (2 * n + 5) - wx - wy) / 18 + 2 * tx * ty / (n * (n - 1)) + ux * uy / (9 * n * (n - 1) * (n - 2))) AS z FROM s, x, y)
SELECT round(s / sqrt((n * (n - 1) / 2 - tx) * (n * (n - 1) / 2 - ty)), 5) AS tau_b, round(z, 5) AS z, round({two_sided_sql("z")}, 5) AS p, n::BIGINT AS n FROM z"""


def corr_phi(spark, sf_dir):
    return rounded(I.phi(entity_panel(spark, sf_dir), F.col("momentum") > 0, F.col("acctbal") > 0))


CORR_PHI = f"""WITH {PANEL_SQL}, b AS (SELECT momentum > 0 AS a, acctbal > 0 AS b FROM panel WHERE momentum IS NOT NULL AND acctbal IS NOT NULL), c AS (SELECT count(*) FILTER (a AND b) AS n11, count(*) FILTER (a AND NOT b) AS n10, count(*) FILTER (NOT a AND b) AS n01, count(*) FILTER (NOT a AND NOT b) AS n00 FROM b),
d AS (SELECT *, (n11 * n00 - n10 * n01)::DOUBLE AS x, (n11 + n10)::DOUBLE * (n01 + n00) * (n11 + n01) * (n10 + n00) AS m, (n11 + n10 + n01 + n00)::DOUBLE AS n FROM c)
SELECT n11, n10, n01, n00, round(x / sqrt(m), 5) AS phi, round(n * greatest(abs(x) - n / 2, 0) ** 2 / m, 5) AS chi2, round({chi_square_tail_sql("(n * greatest(abs(x) - n / 2, 0) ** 2 / m)", "1")}, 5) AS p FROM d"""


def reg_simple(spark, sf_dir):
    return rounded(I.simple_regression(I.pair_rows(entity_panel(spark, sf_dir), "entity_id", XS, YS), ["factor", "target"]), 6)


REG_SIMPLE = f"""{PAIRS_SQL}, s AS (SELECT factor, target, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, regr_r2(y, x) AS r2, count(*) AS n, sqrt((1 - regr_r2(y, x)) * regr_syy(y, x) / (count(*) - 2) / regr_sxx(y, x)) AS se FROM pairs GROUP BY factor, target)
SELECT factor, target, round(slope, 6) AS slope, round(intercept, 6) AS intercept, round(r2, 6) AS r2, n, round(se, 6) AS se, round(slope / se, 6) AS t, round({t_two_sided_sql("slope / se", "n - 2")}, 6) AS p FROM s"""


def reg_multiple(spark, sf_dir):
    return rounded(I.multiple_regression(entity_panel(spark, sf_dir), ["revenue", "return_rate"], "momentum"))


REG_MULTIPLE = f"""WITH {PANEL_SQL}, w AS (SELECT (revenue - avg(revenue) OVER ()) / stddev_samp(revenue) OVER () AS a, (return_rate - avg(return_rate) OVER ()) / stddev_samp(return_rate) OVER () AS b, momentum AS y FROM panel WHERE revenue IS NOT NULL AND return_rate IS NOT NULL AND momentum IS NOT NULL),
s AS (SELECT count(*) AS n, avg(y) AS my, sum(a * a) AS aa, sum(b * b) AS bb, sum(a * b) AS ab, sum(a * (y)) AS ay, sum(b * (y)) AS by_, regr_syy(y, a) AS yy FROM w),
c AS (SELECT *, aa * bb - ab * ab AS det, (bb * ay - ab * by_) / (aa * bb - ab * ab) AS ba, (aa * by_ - ab * ay) / (aa * bb - ab * ab) AS b2 FROM s),
e AS (SELECT *, yy - ba * ay - b2 * by_ AS rss FROM c), f AS (SELECT *, rss / (n - 3) AS v, 1 - rss / yy AS r2 FROM e),
t AS (SELECT 'intercept' AS term, my AS coefficient, sqrt(v / n) AS se, r2, n FROM f UNION ALL SELECT 'revenue', ba, sqrt(v * bb / det), r2, n FROM f UNION ALL SELECT 'return_rate', b2, sqrt(v * aa / det), r2, n FROM f)
SELECT term, round(coefficient, 5) AS coefficient, round(se, 5) AS se, round(coefficient / se, 5) AS t, round({t_two_sided_sql("coefficient / se", "n - 3")}, 5) AS p, round(r2, 5) AS r2, round(1 - (1 - r2) * (n - 1) / (n - 3), 5) AS adjusted_r2, round((r2 / 2) / ((1 - r2) / (n - 3)), 5) AS f, round({f_tail_sql("(r2 / 2) / ((1 - r2) / (n - 3))", "2", "n - 3")}, 5) AS f_p, n FROM t"""


def reg_incremental(spark, sf_dir):
    return rounded(I.incremental_r2(entity_panel(spark, sf_dir), "return_rate", "momentum", "sector"), 6)


REG_INCREMENTAL = f"""WITH {PANEL_SQL}, w AS (SELECT sector, return_rate AS x, momentum AS y FROM panel WHERE return_rate IS NOT NULL AND momentum IS NOT NULL), g AS (SELECT sector, regr_sxx(y, x) AS sxx, regr_sxy(y, x) AS sxy, regr_syy(y, x) AS syy FROM w GROUP BY sector),
s AS (SELECT sum(sxx) AS sxx, sum(sxy) AS sxy, sum(syy) AS within, count(*) AS k, (SELECT regr_syy(y, x) FROM w) AS total, (SELECT count(*) FROM w) AS n FROM g), r AS (SELECT *, 1 - within / total AS rg, sxy * sxy / sxx / total AS gain FROM s)
SELECT round(rg, 6) AS r2_group, round(rg + gain, 6) AS r2_full, round(gain, 6) AS gain, round(gain / ((1 - rg - gain) / (n - k - 1)), 6) AS f, round({f_tail_sql("gain / ((1 - rg - gain) / (n - k - 1))", "1", "n - k - 1")}, 6) AS p, n FROM r"""


def reg_inflation(spark, sf_dir):
    return rounded(I.inflation(entity_panel(spark, sf_dir), ["revenue", "n_orders"]))


REG_INFLATION = f"WITH {PANEL_SQL}, r AS (SELECT corr(revenue, n_orders) AS r FROM panel WHERE revenue IS NOT NULL AND n_orders IS NOT NULL) SELECT unnest(['revenue', 'n_orders']) AS factor, round(1 / (1 - r * r), 5) AS vif, round(sqrt((1 + abs(r)) / (1 - abs(r))), 5) AS condition FROM r"


def test_anova(spark, sf_dir):
    return rounded(I.anova(entity_panel(spark, sf_dir), "momentum", "sector"))


TEST_ANOVA = f"""WITH {PANEL_SQL}, g AS (SELECT count(momentum) AS n, avg(momentum) AS m, var_pop(momentum) AS v FROM panel WHERE momentum IS NOT NULL GROUP BY sector), s AS (SELECT sum(n)::BIGINT AS n, count(*) - 1 AS df1, sum(n)::BIGINT - count(*) AS df2, sum(n * m * m) - sum(n) * (sum(n * m) / sum(n)) ** 2 AS b, sum(n * v) AS w FROM g)
SELECT n, df1, df2, round((b / df1) / (w / df2), 5) AS f, round({f_tail_sql("(b / df1) / (w / df2)", "df1", "df2")}, 5) AS p, round(b / (b + w), 5) AS eta_squared, CASE WHEN b / (b + w) < 0.01 THEN 'negligible' WHEN b / (b + w) < 0.06 THEN 'small' WHEN b / (b + w) < 0.14 THEN 'medium' ELSE 'large' END AS size FROM s"""


_Z = 1.959963984540054
_T_TERMS = ((_Z**3 + _Z) / 4, (5 * _Z**5 + 16 * _Z**3 + 3 * _Z) / 96, (3 * _Z**7 + 19 * _Z**5 + 17 * _Z**3 - 15 * _Z) / 384, (79 * _Z**9 + 776 * _Z**7 + 1482 * _Z**5 - 1920 * _Z**3 - 945 * _Z) / 92160)


def test_two_groups(spark, sf_dir):
    return rounded(I.two_groups(entity_panel(spark, sf_dir), "momentum", F.col("country") == "ASIA"))


TEST_TWO_GROUPS = f"""WITH {PANEL_SQL}, s AS (SELECT count(momentum) FILTER (c) AS n1, count(momentum) FILTER (NOT c) AS n2, avg(momentum) FILTER (c) AS m1, avg(momentum) FILTER (NOT c) AS m2, var_samp(momentum) FILTER (c) AS v1, var_samp(momentum) FILTER (NOT c) AS v2 FROM (SELECT *, country = 'ASIA' AS c FROM panel)),
q AS (SELECT *, ((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) AS p FROM s),
w AS (SELECT *, (m1 - m2) / sqrt(p * (1.0 / n1 + 1.0 / n2)) AS t, (m1 - m2) / sqrt(v1 / n1 + v2 / n2) AS wt, (v1 / n1 + v2 / n2) ** 2 / ((v1 / n1) ** 2 / (n1 - 1) + (v2 / n2) ** 2 / (n2 - 1)) AS wd FROM q),
r AS (SELECT *, (1.959963984540054 + {" + ".join(f"{c!r} / wd ** {k + 1}" for k, c in enumerate(_T_TERMS))}) * sqrt(v1 / n1 + v2 / n2) AS reach FROM w)
SELECT n1, n2, round(m1, 5) AS mean1, round(m2, 5) AS mean2, round(t, 5) AS t, round({t_two_sided_sql("t", "n1 + n2 - 2")}, 5) AS p, round(wt, 5) AS welch_t, round(wd, 5) AS welch_df, round({t_two_sided_sql("wt", "wd")}, 5) AS welch_p, round(m1 - m2 - reach, 5) AS low, round(m1 - m2 + reach, 5) AS high, round((m1 - m2) / sqrt(p), 5) AS d FROM r"""


def test_mann_whitney(spark, sf_dir):
    return rounded(I.mann_whitney(entity_panel(spark, sf_dir), "n_orders", "country", "ASIA", "EUROPE"))


TEST_MW = f"""WITH {PANEL_SQL}, r AS (SELECT country, {sql_rank("n_orders", pct=False)} AS r FROM panel WHERE country IN ('ASIA', 'EUROPE')), t AS (SELECT sum(c * c * c - c)::DOUBLE AS t FROM (SELECT count(*) AS c FROM panel WHERE country IN ('ASIA', 'EUROPE') GROUP BY n_orders)),
s AS (SELECT count(*) FILTER (country = 'ASIA') AS n1, count(*) FILTER (country = 'EUROPE') AS n2, count(*)::DOUBLE AS n, sum(r) FILTER (country = 'ASIA') AS r1 FROM r), u AS (SELECT *, r1 - n1 * (n1 + 1) / 2 AS u FROM s, t), z AS (SELECT *, (u - n1 * n2 / 2) / sqrt(n1 * n2 / 12 * ((n + 1) - t / (n * (n - 1)))) AS z FROM u)
SELECT round(u, 5) AS u, round(z, 5) AS z, round({two_sided_sql("z")}, 5) AS p, round(2 * u / (n1 * n2) - 1, 5) AS rank_biserial, round(2 * u / (n1 * n2) - 1, 5) AS cliffs_delta, n1, n2 FROM z"""


def test_kruskal(spark, sf_dir):
    return rounded(I.kruskal(entity_panel(spark, sf_dir), "n_orders", "sector"))


TEST_KRUSKAL = f"""WITH {PANEL_SQL}, r AS (SELECT sector, {sql_rank("n_orders", pct=False)} AS r FROM panel), t AS (SELECT sum(c * c * c - c)::DOUBLE AS t FROM (SELECT count(*) AS c FROM panel GROUP BY n_orders)), g AS (SELECT sum(r) * sum(r) / count(*) AS q, count(*) AS n FROM r GROUP BY sector), s AS (SELECT sum(q) AS q, sum(n)::DOUBLE AS n, count(*) AS kinds FROM g),
h AS (SELECT *, (12 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - t / (n * n * n - n)) AS h FROM s, t)
SELECT round(h, 5) AS h, round({chi_square_tail_sql("h", "kinds - 1")}, 5) AS p, kinds AS "groups", n::BIGINT AS n FROM h"""


def test_friedman(spark, sf_dir):
    p = entity_panel(spark, sf_dir).select(F.round("return_rate", 1).alias("a"), F.round("urgent_share", 1).alias("b"), F.round(F.col("mean_discount") * 5, 1).alias("c"))
    return rounded(I.friedman(p, ["a", "b", "c"]))


TEST_FRIEDMAN = f"""WITH {PANEL_SQL}, w AS (SELECT ROUND(return_rate, 1) AS a, ROUND(urgent_share, 1) AS b, ROUND(mean_discount * 5, 1) AS c FROM panel WHERE return_rate IS NOT NULL AND urgent_share IS NOT NULL AND mean_discount IS NOT NULL),
r AS (SELECT 1 + (b < a)::INT + (c < a)::INT + 0.5::DOUBLE * ((b = a)::INT + (c = a)::INT) AS ra, 1 + (a < b)::INT + (c < b)::INT + 0.5::DOUBLE * ((a = b)::INT + (c = b)::INT) AS rb, 1 + (a < c)::INT + (b < c)::INT + 0.5::DOUBLE * ((a = c)::INT + (b = c)::INT) AS rc,
  CASE WHEN a = b AND b = c THEN 24 WHEN a = b OR b = c OR a = c THEN 6 ELSE 0 END AS t FROM w), s AS (SELECT count(*) AS n, sum(ra) AS x, sum(rb) AS y, sum(rc) AS z, sum(t) AS t FROM r), q AS (SELECT *, (12 * (x * x + y * y + z * z) - 3.0 * n * n * 3 * 16) / (n * 3 * 4 - t / 2.0) AS chi2 FROM s)
SELECT round(chi2, 5) AS chi2, round({chi_square_tail_sql("chi2", "2")}, 5) AS p, round(least(1, greatest(0, chi2 / (n * 2))), 5) AS kendalls_w, n FROM q"""


def test_wilcoxon(spark, sf_dir):
    p = entity_panel(spark, sf_dir).select(F.round("return_rate", 2).alias("a"), F.round("urgent_share", 2).alias("b"))
    return rounded(I.wilcoxon(p.withColumn("a", F.round(F.col("a") * 100)).withColumn("b", F.round(F.col("b") * 100)), "a", "b"))


TEST_WILCOXON = f"""WITH {PANEL_SQL}, d AS (SELECT ROUND(ROUND(return_rate, 2) * 100) - ROUND(ROUND(urgent_share, 2) * 100) AS d FROM panel), r AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0 AS r FROM d WHERE d <> 0), t AS (SELECT sum(c * c * c - c)::DOUBLE AS t FROM (SELECT count(*) AS c FROM d WHERE d <> 0 GROUP BY abs(d))),
s AS (SELECT count(*)::DOUBLE AS n, coalesce(sum(r) FILTER (d > 0), 0) AS u, coalesce(sum(r) FILTER (d < 0), 0) AS v FROM r), z AS (SELECT *, (u - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - t / 48) AS z FROM s, t)
SELECT round(least(u, v), 5) AS w, round(z, 5) AS z, round({two_sided_sql("z")}, 5) AS p, round(z / sqrt(n), 5) AS effect, n::BIGINT AS n FROM z"""


def test_chi_square(spark, sf_dir):
    return rounded(I.chi_square(entity_panel(spark, sf_dir), "sector", "country"))


TEST_CHI = f"""WITH {PANEL_SQL}, o AS (SELECT sector, country, count(*) AS o FROM panel GROUP BY ALL), r AS (SELECT sector, sum(o)::DOUBLE AS r FROM o GROUP BY sector), c AS (SELECT country, sum(o)::DOUBLE AS c FROM o GROUP BY country), n AS (SELECT sum(o)::DOUBLE AS n FROM o),
x AS (SELECT sum((coalesce(o, 0) - r * c / n) ** 2 / (r * c / n)) AS chi2, max(n) AS n, count(DISTINCT sector) AS a, count(DISTINCT country) AS b FROM r CROSS JOIN c CROSS JOIN n LEFT JOIN o USING (sector, country)) SELECT round(chi2, 5) AS chi2, (a - 1) * (b - 1) AS dof, round({chi_square_tail_sql("chi2", "(a - 1) * (b - 1)")}, 5) AS p, n::BIGINT AS n, round(sqrt(chi2 / n / (least(a, b) - 1)), 5) AS cramers_v FROM x"""


def test_ks(spark, sf_dir):
    return rounded(I.two_sample_ks(entity_panel(spark, sf_dir), "n_orders", F.col("country") == "ASIA"))


TEST_KS = f"""WITH {PANEL_SQL}, c AS (SELECT n_orders AS x, count(*) FILTER (country = 'ASIA') AS a, count(*) FILTER (country <> 'ASIA') AS b FROM panel GROUP BY 1), r AS (SELECT sum(a) OVER (ORDER BY x) / sum(a) OVER () - sum(b) OVER (ORDER BY x) / sum(b) OVER () AS d, sum(a) OVER () AS n1, sum(b) OVER () AS n2 FROM c),
k AS (SELECT max(abs(d)) AS d, max(n1) AS n1, max(n2) AS n2, max(abs(d)) * sqrt(max(n1) * max(n2) / (max(n1) + max(n2))) AS x FROM r)
SELECT round(d, 5) AS d, n1::BIGINT AS n1, n2::BIGINT AS n2, round(CASE WHEN x < 0.2 THEN 1 ELSE least(1, greatest(0, list_sum(list_transform(range(1, 21), lambda i: 2 * (-1.0) ** (i - 1) * exp(-2.0 * i * i * x * x))))) END, 5) AS p FROM k"""


def test_normality(spark, sf_dir):
    return rounded(I.normality(long_panel(entity_panel(spark, sf_dir))), 4)


TEST_NORMALITY = f"""{LONG_SQL}, s AS (SELECT indicator, count(value) AS n, skewness(value) AS g, kurtosis(value) AS k FROM cells GROUP BY indicator), p AS (SELECT *, g * (n - 2) / sqrt(n * (n - 1.0)) AS g1, ((k * (n - 2.0) * (n - 3.0) / (n - 1.0)) - 6) / (n + 1.0) AS g2 FROM s)
SELECT indicator, n, round(n / 6.0 * (g1 * g1 + g2 * g2 / 4), 4) AS jarque_bera, round(exp(-n / 12.0 * (g1 * g1 + g2 * g2 / 4)), 4) AS p, round(g, 4) AS skew, round(k, 4) AS kurtosis FROM p"""


def test_ks_normal(spark, sf_dir):
    return rounded(I.ks_normal(entity_panel(spark, sf_dir), "revenue"), 6)


TEST_KS_NORMAL = f"""WITH {PANEL_SQL}, c AS (SELECT revenue AS x, count(*) AS n FROM panel WHERE revenue IS NOT NULL GROUP BY revenue), r AS (SELECT x, sum(n) OVER (ORDER BY x) AS u, n, sum(n) OVER () AS t FROM c), f AS (SELECT *, (x - (SELECT avg(revenue) FROM panel)) / (SELECT stddev_samp(revenue) FROM panel) AS z FROM r), g AS (SELECT *, {normal_cdf_sql("z")} AS f FROM f)
SELECT round(max(greatest(u / t - f, f - (u - n) / t)), 6) AS d, max(t)::BIGINT AS n FROM g"""


def test_trend(spark, sf_dir):
    return rounded(I.trend_of_bins(entity_panel(spark, sf_dir), "revenue", "momentum"))


TEST_TREND = f"""WITH {PANEL_SQL}, b AS (SELECT {BIN_SQL.format(v="revenue")} AS bin, momentum FROM panel WHERE revenue IS NOT NULL), m AS (SELECT bin, avg(momentum) AS m FROM b GROUP BY bin), s AS (SELECT sum(sign(y.m - x.m))::DOUBLE AS s FROM m x JOIN m y ON x.bin < y.bin), z AS (SELECT s, (s - sign(s)) / sqrt(5 * 4 * 15 / 18.0) AS z FROM s)
SELECT s, round(z, 5) AS z, round({two_sided_sql("z")}, 5) AS p FROM z"""


def test_jonckheere(spark, sf_dir):
    p = entity_panel(spark, sf_dir).withColumn("grade", F.least(F.floor(F.col("n_orders") / 6), F.lit(3)))
    return rounded(I.jonckheere(p, "return_rate", "grade"))


TEST_JT = f"""WITH {PANEL_SQL}, d AS (SELECT least(floor(n_orders / 6), 3) AS g, return_rate AS v FROM panel WHERE return_rate IS NOT NULL), j AS (SELECT sum(CASE WHEN b.v > a.v THEN 1.0 WHEN b.v = a.v THEN 0.5 ELSE 0 END)::DOUBLE AS j FROM d a JOIN d b ON a.g < b.g),
n AS (SELECT sum(n) AS N, sum(n * n) AS q, sum(n * n * (2 * n + 3)) AS c FROM (SELECT count(*)::DOUBLE AS n FROM d GROUP BY g)), z AS (SELECT j, (j - (N * N - q) / 4) / sqrt((N * N * (2 * N + 3) - c) / 72) AS z FROM j, n) SELECT round(j, 5) AS j, round(z, 5) AS z, round({two_sided_sql("z")}, 5) AS p FROM z"""


def test_adjusted_p(spark, sf_dir):
    rows = I.pair_rows(entity_panel(spark, sf_dir), "entity_id", XS, YS)
    ps = I.rank_correlation(rows, ["factor", "target"]).select("factor", "target", F.round("p", 7).alias("p"))
    return rounded(I.adjusted_p(ps), 6)


TEST_ADJUSTED = f"""{IC_SQL}, p AS (SELECT factor, target, ROUND({two_sided_sql("(z / se)")}, 7) AS p FROM z), q AS (SELECT *, p * count(*) OVER () / row_number() OVER (ORDER BY p) AS q, count(*) OVER () AS m FROM p)
SELECT factor, target, round(p, 6) AS p, round(least(1, p * m), 6) AS bonferroni, round(least(1, min(q) OVER (ORDER BY p DESC)), 6) AS bh FROM q"""


def test_paired(spark, sf_dir):
    d = entity_panel(spark, sf_dir).select((F.col("return_rate") - F.col("urgent_share")).alias("d"))
    s = d.agg(F.count("d").alias("n"), F.avg("d").alias("mean"), F.stddev_samp("d").alias("_s"))
    t = F.col("mean") / (F.col("_s") / F.sqrt("n"))
    return rounded(s.select("n", "mean", t.alias("t"), t_two_sided(t, F.col("n") - 1).alias("p"), (F.col("mean") / F.col("_s")).alias("d")))


TEST_PAIRED = f"""WITH {PANEL_SQL}, s AS (SELECT count(d) AS n, avg(d) AS m, stddev_samp(d) AS s FROM (SELECT return_rate - urgent_share AS d FROM panel)) SELECT n, round(m, 5) AS mean, round(m / (s / sqrt(n)), 5) AS t, round({t_two_sided_sql("m / (s / sqrt(n))", "n - 1")}, 5) AS p, round(m / s, 5) AS d FROM s"""

QUERIES = {
    "corr_matrix": (corr_matrix, CORR_MATRIX), "corr_rank_ic": (corr_rank_ic, CORR_RANK_IC), "corr_shrunk": (corr_shrunk, CORR_SHRUNK), "corr_within_sector": (corr_within_sector, CORR_WITHIN), "corr_kendall": (corr_kendall, CORR_KENDALL), "corr_phi": (corr_phi, CORR_PHI),
    "reg_simple": (reg_simple, REG_SIMPLE), "reg_multiple": (reg_multiple, REG_MULTIPLE), "reg_incremental": (reg_incremental, REG_INCREMENTAL), "reg_inflation": (reg_inflation, REG_INFLATION),
    "test_anova": (test_anova, TEST_ANOVA), "test_two_groups": (test_two_groups, TEST_TWO_GROUPS), "test_mann_whitney": (test_mann_whitney, TEST_MW), "test_kruskal": (test_kruskal, TEST_KRUSKAL), "test_friedman": (test_friedman, TEST_FRIEDMAN),
    "test_wilcoxon": (test_wilcoxon, TEST_WILCOXON), "test_chi_square": (test_chi_square, TEST_CHI), "test_ks": (test_ks, TEST_KS), "test_normality": (test_normality, TEST_NORMALITY), "test_ks_normal": (test_ks_normal, TEST_KS_NORMAL),
    "test_trend": (test_trend, TEST_TREND), "test_jonckheere": (test_jonckheere, TEST_JT), "test_adjusted_p": (test_adjusted_p, TEST_ADJUSTED), "test_paired": (test_paired, TEST_PAIRED),
}
