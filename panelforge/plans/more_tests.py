"""Registered queries: power, effect sizes, heteroscedasticity, design-adjusted ratios, group benchmarks."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelforge.functions.expressions import normal_cdf
from panelforge.functions.tails import chi_square_tail, chi_square_tail_sql, f_tail, f_tail_sql, t_two_sided, t_two_sided_sql
from panelforge.functions.tables import settled
from panelforge.operators import inference as I
from panelforge.plans.clean import rounded
from panelforge.plans.tests_and_fits import IC_SQL, XS, YS, normal_cdf_sql
from panelforge.sources.panels import PANEL_SQL, entity_panel

Z975 = 1.959963984540054


def pwr_ic(spark, sf_dir):
    """Power of each rank correlation, the smallest one found with 80 pct power, and the rows needed for it (normal approximation on Fisher's z)."""
    ic = I.rank_correlation(I.pair_rows(entity_panel(spark, sf_dir), "entity_id", XS, YS), ["factor", "target"])
    root = F.sqrt(F.col("n") - 3)
    z = F.abs(F.atanh("rho"))
    return rounded(ic.select("factor", "target", "n", normal_cdf(z * root - Z975).alias("power"), F.tanh((Z975 + 0.8416212335729143) / root).alias("least_rho"), (F.pow((Z975 + 0.8416212335729143) / z, F.lit(2.0)) + 3).alias("n_needed")), 4)


PWR_IC = f"{IC_SQL} SELECT factor, target, n, round({normal_cdf_sql(f'(abs(z) * sqrt(n - 3) - {Z975})')}, 4) AS power, round((exp(2 * {Z975 + 0.8416212335729143} / sqrt(n - 3)) - 1) / (exp(2 * {Z975 + 0.8416212335729143} / sqrt(n - 3)) + 1), 4) AS least_rho, round(({Z975 + 0.8416212335729143} / abs(z)) ** 2 + 3, 4) AS n_needed FROM z"


def test_effects_by_country(spark, sf_dir):
    """Cohen's d of each factor, one country against the rest."""
    p = entity_panel(spark, sf_dir)
    rows = p.select("country", *XS).unpivot("country", XS, "factor", "x")
    # The rest of the world is the total less the country's own sums; values are taken from their mean, so that squares lose nothing.
    rows = settled(rows, "factors")
    means = rows.groupBy("factor").agg(F.avg("x").alias("_m"))
    x = F.col("x") - F.col("_m")
    own = settled(rows.join(means, "factor").groupBy("factor", F.col("country").alias("place")).agg(F.count("x").alias("n1"), F.sum(x).alias("_s1"), F.sum(x * x).alias("_q1")), "sums")
    whole = own.groupBy("factor").agg(F.sum("n1").alias("_n"), F.sum("_s1").alias("_s"), F.sum("_q1").alias("_q"))
    n1, n2 = F.col("n1"), F.col("_n") - F.col("n1")
    s2, q2 = F.col("_s") - F.col("_s1"), F.col("_q") - F.col("_q1")
    var = lambda n, s, q: F.when(n > 1, (q - s * s / n) / (n - 1))
    gap = F.when((n1 > 0) & (n2 > 0), F.col("_s1") / n1 - s2 / n2)
    s = own.join(whole, "factor").select("factor", "place", "n1", n2.alias("n2"), gap.alias("_g"), var(n1, F.col("_s1"), F.col("_q1")).alias("_v1"), var(n2, s2, q2).alias("_v2"))
    pooled = ((F.col("n1") - 1) * F.col("_v1") + (F.col("n2") - 1) * F.col("_v2")) / (F.col("n1") + F.col("n2") - 2)
    return rounded(s.select("factor", "place", "n1", "n2", (F.col("_g") / F.sqrt(pooled)).alias("d")))


TEST_EFFECTS = f"""WITH {PANEL_SQL}, r AS ({" UNION ALL ".join(f"SELECT country, '{x}' AS factor, {x} AS x FROM panel" for x in XS)}), s AS (SELECT factor, place, count(x) FILTER (country = place) AS n1, count(x) FILTER (country <> place) AS n2, avg(x) FILTER (country = place) - avg(x) FILTER (country <> place) AS g,
  var_samp(x) FILTER (country = place) AS v1, var_samp(x) FILTER (country <> place) AS v2 FROM r, (SELECT DISTINCT country AS place FROM panel) GROUP BY ALL) SELECT factor, place, n1, n2, round(g / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)), 5) AS d FROM s"""


def reg_breusch_pagan(spark, sf_dir):
    """Lagrange statistic of squared residuals regressed on the regressor, by factor, and the F test of that fit, with p-values."""
    rows = I.pair_rows(entity_panel(spark, sf_dir), "entity_id", XS, ["momentum"])
    fit = I.simple_regression(rows, ["factor"]).select("factor", "slope", "intercept")
    e = F.col("y") - F.col("intercept") - F.col("slope") * F.col("x")
    squared = rows.join(F.broadcast(fit), "factor").select("factor", "x", (e * e).alias("y"))
    fit = I.simple_regression(squared, ["factor"]).withColumn("lm", F.col("n") * F.col("r2"))
    f = F.col("r2") / ((1 - F.col("r2")) / (F.col("n") - 2))
    return rounded(fit.select("factor", "n", "lm", chi_square_tail(F.col("lm"), F.lit(1)).alias("lm_p"), f.alias("f"), f_tail(f, F.lit(1), F.col("n") - 2).alias("f_p")))


REG_BP = f"""WITH {PANEL_SQL}, w AS ({" UNION ALL ".join(f"SELECT '{x}' AS factor, {x} AS x, momentum AS y FROM panel WHERE {x} IS NOT NULL AND momentum IS NOT NULL" for x in XS)}), f AS (SELECT factor, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM w GROUP BY factor),
e AS (SELECT factor, x, (y - a - b * x) ** 2 AS e FROM w JOIN f USING (factor)), s AS (SELECT factor, count(*) AS n, regr_r2(e, x) AS r2 FROM e GROUP BY factor), t AS (SELECT *, n * r2 AS lm, r2 / ((1 - r2) / (n - 2)) AS f FROM s)
SELECT factor, n, round(lm, 5) AS lm, round({chi_square_tail_sql("lm", "1")}, 5) AS lm_p, round(f, 5) AS f, round({f_tail_sql("f", "1", "n - 2")}, 5) AS f_p FROM t"""


def agg_design_effect(spark, sf_dir):
    """Mean over deviation of sector means, adjusted by the root of effective over all rows."""
    g = entity_panel(spark, sf_dir).where("momentum is not null").groupBy("sector").agg(F.count(F.lit(1)).alias("n"), F.avg("momentum").alias("m"))
    s = g.agg((F.sum("n") * F.sum("n") / F.sum(F.col("n") * F.col("n"))).alias("n_effective"), (F.avg("m") / F.stddev_samp("m")).alias("ir"), F.sum("n").alias("_rows"))
    return rounded(s.select("n_effective", "ir", (F.col("ir") * F.sqrt(F.col("n_effective") / F.col("_rows"))).alias("adjusted_ir")))


AGG_DESIGN = f"WITH {PANEL_SQL}, g AS (SELECT count(*)::DOUBLE AS n, avg(momentum) AS m FROM panel WHERE momentum IS NOT NULL GROUP BY sector), s AS (SELECT sum(n) * sum(n) / sum(n * n) AS e, avg(m) / stddev_samp(m) AS ir, sum(n) AS k FROM g) SELECT round(e, 5) AS n_effective, round(ir, 5) AS ir, round(ir * sqrt(e / k), 5) AS adjusted_ir FROM s"


def agg_group_benchmark(spark, sf_dir):
    """Customers' and suppliers' mean balances by nation, outer-joined, with the difference and whether it is within one deviation."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").groupBy(F.col("c_nationkey").alias("nation")).agg(F.avg("c_acctbal").alias("own"))
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").groupBy(F.col("s_nationkey").alias("nation")).agg(F.avg("s_acctbal").alias("other"), F.stddev_samp("s_acctbal").alias("_sd"))
    return rounded(c.join(s, "nation", "full_outer").select("nation", "own", "other", (F.col("own") - F.col("other")).alias("difference"), (F.abs(F.col("own") - F.col("other")) <= F.col("_sd")).alias("within")), 4)


AGG_BENCHMARK = """WITH c AS (SELECT c_nationkey AS nation, avg(c_acctbal) AS own FROM customer GROUP BY 1), s AS (SELECT s_nationkey AS nation, avg(s_acctbal) AS other, stddev_samp(s_acctbal) AS sd FROM supplier GROUP BY 1)
SELECT nation, round(own, 4) AS own, round(other, 4) AS other, round(own - other, 4) AS difference, abs(own - other) <= sd AS within FROM c FULL JOIN s USING (nation)""".replace(" AS within", ' AS "within"')


def test_welch_by_sector(spark, sf_dir):
    """Welch's t between two countries in each sector, small samples marked."""
    p = entity_panel(spark, sf_dir)
    v = lambda c: F.when(F.col("country") == c, F.col("momentum"))
    a, b = v("ASIA"), v("EUROPE")
    s = p.groupBy("sector").agg(F.count(a).alias("n1"), F.count(b).alias("n2"), (F.avg(a) - F.avg(b)).alias("gap"), (F.var_samp(a) / F.count(a)).alias("_a"), (F.var_samp(b) / F.count(b)).alias("_b"))
    e1, e2 = F.col("_a"), F.col("_b")
    t, df = F.col("gap") / F.sqrt(e1 + e2), (e1 + e2) * (e1 + e2) / (e1 * e1 / (F.col("n1") - 1) + e2 * e2 / (F.col("n2") - 1))
    return rounded(s.select("sector", "n1", "n2", "gap", t.alias("t"), t_two_sided(t, df).alias("p"), (F.least("n1", "n2") < 30).alias("small")))


TEST_WELCH = f"""WITH {PANEL_SQL}, s AS (SELECT sector, count(momentum) FILTER (country = 'ASIA') AS n1, count(momentum) FILTER (country = 'EUROPE') AS n2, avg(momentum) FILTER (country = 'ASIA') - avg(momentum) FILTER (country = 'EUROPE') AS gap, var_samp(momentum) FILTER (country = 'ASIA') AS v1, var_samp(momentum) FILTER (country = 'EUROPE') AS v2 FROM panel GROUP BY sector), w AS (SELECT *, gap / sqrt(v1 / n1 + v2 / n2) AS t, (v1 / n1 + v2 / n2) ** 2 / ((v1 / n1) ** 2 / (n1 - 1) + (v2 / n2) ** 2 / (n2 - 1)) AS df FROM s)
SELECT sector, n1, n2, round(gap, 5) AS gap, round(t, 5) AS t, round({t_two_sided_sql("t", "df")}, 5) AS p, least(n1, n2) < 30 AS small FROM w"""

QUERIES = {
    "pwr_ic": (pwr_ic, PWR_IC),
    "test_effects_by_country": (test_effects_by_country, TEST_EFFECTS),
    "reg_breusch_pagan": (reg_breusch_pagan, REG_BP),
    "agg_design_effect": (agg_design_effect, AGG_DESIGN),
    "agg_group_benchmark": (agg_group_benchmark, AGG_BENCHMARK),
    "test_welch_by_sector": (test_welch_by_sector, TEST_WELCH),
}
