"""Registered queries: profiling and cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelforge.functions.tables import settled
from panelforge.operators import cleaning as C
from panelforge.operators import profiling as P
from panelforge.sources.panels import INDICATORS, PANEL_SQL, entity_panel, long_panel, long_sql

LONG_SQL = f"WITH {PANEL_SQL}, cells AS ({long_sql(INDICATORS)})"
TYPES = {"mean_discount": "ratio", "unit_price": "ratio", "n_orders": "count"}
ROUND = 5
#: A factor that moves a number off the halfway point before it is rounded, but nothing else.
NUDGE = 1.0000000000001


def rounded(df, digits: int = ROUND):
    """df with every double column rounded; numbers halfway go away from zero in every engine, as ``plans.registered`` does the same to the SQL."""
    return df.select(*[F.round(F.col(c) * NUDGE, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def stat_profile(spark, sf_dir):
    return rounded(P.column_statistics(long_panel(entity_panel(spark, sf_dir)), ["indicator"]), 4)


STAT_PROFILE = f"""{LONG_SQL} SELECT indicator, count(*) AS n_rows, count(value) AS n, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS std, round(min(value), 4) AS min, round(max(value), 4) AS max,
  count(DISTINCT value) AS n_unique, sum((value = 0)::INT)::BIGINT AS n_zero, sum((value < 0)::INT)::BIGINT AS n_negative, round(skewness(value), 4) AS skew, round(kurtosis(value), 4) AS kurtosis,
  round(quantile_cont(value, 0.25), 4) AS p25, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.75), 4) AS p75 FROM cells GROUP BY indicator"""


def stat_by_sector(spark, sf_dir):
    long = long_panel(entity_panel(spark, sf_dir))
    return rounded(P.column_statistics(long, ["indicator", "sector"]).select("indicator", "sector", "n", "mean", "std", "p25", "p50", "p75"), 4)


STAT_BY_SECTOR = f"""{LONG_SQL} SELECT indicator, sector, count(value) AS n, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS std,
  round(quantile_cont(value, 0.25), 4) AS p25, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.75), 4) AS p75 FROM cells GROUP BY indicator, sector"""


def dq_missingness(spark, sf_dir):
    return rounded(P.missingness(long_panel(entity_panel(spark, sf_dir)), 2.5))


DQ_MISSINGNESS = f"""{LONG_SQL}, s AS (SELECT indicator, avg(value) AS m, stddev_samp(value) AS sd FROM cells GROUP BY indicator)
SELECT indicator, count(*) AS n_rows, sum((value IS NULL)::INT)::BIGINT AS n_missing, round(avg((value IS NULL)::INT), 5) AS missing_share,
  sum(coalesce(abs((value - m) / nullif(sd, 0)) > 2.5, false)::INT)::BIGINT AS n_extreme FROM cells JOIN s USING (indicator) GROUP BY indicator"""


def dq_min_coverage(spark, sf_dir):
    panel = P.with_coverage(entity_panel(spark, sf_dir), [*INDICATORS, "absent"])
    return rounded(panel.where("coverage >= 0.95").select("entity_id", "coverage"))


DQ_MIN_COVERAGE = f"""WITH {PANEL_SQL} SELECT entity_id, round(c / {len(INDICATORS)}.0, 5) AS coverage FROM (SELECT entity_id, {" + ".join(f"({i} IS NOT NULL)::INT" for i in INDICATORS)} AS c FROM panel) WHERE c / {len(INDICATORS)}.0 >= 0.95"""


def dq_column_coverage(spark, sf_dir):
    return rounded(P.covered_columns(long_panel(entity_panel(spark, sf_dir)), 0.95))


DQ_COLUMN_COVERAGE = f"""{LONG_SQL} SELECT indicator, round(avg((value IS NOT NULL)::INT), 5) AS coverage, avg((value IS NOT NULL)::INT) >= 0.95 AS kept FROM cells GROUP BY indicator"""


def dq_variable_types(spark, sf_dir):
    names = long_panel(entity_panel(spark, sf_dir)).select("indicator").distinct()
    return P.variable_types(names, {"momentum": "ratio"})


DQ_VARIABLE_TYPES = f"""{LONG_SQL}, t AS (SELECT DISTINCT indicator, CASE WHEN indicator = 'momentum' THEN 'ratio' WHEN indicator LIKE '%\\_pct' ESCAPE '\\' OR indicator LIKE '%\\_percent' ESCAPE '\\' THEN 'bounded_pct' WHEN indicator LIKE '%\\_policy' ESCAPE '\\' OR indicator LIKE '%\\_target' ESCAPE '\\' OR indicator LIKE '%\\_flag' ESCAPE '\\' THEN 'binary' WHEN indicator LIKE '%\\_rank' ESCAPE '\\' THEN 'ordinal'
  WHEN indicator LIKE '%\\_share' ESCAPE '\\' OR indicator LIKE '%\\_rate' ESCAPE '\\' THEN 'bounded_pct' WHEN indicator LIKE '%\\_ratio' ESCAPE '\\' THEN 'ratio' WHEN starts_with(indicator, 'n_') THEN 'count' ELSE 'continuous' END AS vtype FROM cells)
SELECT indicator, vtype, CASE vtype {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in P.TREATMENTS.items())} END AS treatment FROM t"""


def dq_first_rows(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return P.first_rows(orders, "o_custkey", ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_totalprice")


DQ_FIRST_ROWS = """SELECT o_custkey, o_orderkey, o_totalprice FROM orders WHERE o_custkey IS NOT NULL QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1"""


def _cells(spark, sf_dir):
    """Cells with their origin: real where a value is there, else proxy or imputed by the entity's number."""
    long = long_panel(entity_panel(spark, sf_dir))
    return long.select("entity_id", "indicator", F.when(F.col("value").isNotNull() & (F.col("entity_id") % 4 != 0), "real").when(F.col("value").isNotNull(), "proxy").otherwise("imputed").alias("source"))


CELLS_SQL = f"{LONG_SQL}, origin AS (SELECT entity_id, indicator, CASE WHEN value IS NOT NULL AND entity_id % 4 <> 0 THEN 'real' WHEN value IS NOT NULL THEN 'proxy' ELSE 'imputed' END AS source FROM cells)"


def dq_origin_quality(spark, sf_dir):
    cells = _cells(spark, sf_dir)
    return rounded(P.origin_quality(cells).join(P.dominant_source(cells, ["imputed", "proxy", "real"]), "entity_id"))


DQ_ORIGIN_QUALITY = f"""{CELLS_SQL} SELECT entity_id, round(avg(CASE source WHEN 'real' THEN 1.0::DOUBLE WHEN 'proxy' THEN 0.6::DOUBLE ELSE 0.25::DOUBLE END), 5) AS quality, round(avg((source = 'real')::INT), 5) AS real_share,
  round(avg((source = 'proxy')::INT), 5) AS proxy_share, round(avg((source = 'imputed')::INT), 5) AS imputed_share,
  CASE WHEN bool_or(source = 'imputed') THEN 'imputed' WHEN bool_or(source = 'proxy') THEN 'proxy' ELSE 'real' END AS source FROM origin GROUP BY entity_id"""


def dq_origin_distribution(spark, sf_dir):
    return rounded(P.origin_distribution(_cells(spark, sf_dir)))


DQ_ORIGIN_DISTRIBUTION = f"""{CELLS_SQL} SELECT indicator, source, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY indicator), 5) AS share FROM origin GROUP BY indicator, source"""
RANGES = [("acctbal", 0.0, 9000.0, -900.0, 9900.0), ("mean_discount", 0.03, 0.07, 0.0, 0.1), ("return_rate", 0.1, 0.6, 0.0, 0.99), ("unit_price", 1000.0, 1500.0, 0.0, 5000.0)]


def dq_range_verdicts(spark, sf_dir):
    ranges = spark.createDataFrame(RANGES, "indicator string, low double, high double, hard_low double, hard_high double")
    return rounded(P.range_verdicts(long_panel(entity_panel(spark, sf_dir)), ranges))


DQ_RANGE_VERDICTS = f"""{LONG_SQL}, r(indicator, low, high, hard_low, hard_high) AS (VALUES {", ".join(f"('{a}', {b}::DOUBLE, {c}::DOUBLE, {d}::DOUBLE, {e}::DOUBLE)" for a, b, c, d, e in RANGES)}),
k AS (SELECT indicator, count(*) AS n, sum((value < low)::INT)::BIGINT AS n_below, sum((value > high)::INT)::BIGINT AS n_above, sum((value < hard_low OR value > hard_high)::INT)::BIGINT AS n_hard FROM cells JOIN r USING (indicator) WHERE value IS NOT NULL GROUP BY indicator)
SELECT *, round(1 - (n_below + n_above) / n, 5) AS in_range, CASE WHEN n_hard > 0.05 * n THEN 'FAIL' WHEN 1 - (n_below + n_above) / n >= 0.8 THEN 'PASS' WHEN 1 - (n_below + n_above) / n >= 0.6 THEN 'WARN' ELSE 'FAIL' END AS verdict FROM k"""


def dq_currency_plausibility(spark, sf_dir):
    """Quartiles of a monetary column by country and the entities beyond 1.5 interquartile ranges."""
    from panelforge.operators.ranking import quantiles

    panel = entity_panel(spark, sf_dir)
    box = quantiles(panel, ["country"], "revenue", {"p25": 0.25, "p75": 0.75})
    away = (F.col("revenue") > F.col("p75") + 1.5 * (F.col("p75") - F.col("p25"))) | (F.col("revenue") < F.col("p25") - 1.5 * (F.col("p75") - F.col("p25")))
    return rounded(panel.join(box, "country").groupBy("country").agg(F.max("p25").alias("p25"), F.max("p75").alias("p75"), F.sum(F.coalesce(away, F.lit(False)).cast("int")).alias("n_out")), 3)


DQ_CURRENCY = f"""WITH {PANEL_SQL}, b AS (SELECT country, quantile_cont(revenue, 0.25) AS p25, quantile_cont(revenue, 0.75) AS p75 FROM panel GROUP BY country)
SELECT country, round(max(p25), 3) AS p25, round(max(p75), 3) AS p75, sum(coalesce(revenue > p75 + 1.5 * (p75 - p25) OR revenue < p25 - 1.5 * (p75 - p25), false)::INT)::BIGINT AS n_out FROM panel JOIN b USING (country) GROUP BY country"""


def out_consensus(spark, sf_dir):
    return C.consensus_outliers(long_panel(settled(entity_panel(spark, sf_dir), "panel")))


OUT_CONSENSUS = f"""{LONG_SQL}, s AS (SELECT indicator, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3, quantile_cont(value, 0.5) AS med, avg(value) AS m, stddev_samp(value) AS sd FROM cells GROUP BY indicator),
d AS (SELECT indicator, quantile_cont(abs(value - med), 0.5) AS mad FROM cells JOIN s USING (indicator) GROUP BY indicator),
f AS (SELECT indicator, value, coalesce(value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1), false)::INT AS i, coalesce(mad >= 1e-10 AND abs(0.6745 * (value - med) / mad) > 3.5, false)::INT AS a, coalesce(sd > 0 AND abs((value - m) / sd) > 3, false)::INT AS z
  FROM cells JOIN s USING (indicator) JOIN d USING (indicator))
SELECT indicator, count(value) AS n, sum(i)::BIGINT AS n_iqr, sum(a)::BIGINT AS n_mad, sum(z)::BIGINT AS n_z, sum((i + a + z >= 2)::INT)::BIGINT AS n_consensus FROM f GROUP BY indicator"""


def out_mahalanobis(spark, sf_dir):
    return rounded(C.mahalanobis(entity_panel(spark, sf_dir), ["revenue", "mean_discount"]), 4)


OUT_MAHALANOBIS = f"""WITH {PANEL_SQL}, w AS (SELECT entity_id, revenue AS x, mean_discount AS y FROM panel WHERE revenue IS NOT NULL AND mean_discount IS NOT NULL),
s AS (SELECT avg(x) AS mx, avg(y) AS my, var_samp(x) AS vx, var_samp(y) AS vy, covar_samp(x, y) AS c FROM w)
SELECT entity_id, round(sqrt(greatest(((x - mx) * (x - mx) * vy - 2 * (x - mx) * (y - my) * c + (y - my) * (y - my) * vx) / (vx * vy - c * c), 0)), 4) AS distance FROM w, s"""


def _types(spark):
    return spark.createDataFrame(list(TYPES.items()), "indicator string, vtype string")


TYPES_SQL = f"types(indicator, vtype) AS (VALUES {', '.join(f"('{k}', '{v}')" for k, v in TYPES.items())})"


def win_adaptive(spark, sf_dir):
    return rounded(C.winsorised(long_panel(entity_panel(spark, sf_dir)), _types(spark)).select("entity_id", "indicator", "value"), 4)


WIN_ADAPTIVE = f"""{LONG_SQL}, {TYPES_SQL}, q AS (SELECT indicator, CASE WHEN vtype = 'ratio' THEN quantile_cont(value, 0.025) ELSE quantile_cont(value, 0.01) END AS lo, CASE WHEN vtype = 'ratio' THEN quantile_cont(value, 0.975) ELSE quantile_cont(value, 0.99) END AS hi
  FROM cells LEFT JOIN types USING (indicator) GROUP BY indicator, vtype)
SELECT entity_id, indicator, round(CASE WHEN value < lo THEN lo WHEN value > hi THEN hi ELSE value END, 4) AS value FROM cells JOIN q USING (indicator)"""


def imp_group_median(spark, sf_dir):
    columns = ["momentum", "balance_ratio", "unit_price"]
    panel = settled(entity_panel(spark, sf_dir).select("entity_id", "sector", "country", *columns), "panel")
    return rounded(C.filled_by_group(long_panel(panel, columns), "sector").select("entity_id", "indicator", "value", "filled"), 4)


IMP_GROUP_MEDIAN = f"""WITH {PANEL_SQL}, cells AS ({long_sql(["momentum", "balance_ratio", "unit_price"])}), g AS (SELECT indicator, sector, quantile_cont(value, 0.5) AS g FROM cells GROUP BY indicator, sector), a AS (SELECT indicator, quantile_cont(value, 0.5) AS a FROM cells GROUP BY indicator)
SELECT entity_id, indicator, round(coalesce(value, g, a), 4) AS value, CASE WHEN value IS NOT NULL THEN 'real' WHEN g IS NOT NULL THEN 'group' WHEN a IS NOT NULL THEN 'all' ELSE 'missing' END AS filled FROM cells LEFT JOIN g USING (indicator, sector) LEFT JOIN a USING (indicator)"""


def imp_by_type(spark, sf_dir):
    panel = entity_panel(spark, sf_dir)
    flagged = panel.withColumn("momentum_flag", C.binarised(F.col("momentum"), 0.0))
    types = spark.createDataFrame([("momentum_flag", "binary"), ("momentum", "ordinal")], "indicator string, vtype string")
    return rounded(C.filled_by_type(long_panel(flagged, ["momentum_flag", "momentum", "balance_ratio"]), types, "sector").select("entity_id", "indicator", "value"), 4)


IMP_BY_TYPE = f"""WITH {PANEL_SQL}, p2 AS (SELECT *, (momentum > 0)::INT::DOUBLE AS momentum_flag FROM panel), cells AS ({long_sql(["momentum_flag", "momentum", "balance_ratio"], "p2")}),
m AS (SELECT indicator, sector, quantile_cont(value, 0.5) AS gm FROM cells GROUP BY ALL), a AS (SELECT indicator, quantile_cont(value, 0.5) AS am FROM cells GROUP BY ALL),
v AS (SELECT indicator, sector, value, count(*) AS n FROM cells WHERE value IS NOT NULL GROUP BY ALL), x AS (SELECT indicator, sector, value AS gx FROM v QUALIFY row_number() OVER (PARTITION BY indicator, sector ORDER BY n DESC, value) = 1)
SELECT entity_id, indicator, round(CASE indicator WHEN 'momentum_flag' THEN coalesce(value, gx, 0) WHEN 'momentum' THEN ROUND(coalesce(value, gm, am)) ELSE coalesce(value, gm, am) END, 4) AS value
FROM cells LEFT JOIN m USING (indicator, sector) LEFT JOIN x USING (indicator, sector) LEFT JOIN a USING (indicator)"""


def imp_tiers(spark, sf_dir):
    panel = entity_panel(spark, sf_dir)
    long = long_panel(panel, ["unit_price", "momentum", "balance_ratio"])
    e, v = F.col("entity_id"), F.col("value")
    tiers = [(1, "real_a", e % 3 == 0, v), (2, "real_b", e % 5 == 0, v * 1.1), (3, "proxy", e % 2 == 0, v * 0.9)]
    candidates = long.select("entity_id", "indicator", F.explode(F.array(*[F.struct(F.lit(t).alias("tier"), F.lit(n).alias("label"), F.when(c, x).alias("value")) for t, n, c, x in tiers])).alias("k")).select("entity_id", "indicator", "k.*")
    return rounded(C.filled_by_tier(candidates, long.select("entity_id", "sector", "indicator"), "sector"), 4)


IMP_TIERS = f"""WITH {PANEL_SQL}, cells AS ({long_sql(["unit_price", "momentum", "balance_ratio"])}),
b AS (SELECT entity_id, sector, indicator, CASE WHEN value IS NULL THEN NULL WHEN entity_id % 3 = 0 THEN value WHEN entity_id % 5 = 0 THEN value * 1.1 WHEN entity_id % 2 = 0 THEN value * 0.9 END AS value,
  CASE WHEN value IS NULL THEN NULL WHEN entity_id % 3 = 0 THEN 'real_a' WHEN entity_id % 5 = 0 THEN 'real_b' WHEN entity_id % 2 = 0 THEN 'proxy' END AS source FROM cells),
g AS (SELECT indicator, sector, quantile_cont(value, 0.5) AS g FROM b GROUP BY ALL HAVING count(value) >= 3),
s AS (SELECT entity_id, sector, indicator, coalesce(value, g) AS value, coalesce(source, CASE WHEN g IS NOT NULL THEN 'sector_median' END) AS source FROM b LEFT JOIN g USING (indicator, sector)),
a AS (SELECT indicator, quantile_cont(value, 0.5) AS a FROM s GROUP BY ALL HAVING count(value) >= 3)
SELECT entity_id, sector, indicator, round(coalesce(value, a), 4) AS value, coalesce(source, CASE WHEN a IS NOT NULL THEN 'global_median' END, 'missing') AS source FROM s LEFT JOIN a USING (indicator)"""


def trf_signed(spark, sf_dir):
    p = entity_panel(spark, sf_dir)
    return rounded(p.select("entity_id", F.log1p("revenue").alias("log_revenue"), C.signed_log(F.col("momentum")).alias("log_momentum"), C.signed_root(F.col("acctbal")).alias("root_balance"), C.logistic_around(F.col("momentum"), F.lit(0.0), 2.0).alias("logit_momentum")))


TRF_SIGNED = f"""WITH {PANEL_SQL} SELECT entity_id, round(ln(1 + revenue), 5) AS log_revenue, round(sign(momentum) * ln(1 + abs(momentum)), 5) AS log_momentum, round(sign(acctbal) * sqrt(abs(acctbal)), 5) AS root_balance, round(1 / (1 + exp(-2 * momentum)), 5) AS logit_momentum FROM panel"""


def trf_currency(spark, sf_dir):
    """Monetary columns of some countries converted by a rate table."""
    rates = spark.createDataFrame([("ASIA", 0.012), ("EUROPE", 1.08)], "country string, rate double")
    p = entity_panel(spark, sf_dir).join(rates, "country", "left")
    r = F.coalesce("rate", F.lit(1.0))
    return rounded(p.select("entity_id", "country", (F.col("revenue") * r).alias("revenue"), (F.col("acctbal") * r).alias("acctbal")), 3)


TRF_CURRENCY = f"""WITH {PANEL_SQL} SELECT entity_id, country, round(revenue * r, 3) AS revenue, round(acctbal * r, 3) AS acctbal FROM (SELECT *, CASE country WHEN 'ASIA' THEN 0.012::DOUBLE WHEN 'EUROPE' THEN 1.08::DOUBLE ELSE 1.0::DOUBLE END AS r FROM panel)"""


def trf_ratios(spark, sf_dir):
    """Derived ratios and each entity's share of its sector."""
    p = entity_panel(spark, sf_dir)
    whole = p.groupBy("sector").agg(F.sum("revenue").alias("_all"))
    return rounded(p.join(whole, "sector").select("entity_id", (F.col("revenue") / F.when(F.col("n_orders") > 0, F.col("n_orders"))).alias("per_order"), (F.col("quantity") / F.when(F.col("revenue") > 0, F.col("revenue"))).alias("turnover"), (100 * F.col("revenue") / F.col("_all")).alias("sector_share")), 6)


TRF_RATIOS = f"""WITH {PANEL_SQL} SELECT entity_id, round(revenue / nullif(n_orders, 0), 6) AS per_order, round(quantity / CASE WHEN revenue > 0 THEN revenue END, 6) AS turnover, round(100 * revenue / sum(revenue) OVER (PARTITION BY sector), 6) AS sector_share FROM panel"""


def trf_proxies(spark, sf_dir):
    """Within-sector percentiles of three ratios, and the same calibrated to 50 and 15."""
    long = long_panel(entity_panel(spark, sf_dir), ["unit_price", "momentum", "return_rate"])
    proxy = C.within_group_percentile(long, "sector")
    return rounded(C.calibrated(proxy, "proxy", ["indicator", "sector"], "score").select("entity_id", "indicator", "proxy", "score"), 4)


TRF_PROXIES = f"""WITH {PANEL_SQL}, cells AS ({long_sql(["unit_price", "momentum", "return_rate"])}),
r AS (SELECT *, count(value) OVER w AS n, CASE WHEN value IS NOT NULL THEN rank() OVER (PARTITION BY indicator, sector ORDER BY value) + (count(*) OVER (PARTITION BY indicator, sector, value) - 1) / 2.0 END AS rk FROM cells WINDOW w AS (PARTITION BY indicator, sector)),
p AS (SELECT entity_id, indicator, sector, least(98, greatest(2, CASE WHEN n >= 2 AND rk IS NOT NULL THEN 100 * rk / n ELSE 50 END))::DOUBLE AS proxy FROM r),
s AS (SELECT *, avg(proxy) OVER w AS m, stddev_pop(proxy) OVER w AS sd, count(proxy) OVER w AS k FROM p WINDOW w AS (PARTITION BY indicator, sector))
SELECT entity_id, indicator, round(proxy, 4) AS proxy, round(CASE WHEN k < 3 THEN proxy ELSE least(98, greatest(2, 50 + 15 * coalesce((proxy - m) / CASE WHEN sd > 1e-10 THEN sd END, 0))) END, 4) AS score FROM s"""


def ord_rank(spark, sf_dir):
    """Percentile ranks 0..100 of an ordinal column, and a binary flag."""
    from panelforge.operators.ranking import with_rank

    p = with_rank(entity_panel(spark, sf_dir), "n_orders", out="_r", pct=True)
    return rounded(p.select("entity_id", (100 * F.col("_r")).alias("n_orders_rank"), C.binarised(F.col("momentum"), 0.0).alias("rising")))


ORD_RANK = f"""WITH {PANEL_SQL} SELECT entity_id, round(100 * (rank() OVER (ORDER BY n_orders) + (count(*) OVER (PARTITION BY n_orders) - 1) / 2.0) / count(*) OVER (), 5) AS n_orders_rank, (momentum > 0)::INT::DOUBLE AS rising FROM panel"""


def cls_rating(spark, sf_dir):
    p = entity_panel(spark, sf_dir)
    score = 100 * F.col("mean_discount") / 0.1
    return p.groupBy(C.rating(score).alias("rating")).agg(F.count(F.lit(1)).alias("n"))


CLS_RATING = f"""WITH {PANEL_SQL}, s AS (SELECT 100 * mean_discount / 0.1::DOUBLE AS s FROM panel) SELECT CASE WHEN s >= 60 THEN 'AAA' WHEN s >= 57 THEN 'AA' WHEN s >= 54 THEN 'A' WHEN s >= 50 THEN 'BBB' WHEN s >= 46 THEN 'BB' WHEN s >= 42 THEN 'B' WHEN s IS NOT NULL THEN 'CCC' END AS rating, count(*) AS n FROM s GROUP BY 1"""

QUERIES = {
    "stat_profile": (stat_profile, STAT_PROFILE),
    "stat_by_sector": (stat_by_sector, STAT_BY_SECTOR),
    "dq_missingness": (dq_missingness, DQ_MISSINGNESS),
    "dq_min_coverage": (dq_min_coverage, DQ_MIN_COVERAGE),
    "dq_column_coverage": (dq_column_coverage, DQ_COLUMN_COVERAGE),
    "dq_variable_types": (dq_variable_types, DQ_VARIABLE_TYPES),
    "dq_first_rows": (dq_first_rows, DQ_FIRST_ROWS),
    "dq_origin_quality": (dq_origin_quality, DQ_ORIGIN_QUALITY),
    "dq_origin_distribution": (dq_origin_distribution, DQ_ORIGIN_DISTRIBUTION),
    "dq_range_verdicts": (dq_range_verdicts, DQ_RANGE_VERDICTS),
    "dq_currency_plausibility": (dq_currency_plausibility, DQ_CURRENCY),
    "out_consensus": (out_consensus, OUT_CONSENSUS),
    "out_mahalanobis": (out_mahalanobis, OUT_MAHALANOBIS),
    "win_adaptive": (win_adaptive, WIN_ADAPTIVE),
    "imp_group_median": (imp_group_median, IMP_GROUP_MEDIAN),
    "imp_by_type": (imp_by_type, IMP_BY_TYPE),
    "imp_tiers": (imp_tiers, IMP_TIERS),
    "trf_signed": (trf_signed, TRF_SIGNED),
    "trf_currency": (trf_currency, TRF_CURRENCY),
    "trf_ratios": (trf_ratios, TRF_RATIOS),
    "trf_proxies": (trf_proxies, TRF_PROXIES),
    "ord_rank": (ord_rank, ORD_RANK),
    "cls_rating": (cls_rating, CLS_RATING),
}
