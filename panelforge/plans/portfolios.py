"""Registered queries: group analytics and portfolios."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelforge.operators import portfolio as P
from panelforge.operators import ranking as R
from panelforge.operators import scoring as S
from panelforge.plans.clean import rounded
from panelforge.plans.score import FACTORS, PREF_SQL, PROFILES, _preference, sql_rank
from panelforge.sources.panels import PANEL_SQL, entity_panel

TOP = 20


def _scores(spark, sf_dir):
    s = _preference(spark, sf_dir)
    return s.select("entity_id", F.col("profile").alias("strategy"), F.round("score", 8).alias("score"))


MEMBERS_SQL = f"{PREF_SQL}, members AS (SELECT entity_id, profile AS strategy FROM pref QUALIFY row_number() OVER (PARTITION BY profile ORDER BY ROUND(score, 8) DESC, entity_id) <= {TOP})"


def _returns(spark, sf_dir):
    p = entity_panel(spark, sf_dir)
    return p.select("entity_id", F.col("momentum").alias("h1"), (F.col("momentum") * 0.5 - 0.01).alias("h2")).unpivot("entity_id", ["h1", "h2"], "horizon", "ret")


RETURNS_SQL = "rets AS (SELECT entity_id, 'h1' AS horizon, momentum AS ret FROM panel UNION ALL SELECT entity_id, 'h2', momentum * 0.5::DOUBLE - 0.01::DOUBLE FROM panel)"


def agg_strategies(spark, sf_dir):
    return rounded(P.performance(P.members(_scores(spark, sf_dir), TOP), _returns(spark, sf_dir)))


AGG_STRATEGIES = f"""{MEMBERS_SQL}, {RETURNS_SQL}, a AS (SELECT horizon, avg(ret) AS a FROM rets GROUP BY horizon)
SELECT strategy, horizon, count(ret) AS n, round(avg(ret), 5) AS mean, round(stddev_samp(ret), 5) AS std, round(avg(ret) / stddev_samp(ret), 5) AS cs_ir, round(avg(ret) / nullif(sqrt(avg(CASE WHEN ret < 0 THEN ret * ret WHEN ret IS NOT NULL THEN 0 END)), 0), 5) AS downside_ratio,
  round(avg((ret > 0)::INT), 5) AS positive, round(avg(ret) - max(a), 5) AS excess, round((avg(ret) - max(a)) / stddev_samp(ret - a), 5) AS information_ratio
FROM members JOIN rets USING (entity_id) JOIN a USING (horizon) GROUP BY strategy, horizon"""


def agg_concentration(spark, sf_dir):
    return rounded(P.concentration(P.members(_scores(spark, sf_dir), TOP), entity_panel(spark, sf_dir)))


AGG_CONCENTRATION = f"""{MEMBERS_SQL}, c AS (SELECT strategy, panel.sector, count(*) / {TOP}.0 AS s FROM members JOIN panel USING (entity_id) GROUP BY ALL) SELECT strategy, round(sum(s * s), 5) AS hhi, count(*) AS n_groups, round(max(s)::DOUBLE, 5) AS top_share FROM c GROUP BY strategy"""


def agg_overlaps(spark, sf_dir):
    return rounded(P.overlaps(P.members(_scores(spark, sf_dir), 100)))


AGG_OVERLAPS = f"""{MEMBERS_SQL.replace(f"<= {TOP}", "<= 100")}, n AS (SELECT x.strategy AS a, y.strategy AS b, count(z.entity_id) AS shared FROM (SELECT DISTINCT strategy FROM members) x JOIN (SELECT DISTINCT strategy FROM members) y ON x.strategy < y.strategy
  JOIN members m ON m.strategy = x.strategy LEFT JOIN members z ON z.strategy = y.strategy AND z.entity_id = m.entity_id GROUP BY ALL) SELECT a, b, shared, 200 - shared AS either, round(shared / (200 - shared), 5) AS jaccard FROM n"""


def agg_group_table(spark, sf_dir):
    return rounded(P.group_table(entity_panel(spark, sf_dir), ["sector", "country"], ["revenue", "momentum"]), 3)


AGG_GROUP_TABLE = f"WITH {PANEL_SQL} SELECT sector, country, count(*) AS n, round(avg(revenue), 3) AS revenue_mean, round(stddev_samp(revenue), 3) AS revenue_std, round(avg(momentum), 3) AS momentum_mean, round(stddev_samp(momentum), 3) AS momentum_std FROM panel GROUP BY sector, country"


def agg_crosstab(spark, sf_dir):
    return rounded(P.crosstab(entity_panel(spark, sf_dir), "sector", "country"))


AGG_CROSSTAB = f"WITH {PANEL_SQL}, c AS (SELECT sector, country, count(*) AS n, grouping(sector) AS a, grouping(country) AS b FROM panel GROUP BY CUBE (sector, country)) SELECT CASE WHEN a = 1 THEN 'All' ELSE sector END AS sector, CASE WHEN b = 1 THEN 'All' ELSE country END AS country, n, (2 * a + b)::INT AS margin, round(n / sum(n) FILTER (b = 1) OVER (PARTITION BY a, sector), 5) AS share FROM c"


def agg_pivot_difference(spark, sf_dir):
    """Mean revenue by sector in two countries and their difference."""
    p = entity_panel(spark, sf_dir).groupBy("sector").pivot("country", ["ASIA", "EUROPE"]).agg(F.avg("revenue"))
    return rounded(p.select("sector", F.col("ASIA").alias("asia"), F.col("EUROPE").alias("europe"), (F.col("ASIA") - F.col("EUROPE")).alias("difference")), 3)


AGG_PIVOT = f"WITH {PANEL_SQL}, m AS (SELECT sector, avg(revenue) FILTER (country = 'ASIA') AS asia, avg(revenue) FILTER (country = 'EUROPE') AS europe FROM panel GROUP BY sector) SELECT sector, round(asia, 3) AS asia, round(europe, 3) AS europe, round(asia - europe, 3) AS difference FROM m"


def agg_leaders(spark, sf_dir):
    return P.group_leaders(entity_panel(spark, sf_dir), "sector", FACTORS)


AGG_LEADERS = f"WITH {PANEL_SQL}, m AS ({' UNION ALL '.join(f'''SELECT '{f}' AS factor, sector, avg({f}) AS m FROM panel GROUP BY sector''' for f in FACTORS)}) SELECT factor, max_by(sector, m) AS best, min_by(sector, m) AS worst FROM m GROUP BY factor"


def agg_dispersion(spark, sf_dir):
    """Coefficient of variation of sector means for each factor, and its rank."""
    p = entity_panel(spark, sf_dir)
    means = p.groupBy("sector").agg(*[F.avg(f).alias(f) for f in FACTORS]).unpivot("sector", FACTORS, "factor", "m")
    cv = means.groupBy("factor").agg((F.stddev_samp("m") / F.abs(F.avg("m"))).alias("cv"))
    return rounded(cv.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("cv")))))


AGG_DISPERSION = f"WITH {PANEL_SQL}, m AS ({' UNION ALL '.join(f'''SELECT '{f}' AS factor, avg({f}) AS m FROM panel GROUP BY sector''' for f in FACTORS)}), c AS (SELECT factor, stddev_samp(m) / abs(avg(m)) AS cv FROM m GROUP BY factor) SELECT factor, round(cv, 5) AS cv, row_number() OVER (ORDER BY cv DESC)::INT AS place FROM c"


def agg_bins(spark, sf_dir):
    return rounded(P.bin_table(entity_panel(spark, sf_dir), "revenue", 5, ["momentum", "return_rate"]), 4)


BIN_SQL = "1 + " + " + ".join(f"({{v}} > (SELECT quantile_cont({{v}}, {k / 5}) FROM panel))::INT" for k in range(1, 5))
AGG_BINS = f"WITH {PANEL_SQL}, b AS (SELECT *, {BIN_SQL.format(v='revenue')} AS bin FROM panel WHERE revenue IS NOT NULL) SELECT bin, count(*) AS n, round(avg(revenue), 4) AS score_mean, round(avg(momentum), 4) AS momentum_mean, round(avg(return_rate), 4) AS return_rate_mean FROM b GROUP BY bin"


def agg_bin_spread(spark, sf_dir):
    return rounded(P.spread(P.bin_table(entity_panel(spark, sf_dir), "revenue", 5, ["momentum"]), "momentum_mean", 5))


AGG_BIN_SPREAD = f"""WITH {PANEL_SQL}, b AS (SELECT *, {BIN_SQL.format(v="revenue")} AS bin FROM panel WHERE revenue IS NOT NULL), m AS (SELECT bin, avg(momentum) AS m, lag(avg(momentum)) OVER (ORDER BY bin) AS l FROM b GROUP BY bin)
SELECT round(max(m) FILTER (bin = 5) - max(m) FILTER (bin = 1), 5) AS spread, coalesce(bool_and(m >= l), true) OR coalesce(bool_and(m <= l), true) AS monotone, CASE WHEN bool_and(m >= l) THEN 'up' WHEN bool_and(m <= l) THEN 'down' ELSE 'none' END AS direction FROM m"""


def agg_top_bottom(spark, sf_dir):
    p = entity_panel(spark, sf_dir)
    best = R.top(p, "revenue", "entity_id", 10).select("entity_id", "position", F.lit("top").alias("side"))
    worst = R.top(p.withColumn("_x", -F.col("revenue")), "_x", "entity_id", 10).select("entity_id", "position", F.lit("bottom").alias("side"))
    return best.union(worst)


AGG_TOP_BOTTOM = f"""WITH {PANEL_SQL} (SELECT entity_id, row_number() OVER (ORDER BY revenue DESC NULLS LAST, entity_id)::INT AS position, 'top' AS side FROM panel QUALIFY position <= 10) UNION ALL (SELECT entity_id, row_number() OVER (ORDER BY revenue NULLS LAST, entity_id)::INT AS position, 'bottom' AS side FROM panel QUALIFY position <= 10)"""


def agg_composition(spark, sf_dir):
    s = entity_panel(spark, sf_dir).select("entity_id", F.col("revenue").alias("score"))
    return rounded(P.composition(entity_panel(spark, sf_dir), s, 50, "sector"))


AGG_COMPOSITION = f"""WITH {PANEL_SQL}, t AS (SELECT *, row_number() OVER (ORDER BY revenue DESC NULLS LAST, entity_id) <= 50 AS t FROM panel), c AS (SELECT sector, count(*) / sum(count(*)) OVER () AS s, sum(t::INT) / 50.0 AS k FROM t GROUP BY sector)
SELECT sector, round(s, 5) AS share, round(k, 5) AS top_share, round(100 * (k - s), 5) AS difference FROM c"""


def agg_weighted(spark, sf_dir):
    p = entity_panel(spark, sf_dir)
    return rounded(P.weighted_returns(p, {"equal": F.lit(1.0), "value": F.col("revenue"), "score": F.col("n_orders")}, "momentum"))


AGG_WEIGHTED = f"""WITH {PANEL_SQL}, w AS (SELECT 'equal' AS scheme, momentum AS x, 1.0::DOUBLE AS w FROM panel UNION ALL SELECT 'value', momentum, revenue FROM panel UNION ALL SELECT 'score', momentum, n_orders FROM panel)
SELECT scheme, round(sum(w * x) / sum(w), 5) AS mean, round(sqrt(sum(w * x * x) / sum(w) - (sum(w * x) / sum(w)) ** 2), 5) AS std FROM w WHERE x IS NOT NULL AND w IS NOT NULL GROUP BY scheme"""


def agg_premium(spark, sf_dir):
    """High less low tercile of a factor, within halves of size."""
    p = R.with_bin(R.with_bin(entity_panel(spark, sf_dir), "mean_discount", 3, out="tercile"), "revenue", 2, out="half")
    hi, lo = (F.avg(F.when(F.col("tercile") == k, F.col("momentum"))) for k in (3, 1))
    return rounded(p.where("half is not null").groupBy("half").agg(hi.alias("high"), lo.alias("low"), (hi - lo).alias("premium")))


AGG_PREMIUM = f"""WITH {PANEL_SQL}, t AS (SELECT *, 1 + (mean_discount > (SELECT quantile_cont(mean_discount, 1 / 3) FROM panel))::INT + (mean_discount > (SELECT quantile_cont(mean_discount, 2 / 3) FROM panel))::INT AS tercile, 1 + (revenue > (SELECT quantile_cont(revenue, 0.5) FROM panel))::INT AS half FROM panel)
SELECT half, round(avg(momentum) FILTER (tercile = 3), 5) AS high, round(avg(momentum) FILTER (tercile = 1), 5) AS low, round(avg(momentum) FILTER (tercile = 3) - avg(momentum) FILTER (tercile = 1), 5) AS premium FROM t WHERE half IS NOT NULL GROUP BY half"""


def agg_attribution(spark, sf_dir):
    return rounded(P.attribution(entity_panel(spark, sf_dir), "revenue", "momentum"))


AGG_ATTRIBUTION = f"WITH {PANEL_SQL}, b AS (SELECT *, {BIN_SQL.format(v='revenue')} AS bin FROM panel WHERE revenue IS NOT NULL) SELECT round(avg(momentum) FILTER (bin = 5), 5) AS top, round(avg(momentum) FILTER (bin = 1), 5) AS bottom, round(avg(momentum) FILTER (bin = 5) - avg(momentum) FILTER (bin = 1), 5) AS spread FROM b"


def agg_contributions(spark, sf_dir):
    norms = S.factor_norms(entity_panel(spark, sf_dir), "entity_id", FACTORS, "rank")
    best = P.members(_scores(spark, sf_dir).where("strategy = 'growth'"), TOP)
    return rounded(P.contributions(norms, best, S.without_factor(PROFILES["growth"], "")))


AGG_CONTRIBUTIONS = f"""{MEMBERS_SQL}, g AS (SELECT f.*, m.entity_id IS NOT NULL AS i FROM f LEFT JOIN members m ON m.entity_id = f.entity_id AND m.strategy = 'growth')
{" UNION ALL ".join(f"SELECT '{f}' AS factor, round({w / 10!r}::DOUBLE * (avg({f}) FILTER (i) - avg({f})), 5) AS contribution FROM g" for f, w in PROFILES["growth"].items())}"""


def agg_movers(spark, sf_dir):
    """The ten largest rank changes between two profiles."""
    ranked = R.with_rank(_scores(spark, sf_dir), "score", ["strategy"], "rank", descending=True)
    pick = lambda s: F.max(F.when(F.col("strategy") == s, F.col("rank")))
    moved = ranked.groupBy("entity_id").agg((pick("growth") - pick("steady")).alias("change")).withColumn("size", F.abs("change"))
    return R.top(moved, "size", "entity_id", 10).select("entity_id", "change", "position")


AGG_MOVERS = f"""{PREF_SQL}, r AS (SELECT entity_id, profile, {sql_rank("-ROUND(score, 8)", "profile", False)} AS r FROM pref), c AS (SELECT entity_id, max(r) FILTER (profile = 'growth') - max(r) FILTER (profile = 'steady') AS change FROM r GROUP BY entity_id)
SELECT entity_id, change, row_number() OVER (ORDER BY abs(change) DESC, entity_id)::INT AS position FROM c QUALIFY position <= 10"""


def agg_gini(spark, sf_dir):
    return rounded(P.gini(entity_panel(spark, sf_dir), "acctbal"), 6)


AGG_GINI = f"WITH {PANEL_SQL}, x AS (SELECT acctbal - min(acctbal) OVER () + 1e-6 AS x FROM panel WHERE acctbal IS NOT NULL), r AS (SELECT x, row_number() OVER (ORDER BY x) AS i FROM x), c AS (SELECT i, sum(x) OVER (ORDER BY i) / sum(x) OVER () AS c FROM r) SELECT round(1 - 2 * (sum(c) - (max(c) + min(c)) / 2) / count(*), 6) AS gini FROM c HAVING count(*) >= 5"


def agg_ecdf(spark, sf_dir):
    return rounded(P.ecdf(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), "l_quantity"))


AGG_ECDF = "SELECT l_quantity, round(sum(count(*)) OVER (ORDER BY l_quantity) / sum(count(*)) OVER (), 5) AS ecdf FROM lineitem GROUP BY l_quantity"


def agg_variance_parts(spark, sf_dir):
    return rounded(P.variance_parts(entity_panel(spark, sf_dir), "momentum", "sector"), 4)


AGG_VARIANCE = f"WITH {PANEL_SQL}, g AS (SELECT count(momentum) AS n, avg(momentum) AS m, var_pop(momentum) AS v FROM panel WHERE momentum IS NOT NULL GROUP BY sector), s AS (SELECT sum(n * m * m) - sum(n) * (sum(n * m) / sum(n)) ** 2 AS b, sum(n * v) AS w FROM g) SELECT round(b, 4) AS between, round(w, 4) AS within, round(b / (b + w), 4) AS eta_squared FROM s".replace(" AS between", ' AS "between"')


def agg_screener(spark, sf_dir):
    """Threshold filters, the number of matches and the five best."""
    p = entity_panel(spark, sf_dir).where("revenue > 1000000 and return_rate < 0.4 and momentum > 0")
    count = p.agg(F.count(F.lit(1)).alias("matches"))
    return R.top(p, "momentum", "entity_id", 5).crossJoin(F.broadcast(count)).select("entity_id", "position", "matches")


AGG_SCREENER = f"WITH {PANEL_SQL}, m AS (SELECT * FROM panel WHERE revenue > 1000000 AND return_rate < 0.4 AND momentum > 0) SELECT entity_id, row_number() OVER (ORDER BY momentum DESC, entity_id)::INT AS position, (SELECT count(*) FROM m) AS matches FROM m QUALIFY position <= 5"


def agg_opportunities(spark, sf_dir):
    """Entities above the universe median and their sector's mean."""
    p = entity_panel(spark, sf_dir)
    m = R.quantiles(p, [], "revenue", {"med": 0.5})
    s = p.groupBy("sector").agg(F.avg("momentum").alias("avg"))
    found = p.crossJoin(F.broadcast(m)).join(s, "sector").where((F.col("revenue") > F.col("med")) & (F.col("momentum") > F.col("avg")))
    return found.groupBy("sector").agg(F.count(F.lit(1)).alias("n"))


AGG_OPPORTUNITIES = f"WITH {PANEL_SQL}, a AS (SELECT sector, avg(momentum) AS a FROM panel GROUP BY sector) SELECT sector, count(*) AS n FROM panel JOIN a USING (sector) WHERE revenue > (SELECT quantile_cont(revenue, 0.5) FROM panel) AND momentum > a GROUP BY sector"


def agg_regimes(spark, sf_dir):
    """Portfolio mean against all entities above and below the median return (in-sample, as it conditions on what it measures)."""
    p = R.with_bin(entity_panel(spark, sf_dir).where("momentum is not null"), "momentum", 2, out="regime")
    best = P.members(_scores(spark, sf_dir).where("strategy = 'steady'"), 200).select("entity_id", F.lit(1).alias("_in"))
    both = p.join(F.broadcast(best), "entity_id", "left").groupBy("regime").agg(F.avg(F.when(F.col("_in") == 1, F.col("momentum"))).alias("portfolio"), F.avg("momentum").alias("universe"))
    return rounded(both.withColumn("capture", F.col("portfolio") / F.col("universe")))


AGG_REGIMES = f"""{MEMBERS_SQL.replace(f"<= {TOP}", "<= 200")}, g AS (SELECT p.*, 1 + (momentum > (SELECT quantile_cont(momentum, 0.5) FROM panel))::INT AS regime, m.entity_id IS NOT NULL AS i FROM panel p LEFT JOIN members m ON m.entity_id = p.entity_id AND strategy = 'steady' WHERE momentum IS NOT NULL)
SELECT regime, round(avg(momentum) FILTER (i), 5) AS portfolio, round(avg(momentum), 5) AS universe, round(avg(momentum) FILTER (i) / avg(momentum), 5) AS capture FROM g GROUP BY regime"""


def agg_rebalance_grid(spark, sf_dir):
    """Mean return and hit rate for several portfolio sizes and strategies."""
    sizes = spark.createDataFrame([(10,), (20,), (50,)], "size int")
    ranked = R.top(_scores(spark, sf_dir), "score", "entity_id", 50, ["strategy"])
    r = entity_panel(spark, sf_dir).select("entity_id", "momentum")
    rows = ranked.join(F.broadcast(sizes), F.col("position") <= F.col("size")).join(r, "entity_id")
    return rounded(rows.groupBy("strategy", "size").agg(F.avg("momentum").alias("mean"), F.avg((F.col("momentum") > 0).cast("int")).alias("hit_rate")))


AGG_REBALANCE = f"""{PREF_SQL}, r AS (SELECT entity_id, profile AS strategy, row_number() OVER (PARTITION BY profile ORDER BY ROUND(score, 8) DESC, entity_id) AS position FROM pref)
SELECT strategy, size, round(avg(momentum), 5) AS mean, round(avg((momentum > 0)::INT), 5) AS hit_rate FROM r JOIN (SELECT unnest([10, 20, 50])::INT AS size) ON position <= size JOIN panel USING (entity_id) GROUP BY ALL"""

QUERIES = {
    "agg_strategies": (agg_strategies, AGG_STRATEGIES), "agg_concentration": (agg_concentration, AGG_CONCENTRATION), "agg_overlaps": (agg_overlaps, AGG_OVERLAPS), "agg_group_table": (agg_group_table, AGG_GROUP_TABLE),
    "agg_crosstab": (agg_crosstab, AGG_CROSSTAB), "agg_pivot_difference": (agg_pivot_difference, AGG_PIVOT), "agg_leaders": (agg_leaders, AGG_LEADERS), "agg_dispersion": (agg_dispersion, AGG_DISPERSION),
    "agg_bins": (agg_bins, AGG_BINS), "agg_bin_spread": (agg_bin_spread, AGG_BIN_SPREAD), "agg_top_bottom": (agg_top_bottom, AGG_TOP_BOTTOM), "agg_composition": (agg_composition, AGG_COMPOSITION),
    "agg_weighted": (agg_weighted, AGG_WEIGHTED), "agg_premium": (agg_premium, AGG_PREMIUM), "agg_attribution": (agg_attribution, AGG_ATTRIBUTION), "agg_contributions": (agg_contributions, AGG_CONTRIBUTIONS),
    "agg_movers": (agg_movers, AGG_MOVERS), "agg_gini": (agg_gini, AGG_GINI), "agg_ecdf": (agg_ecdf, AGG_ECDF), "agg_variance_parts": (agg_variance_parts, AGG_VARIANCE), "agg_screener": (agg_screener, AGG_SCREENER),
    "agg_opportunities": (agg_opportunities, AGG_OPPORTUNITIES), "agg_regimes": (agg_regimes, AGG_REGIMES), "agg_rebalance_grid": (agg_rebalance_grid, AGG_REBALANCE),
}
