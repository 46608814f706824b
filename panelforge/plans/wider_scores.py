"""Registered queries: configured, market and pillar scores, tilts, and the preparation of their columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelforge.functions.tables import settled
from panelforge.operators import cleaning as C
from panelforge.operators import profiling as P
from panelforge.operators import scoring as S
from panelforge.operators.ranking import rank_columns
from panelforge.plans.clean import LONG_SQL, rounded
from panelforge.plans.score import FACTORS, PREF_SQL, PROFILES, RANKED_SQL, ZWIDE_SQL, _preference, _zwide, sql_rank
from panelforge.sources.panels import INDICATORS, PANEL_SQL, entity_panel, long_panel

#: category -> (weight, indicator -> weight); ``sales`` is absent and has a fallback, ``nothing`` has neither.
SECTION = {"size": (0.5, {"sales": 0.6, "quantity": 0.4}), "care": (0.3, {"return_rate": 0.5, "mean_discount": 0.5, "nothing": 2.0}), "pace": (0.2, {"momentum": 1.0}), "none": (0.4, {"nothing": 1.0})}
FALLBACKS = {"sales": "revenue"}
_CATEGORIES_SQL = {"size": "0.6::DOUBLE * coalesce(revenue, 0) + 0.4::DOUBLE * coalesce(quantity, 0)", "care": "0.5::DOUBLE * coalesce(return_rate, 0) + 0.5::DOUBLE * coalesce(mean_discount, 0)", "pace": "coalesce(momentum, 0)"}
_CATEGORY_SQL = ", ".join(f"{v} AS {k}" for k, v in _CATEGORIES_SQL.items())


def scr_config(spark, sf_dir):
    """Two-level score with a fallback, an absent indicator and an absent category, plain and with standardised categories."""
    z = _zwide(spark, sf_dir)
    plain = S.config_score(z, SECTION, FALLBACKS, out="plain")
    return rounded(S.config_score(plain, SECTION, FALLBACKS, True, "restandardised").select("entity_id", "plain", "restandardised"))


SCR_CONFIG = f"""{ZWIDE_SQL}, c AS (SELECT entity_id, {_CATEGORY_SQL} FROM zw),
r AS (SELECT entity_id, 0.5::DOUBLE * size + 0.3::DOUBLE * care + 0.2::DOUBLE * pace AS a,
  0.5::DOUBLE * (size - avg(size) OVER ()) / stddev_samp(size) OVER () + 0.3::DOUBLE * (care - avg(care) OVER ()) / stddev_samp(care) OVER () + 0.2::DOUBLE * (pace - avg(pace) OVER ()) / stddev_samp(pace) OVER () AS b FROM c)
SELECT entity_id, round(least(100, greatest(0, 50 + 20 * a)), 5) AS plain, round(least(100, greatest(0, 50 + 20 * b)), 5) AS restandardised FROM r"""

MARKET = {"liquidity": (0.40, {"quantity": 1.0, "n_orders": 0.5}), "volatility": (0.30, {"return_rate": 1.0}), "momentum": (0.30, {"momentum": 1.0})}
MARKET_COLUMNS = ["quantity", "n_orders", "return_rate", "momentum"]


def _market(spark, sf_dir):
    panel = entity_panel(spark, sf_dir).withColumn("return_rate", -F.col("return_rate"))
    long = C.quantile_clipped(settled(long_panel(panel, MARKET_COLUMNS), "cells"), 0.01, 0.99, ["indicator"])
    wide = S.wide_norms(S.normalised(long, "zscore"), ["entity_id", "sector", "country"], MARKET_COLUMNS)
    return S.market_score(wide, MARKET)


MARKET_SQL = f"""WITH {PANEL_SQL}, cells AS ({" UNION ALL ".join(f"SELECT entity_id, sector, country, '{c}' AS indicator, {'-' if c == 'return_rate' else ''}{c} AS value FROM panel" for c in MARKET_COLUMNS)}),
q AS (SELECT indicator, quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi FROM cells GROUP BY indicator),
w AS (SELECT cells.* REPLACE (CASE WHEN value < lo THEN lo WHEN value > hi THEN hi ELSE value END AS value) FROM cells JOIN q USING (indicator)),
z AS (SELECT *, (value - avg(value) OVER (PARTITION BY indicator)) / (stddev_samp(value) OVER (PARTITION BY indicator) + 1e-10) AS z FROM w),
m AS (SELECT entity_id, {", ".join(f"coalesce(max(z) FILTER (indicator = '{c}'), 0) AS {c}" for c in MARKET_COLUMNS)} FROM z GROUP BY entity_id),
market AS (SELECT entity_id, (quantity + 0.5::DOUBLE * n_orders) / 1.5::DOUBLE AS l, return_rate AS v, momentum AS p FROM m)"""


def scr_market(spark, sf_dir):
    return rounded(_market(spark, sf_dir).select("entity_id", "market_liquidity_score", "market_volatility_score", "market_momentum_score", "market_score"))


SCR_MARKET = f"""{MARKET_SQL} SELECT entity_id, round(l, 5) AS market_liquidity_score, round(v, 5) AS market_volatility_score, round(p, 5) AS market_momentum_score,
  round(least(100, greatest(0, 50 + 20 * (0.4::DOUBLE * l + 0.3::DOUBLE * v + 0.3::DOUBLE * p))), 5) AS market_score FROM market"""


def scr_market_ex_momentum(spark, sf_dir):
    return rounded(S.market_ex_momentum(_market(spark, sf_dir)).select("entity_id", "market_score_ex_momentum"))


SCR_MARKET_EX = f"{MARKET_SQL} SELECT entity_id, round(least(100, greatest(0, 50 + 20 * (0.4::DOUBLE / 0.7::DOUBLE * l + 0.3::DOUBLE / 0.7::DOUBLE * v))), 5) AS market_score_ex_momentum FROM market"

#: Three pillars; ``fixed`` is constant, urgent_share has no calibration data.
PILLARS = {
    "E": {"volume": (0.6, ["n_orders", "urgent_share"]), "idle": (0.4, ["fixed"])},
    "S": {"price": (0.5, ["unit_price"]), "returns": (0.5, ["return_rate", "mean_discount"])},
    "G": {"balance": (1.0, ["acctbal", "balance_ratio"])},
}
SOURCE = "CASE entity_id % 4 WHEN 0 THEN 'Calibrated proxy' WHEN 1 THEN 'imputed' WHEN 2 THEN 'imputed from SEC' ELSE 'other' END"


def scr_pillars_full(spark, sf_dir):
    """Pillars with the constancy test and calibration penalty, the first freed of a financial score, empirical weights, provenance, shrinkage and scaling."""
    z = _zwide(spark, sf_dir).withColumn("fixed", F.lit(1.0)).withColumn("source", F.expr(SOURCE))
    table = settled(S.pillar_table(z, PILLARS, {"urgent_share"}), "pillars")
    table = settled(S.decoupled(table, "E_score", "revenue", "sector"), "decoupled")
    pillars = [f"{p}_score" for p in PILLARS]
    weights = S.empirical_weights(table, pillars, "revenue").select(*[F.col(p).alias(f"w_{p}") for p in pillars])
    joined = table.crossJoin(F.broadcast(weights))
    there = sum((F.when(F.col(p).isNotNull(), F.col(f"w_{p}")).otherwise(0.0) for p in pillars), F.lit(0.0))
    total = sum((F.coalesce(F.col(p), F.lit(0.0)) * F.col(f"w_{p}") for p in pillars), F.lit(0.0))
    confidence = F.least(F.lit(1.0), there / sum((F.col(f"w_{p}") for p in pillars), F.lit(0.0))) * S.provenance_weight(F.col("source"))
    scored = settled(joined.withColumn("raw", F.when(there > 0, total / there)).withColumn("confidence", confidence), "scored")
    out = S.shrunk(scored, "raw", "confidence", "sector", "composite", least=0.45)
    scale = lambda c: F.when(F.col(c) < -2.5, 0.0).when(F.col(c) > 2.5, 100.0).otherwise(50 + 20 * F.col(c)).alias(c)
    return rounded(out.select("entity_id", *map(scale, [*pillars, "composite"]), "E_coverage", "S_coverage", "G_coverage", "confidence"))


_m = lambda cols: f"(({' + '.join(f'coalesce({c}, 0)' for c in cols)}) / nullif({' + '.join(f'({c} IS NOT NULL)::INT' for c in cols)}, 0))"
_scale = lambda c: f"round(CASE WHEN {c} < -2.5 THEN 0 WHEN {c} > 2.5 THEN 100 ELSE 50 + 20 * {c} END, 5) AS {c}"
SCR_PILLARS_FULL = f"""{ZWIDE_SQL}, a AS (SELECT *, {SOURCE} AS source, {_m(["n_orders", "urgent_share"])} AS e0, unit_price AS s1, {_m(["return_rate", "mean_discount"])} AS s2, {_m(["acctbal", "balance_ratio"])} AS g0 FROM zw),
b AS (SELECT *, 0.6::DOUBLE * (1 - 0.7::DOUBLE / 2) AS we, (coalesce(s1, 0) * 0.5 + coalesce(s2, 0) * 0.5) / nullif(0.5 * (s1 IS NOT NULL)::INT + 0.5 * (s2 IS NOT NULL)::INT, 0) AS S_score, g0 AS G_score FROM a),
c AS (SELECT *, CASE WHEN e0 IS NULL OR revenue IS NULL THEN e0 ELSE e0 - revenue * (SELECT covar_samp(e0, revenue) / var_samp(revenue) FROM b WHERE e0 IS NOT NULL AND revenue IS NOT NULL) END AS e1 FROM b),
d AS (SELECT *, {sql_rank("e1", "sector")} AS er FROM c), e AS (SELECT *, (er - avg(er) OVER ()) / (stddev_samp(er) OVER () + 1e-10) AS E_score FROM d),
k AS (SELECT coalesce(1 / (abs(corr(E_score, revenue)) + 1e-6), 0) AS ke, coalesce(1 / (abs(corr(S_score, revenue)) + 1e-6), 0) AS ks, coalesce(1 / (abs(corr(G_score, revenue)) + 1e-6), 0) AS kg FROM e),
w AS (SELECT ke / (ke + ks + kg) AS pe, ks / (ke + ks + kg) AS ps, kg / (ke + ks + kg) AS pg FROM k),
f AS (SELECT *, CASE WHEN E_score IS NULL THEN 0 ELSE pe END + CASE WHEN S_score IS NULL THEN 0 ELSE ps END + CASE WHEN G_score IS NULL THEN 0 ELSE pg END AS there FROM e, w),
g AS (SELECT *, (coalesce(E_score * pe, 0) + coalesce(S_score * ps, 0) + coalesce(G_score * pg, 0)) / nullif(there, 0) AS raw,
  least(1, there) * CASE WHEN regexp_matches(lower(source), 'epa|sec|real|yahoo|sbti|cdp|ungc') THEN 1 WHEN regexp_matches(lower(source), 'imput') THEN 0.4 WHEN regexp_matches(lower(source), 'proxy|calibrated') THEN 0.5 ELSE 1 END AS confidence FROM f),
h AS (SELECT sector, quantile_cont(raw, 0.5) AS med FROM g GROUP BY sector),
i AS (SELECT g.*, CASE WHEN confidence < 0.45 THEN confidence * raw + (1 - confidence) * med ELSE raw END AS composite FROM g LEFT JOIN h USING (sector))
SELECT entity_id, {", ".join(map(_scale, ["E_score", "S_score", "G_score", "composite"]))}, round(CASE WHEN e0 IS NULL THEN 0 ELSE we END, 5) AS E_coverage, round(0.5 * (s1 IS NOT NULL)::INT + 0.5 * (s2 IS NOT NULL)::INT, 5) AS S_coverage,
  round((g0 IS NOT NULL)::INT, 5) AS G_coverage, round(confidence, 5) AS confidence FROM i"""


def scr_quality_proxy(spark, sf_dir):
    return rounded(S.quality_proxy(entity_panel(spark, sf_dir), "entity_id", ["mean_order", "unit_price", "balance_ratio"], ["momentum"]))


_Q = ["mean_order", "unit_price", "balance_ratio"]
SCR_QUALITY_PROXY = f"WITH {PANEL_SQL}, r AS (SELECT entity_id, {', '.join(f'100 * ({sql_rank(c)}) AS {c}' for c in _Q)} FROM panel) SELECT entity_id, round({_m(_Q)}, 5) AS proxy FROM r"


def pref_tilted(spark, sf_dir):
    """Preference scores drawn to the percentile of mean momentum."""
    p = entity_panel(spark, sf_dir).withColumn("momentum_2", F.when(F.col("entity_id") % 3 == 0, F.col("momentum") / 2))
    share = S.momentum_percentile(p.select("entity_id", "momentum", "momentum_2"), ["momentum", "momentum_2"])
    scores = _preference(spark, sf_dir).where("profile = 'even'").join(share.select("entity_id", "momentum_percentile"), "entity_id")
    return rounded(scores.select("entity_id", S.tilted(F.col("score"), F.col("momentum_percentile")).alias("score")), 4)


PREF_TILTED = f"""{PREF_SQL}, a AS (SELECT entity_id, CASE WHEN entity_id % 3 = 0 THEN momentum * 0.75::DOUBLE ELSE momentum END AS m FROM panel), b AS (SELECT entity_id, coalesce(m, (SELECT quantile_cont(m, 0.5) FROM a)) AS m FROM a),
c AS (SELECT entity_id, 100 * ({sql_rank("m")}) AS p FROM b) SELECT entity_id, round(least(100, greatest(0, 0.85::DOUBLE * score + 0.15::DOUBLE * p)), 4) AS score FROM pref JOIN c USING (entity_id) WHERE profile = 'even'"""
OWN = {"revenue": 1.0, "momentum": 1.0, "unit_price": 6.0}


def pref_rerank(spark, sf_dir):
    norms = S.factor_norms(entity_panel(spark, sf_dir), "entity_id", FACTORS, "rank")
    return rounded(S.reranked(norms, "entity_id", PROFILES["growth"], OWN), 4)


PREF_RERANK = f"""{RANKED_SQL}, s AS (SELECT entity_id, ROUND(revenue * 0.2::DOUBLE + momentum * 0.6::DOUBLE + unit_price * 0.2::DOUBLE, 8) AS a, ROUND(revenue * 0.125::DOUBLE + momentum * 0.125::DOUBLE + unit_price * 0.75::DOUBLE, 8) AS b FROM f),
r AS (SELECT *, rank() OVER (ORDER BY a DESC) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS ra, rank() OVER (ORDER BY b DESC) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS rb FROM s) SELECT entity_id, round(b, 4) AS score, round(rb, 4) AS rank, round(ra - rb, 4) AS change FROM r"""


def dq_missing_cells(spark, sf_dir):
    """Share of missing cells over all numeric columns."""
    cells = long_panel(entity_panel(spark, sf_dir))
    return rounded(cells.agg(F.count(F.lit(1)).alias("cells"), F.sum(F.col("value").isNull().cast("int")).alias("missing"), (100 * F.avg(F.col("value").isNull().cast("int"))).alias("missing_pct")))


DQ_MISSING_CELLS = f"{LONG_SQL} SELECT count(*) AS cells, count(*) - count(value) AS missing, round(100.0 * (count(*) - count(value)) / count(*), 5) AS missing_pct FROM cells"


def dq_clean_step(spark, sf_dir):
    """Missing cells before and after the coverage filter and the group-median fill, by indicator."""
    panel = settled(entity_panel(spark, sf_dir), "panel")
    before = long_panel(panel).groupBy("indicator").agg(F.count(F.lit(1)).alias("rows_before"), F.sum(F.col("value").isNull().cast("int")).alias("missing_before"))
    kept = settled(long_panel(P.enough_coverage(panel, INDICATORS, 0.8)), "kept")
    after = C.filled_by_group(kept, "sector").groupBy("indicator").agg(F.count(F.lit(1)).alias("rows_after"), F.sum(F.col("value").isNull().cast("int")).alias("missing_after"), F.sum((F.col("filled") == "group").cast("int")).alias("filled"))
    return before.join(after, "indicator", "left")


_COVERED = " + ".join(f"({c} IS NOT NULL)::INT" for c in INDICATORS)
DQ_CLEAN_STEP = f"""{LONG_SQL}, kept AS (SELECT entity_id FROM panel WHERE ({_COVERED}) / {len(INDICATORS)}.0 >= 0.8), b AS (SELECT indicator, count(*) AS rows_before, (count(*) - count(value))::BIGINT AS missing_before FROM cells GROUP BY indicator),
k AS (SELECT cells.*, max(value) OVER (PARTITION BY indicator, sector) IS NOT NULL AS fillable, max(value) OVER (PARTITION BY indicator) IS NOT NULL AS any_value FROM cells JOIN kept USING (entity_id)),
a AS (SELECT indicator, count(*) AS rows_after, sum((value IS NULL AND NOT any_value)::INT)::BIGINT AS missing_after, sum((value IS NULL AND fillable)::INT)::BIGINT AS filled FROM k GROUP BY indicator)
SELECT indicator, rows_before, missing_before, rows_after, missing_after, filled FROM b LEFT JOIN a USING (indicator)"""


def stat_usable(spark, sf_dir):
    """The first of a preference list of return columns with over 10 values."""
    p = entity_panel(spark, sf_dir).withColumn("sparse", F.when(F.col("entity_id") <= 10, F.col("momentum")))
    names = ["sparse", "momentum", "revenue"]
    counts = p.select("entity_id", *names).unpivot("entity_id", names, "indicator", "value").groupBy("indicator").agg(F.count("value").alias("n"))
    place = F.array_position(F.array(*map(F.lit, names)), F.col("indicator"))
    return counts.where("n > 10").agg(F.min_by("indicator", place).alias("usable"))


STAT_USABLE = f"WITH {PANEL_SQL} SELECT CASE WHEN (SELECT count(momentum) FROM panel WHERE entity_id <= 10) > 10 THEN 'sparse' WHEN (SELECT count(momentum) FROM panel) > 10 THEN 'momentum' ELSE 'revenue' END AS usable"


def trf_skewed_log(spark, sf_dir):
    """log1p of the non-negative columns whose absolute skewness is over 2, by a pass of statistics first."""
    cells = settled(long_panel(entity_panel(spark, sf_dir)), "cells")
    skew = P.column_statistics(cells, ["indicator"]).where("abs(skew) > 2 and n_negative = 0").select("indicator")
    return rounded(cells.join(skew, "indicator", "left_semi").select("entity_id", "indicator", F.log1p("value").alias("logged")))


TRF_SKEWED_LOG = f"{LONG_SQL}, s AS (SELECT indicator FROM cells GROUP BY indicator HAVING abs(skewness(value)) > 2 AND count(*) FILTER (value < 0) = 0) SELECT entity_id, indicator, round(ln(1 + value), 5) AS logged FROM cells SEMI JOIN s USING (indicator)"


def trf_scale_neutral(spark, sf_dir):
    """Ratios that do not depend on size: each null where its denominator is not positive."""
    p = entity_panel(spark, sf_dir)
    over = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    growth = F.when(F.col("momentum") > -1, F.col("return_rate") * (1 - F.col("mean_discount")))
    return rounded(p.select("entity_id", over("revenue", "acctbal").alias("turnover"), over("acctbal", "revenue").alias("cash_share"), over("mean_order", "unit_price").alias("units"), F.when(F.col("revenue") > 0, F.log(F.col("revenue") * F.col("unit_price"))).alias("log_volume"), growth.alias("sustainable")))


TRF_SCALE_NEUTRAL = f"""WITH {PANEL_SQL} SELECT entity_id, round(CASE WHEN acctbal > 0 THEN revenue / acctbal END, 5) AS turnover, round(CASE WHEN revenue > 0 THEN acctbal / revenue END, 5) AS cash_share,
  round(CASE WHEN unit_price > 0 THEN mean_order / unit_price END, 5) AS units, round(CASE WHEN revenue > 0 THEN ln(revenue * unit_price) END, 5) AS log_volume, round(CASE WHEN momentum > -1 THEN return_rate * (1 - mean_discount) END, 5) AS sustainable FROM panel"""


def imp_inverted_ranks(spark, sf_dir):
    """Totals as inverted percentile ranks of their log, kept in 2..98; negative or missing totals have none."""
    p = entity_panel(spark, sf_dir).select("entity_id", F.when(F.col("quantity") >= 0, F.log1p("quantity")).alias("quantity"), F.when(F.col("revenue") >= 0, F.log1p("revenue")).alias("revenue"))
    ranks = rank_columns(p, "entity_id", ["quantity", "revenue"], pct=True)
    score = lambda c: F.greatest(F.lit(2.0), F.least(F.lit(98.0), 100 * (1 - F.col(f"{c}_rank"))))
    each = p.select("entity_id").join(ranks, "entity_id", "left")
    return rounded(each.select("entity_id", *[F.when(F.col(f"{c}_rank").isNotNull(), score(c)).alias(f"{c}_score") for c in ("quantity", "revenue")]))


IMP_INVERTED = f"WITH {PANEL_SQL} SELECT entity_id, {', '.join(f'round(CASE WHEN {c} IS NOT NULL THEN greatest(2, least(98, 100 * (1 - ({sql_rank(c)})))) END, 5) AS {c}_score' for c in ('quantity', 'revenue'))} FROM panel"

QUERIES = {
    "scr_config": (scr_config, SCR_CONFIG), "scr_market": (scr_market, SCR_MARKET), "scr_market_ex_momentum": (scr_market_ex_momentum, SCR_MARKET_EX),
    "scr_pillars_full": (scr_pillars_full, SCR_PILLARS_FULL), "scr_quality_proxy": (scr_quality_proxy, SCR_QUALITY_PROXY), "pref_tilted": (pref_tilted, PREF_TILTED), "pref_rerank": (pref_rerank, PREF_RERANK),
    "dq_missing_cells": (dq_missing_cells, DQ_MISSING_CELLS), "dq_clean_step": (dq_clean_step, DQ_CLEAN_STEP), "stat_usable": (stat_usable, STAT_USABLE),
    "trf_skewed_log": (trf_skewed_log, TRF_SKEWED_LOG), "trf_scale_neutral": (trf_scale_neutral, TRF_SCALE_NEUTRAL), "imp_inverted_ranks": (imp_inverted_ranks, IMP_INVERTED),
}
