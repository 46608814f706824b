"""Registered queries: normalisation, scores, preferences, ranks."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelforge.functions.tables import settled
from panelforge.operators import ranking as R
from panelforge.operators import scoring as S
from panelforge.operators.profiling import enough_coverage
from panelforge.plans.clean import LONG_SQL, rounded
from panelforge.operators.cleaning import filled_by_group, quantile_clipped
from panelforge.sources.panels import INDICATORS, PANEL_SQL, entity_panel, long_panel, long_sql

INVERSE = ["mean_discount", "return_rate"]
AVG_RANK = "rank() OVER (PARTITION BY {by} ORDER BY {v}) + (count(*) OVER (PARTITION BY {by}, {v}) - 1) / 2.0"


def sql_rank(value: str, by: str = "1", pct: bool = True) -> str:
    """Average rank as window functions; null for null."""
    r = AVG_RANK.format(by=by, v=value)
    return f"CASE WHEN {value} IS NOT NULL THEN ({r}){f' / count({value}) OVER (PARTITION BY {by})' if pct else ''} END"


#: The normal quantile's rational approximation, as in functions.expressions.
def probit_sql(p: str) -> str:
    from panelforge.functions import expressions as E

    horner = lambda cs, x: "(" * (len(cs) - 1) + f"({cs[0]!r}::DOUBLE)" + "".join(f" * {x} + ({c!r}::DOUBLE))" for c in cs[1:])
    q2 = f"(({p} - 0.5) * ({p} - 0.5))"
    tail = lambda x: f"sqrt(-2 * ln({x}))"
    return (
        f"CASE WHEN {p} < 0.02425 THEN {horner(E._C, tail(p))} / {horner((*E._D, 1.0), tail(p))} WHEN {p} > 0.97575 THEN -{horner(E._C, tail(f'(1 - {p})'))} / {horner((*E._D, 1.0), tail(f'(1 - {p})'))} "
        f"WHEN {p} IS NOT NULL THEN {horner(E._A, q2)} * ({p} - 0.5) / {horner((*E._B, 1.0), q2)} END"
    )


def rank_global(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_totalprice")
    out = R.with_rank(orders, "o_totalprice", out="rank")
    rows = orders.agg(F.count("o_totalprice").alias("_n"))
    return out.crossJoin(F.broadcast(rows)).select("o_orderkey", "rank", F.round(F.col("rank") / F.col("_n"), 6).alias("pct"))


RANK_GLOBAL = f"SELECT o_orderkey, {sql_rank('o_totalprice', pct=False)} AS rank, ROUND({sql_rank('o_totalprice')}, 6) AS pct FROM orders"


def rank_descending(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag")
    return R.with_rank(lines, "l_quantity", ["l_returnflag"], "rank", descending=True).groupBy("l_returnflag", "l_quantity").agg(F.max("rank").alias("rank"), F.count(F.lit(1)).alias("n"))


RANK_DESCENDING = f"SELECT l_returnflag, l_quantity, max(c - r + 1) AS rank, count(*) AS n FROM (SELECT l_returnflag, l_quantity, {sql_rank('l_quantity', 'l_returnflag', False)} AS r, count(*) OVER (PARTITION BY l_returnflag) AS c FROM lineitem) GROUP BY ALL"


def _norm(method, by=None, inverse=None):
    def query(spark, sf_dir):
        out = S.normalised(settled(long_panel(entity_panel(spark, sf_dir)), "cells"), method, by, inverse)
        return rounded(out.select("entity_id", "indicator", "norm"))

    return query


FLIP = f"indicator IN ({', '.join(f"'{i}'" for i in INVERSE)})"
NRM_ZSCORE = f"{LONG_SQL}, n AS (SELECT *, (value - avg(value) OVER (PARTITION BY indicator)) / (stddev_samp(value) OVER (PARTITION BY indicator) + 1e-10) AS z FROM cells) SELECT entity_id, indicator, round(CASE WHEN {FLIP} THEN -z ELSE z END, 5) AS norm FROM n"
NRM_ZSCORE_SECTOR = f"{LONG_SQL} SELECT entity_id, indicator, round((value - avg(value) OVER w) / (stddev_samp(value) OVER w + 1e-10), 5) AS norm FROM cells WINDOW w AS (PARTITION BY indicator, sector)"
NRM_MINMAX = f"{LONG_SQL}, n AS (SELECT *, (value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w) AS z FROM cells WINDOW w AS (PARTITION BY indicator)) SELECT entity_id, indicator, round(CASE WHEN {FLIP} THEN 1 - z ELSE z END, 5) AS norm FROM n"
NRM_PERCENTILE = f"{LONG_SQL}, n AS (SELECT *, 100 * ({sql_rank('value', 'indicator')}) AS z FROM cells) SELECT entity_id, indicator, round(CASE WHEN {FLIP} THEN 100 - z ELSE z END, 5) AS norm FROM n"
ROBUST_SQL = """med AS (SELECT indicator, quantile_cont(value, 0.5) AS med, avg(value) AS m, stddev_pop(value) AS sd FROM cells GROUP BY indicator),
mad AS (SELECT indicator, quantile_cont(abs(value - med), 0.5) AS mad FROM cells JOIN med USING (indicator) GROUP BY indicator),
robust AS (SELECT cells.*, least(3, greatest(-3, CASE WHEN mad > 1e-10 THEN (value - med) / (1.4826 * mad) WHEN sd > 1e-10 THEN (value - m) / sd ELSE 0 END)) AS z FROM cells JOIN med USING (indicator) JOIN mad USING (indicator))"""
NRM_ROBUST = f"{LONG_SQL}, {ROBUST_SQL} SELECT entity_id, indicator, round(CASE WHEN value IS NULL THEN NULL ELSE z END, 5) AS norm FROM robust"


def nrm_orthogonal(spark, sf_dir):
    p = S.orthogonalised(entity_panel(spark, sf_dir), "momentum", "mean_discount", "x")
    return rounded(p.select("entity_id", "x"), 6)


NRM_ORTHOGONAL = f"WITH {PANEL_SQL}, b AS (SELECT covar_samp(momentum, mean_discount) / var_samp(mean_discount) AS b FROM panel WHERE momentum IS NOT NULL AND mean_discount IS NOT NULL) SELECT entity_id, round(momentum - b * mean_discount, 6) AS x FROM panel, b"


def nrm_normal_scores(spark, sf_dir):
    return rounded(S.normal_scores(entity_panel(spark, sf_dir), "revenue", "z", ["sector"]).select("entity_id", "z"), 6)


NRM_NORMAL = f"WITH {PANEL_SQL}, r AS (SELECT entity_id, least(0.99, greatest(0.01, {sql_rank('revenue', 'sector')})) AS p0, revenue FROM panel), q AS (SELECT entity_id, CASE WHEN revenue IS NOT NULL THEN p0 END AS p FROM r) SELECT entity_id, round({probit_sql('p')}, 6) AS z FROM q"


def nrm_adaptive(spark, sf_dir):
    return rounded(S.adaptive_z(long_panel(entity_panel(spark, sf_dir), ["revenue", "balance_ratio", "mean_discount"]), INVERSE).select("entity_id", "indicator", "norm"))


NRM_ADAPTIVE = f"""WITH {PANEL_SQL}, cells AS ({long_sql(["revenue", "balance_ratio", "mean_discount"])}), {ROBUST_SQL},
s AS (SELECT indicator, count(value) AS n, skewness(value) * (count(value) - 2) / sqrt(count(value) * (count(value) - 1)) AS g, avg(value) AS m, stddev_samp(value) AS sd FROM cells GROUP BY indicator),
r AS (SELECT robust.*, least(0.99, greatest(0.01, {sql_rank("value", "indicator")})) AS p FROM robust),
z AS (SELECT entity_id, indicator, CASE WHEN value IS NULL THEN 0 ELSE least(3, greatest(-3, CASE WHEN n < 20 OR abs(g) > 2 THEN {probit_sql("p")} WHEN n < 100 THEN z WHEN sd > 1e-10 THEN (value - s.m) / s.sd ELSE 0 END)) END AS z FROM r JOIN s USING (indicator))
SELECT entity_id, indicator, round(CASE WHEN {FLIP} THEN -z ELSE z END, 5) AS norm FROM z"""


def nrm_standardised(spark, sf_dir):
    return rounded(S.standardised(entity_panel(spark, sf_dir), ["revenue", "momentum"]).select("entity_id", "revenue", "momentum"))


def std_sql(c: str) -> str:
    return f"CASE WHEN {c} IS NOT NULL THEN least(100, greatest(0, 50 + 10 * ({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER ())) END"


NRM_STANDARDISED = f"WITH {PANEL_SQL} SELECT entity_id, round({std_sql('revenue')}, 5) AS revenue, round({std_sql('momentum')}, 5) AS momentum FROM panel"

PILLARS = {"activity": {"volume": (0.6, ["n_orders", "quantity"]), "value": (0.4, ["revenue", "mean_order"])}, "care": {"price": (0.5, ["mean_discount", "unit_price"]), "returns": (0.5, ["return_rate"])}}


def _zwide(spark, sf_dir):
    panel = entity_panel(spark, sf_dir)
    long = S.normalised(long_panel(panel), "zscore", inverse=INVERSE)
    return S.wide_norms(long, ["entity_id", "sector", "country"], INDICATORS)


ZWIDE_SQL = f"""{LONG_SQL}, n AS (SELECT *, (value - avg(value) OVER (PARTITION BY indicator)) / (stddev_samp(value) OVER (PARTITION BY indicator) + 1e-10) AS z FROM cells),
zw AS (SELECT entity_id, sector, country, {", ".join(f"max(CASE WHEN indicator = '{i}' THEN {'-' if i in INVERSE else ''}z END) AS {i}" for i in INDICATORS)} FROM n GROUP BY entity_id, sector, country)"""
_mean = lambda cols: f"(({' + '.join(f'coalesce({c}, 0)' for c in cols)}) / nullif({' + '.join(f'({c} IS NOT NULL)::INT' for c in cols)}, 0))"


def scr_pillars(spark, sf_dir):
    out = S.pillar_scores(_zwide(spark, sf_dir), PILLARS)
    return rounded(out.select("entity_id", "activity_score", "activity_coverage", "care_score", "care_coverage"))


def _pillar_sql(p: str) -> str:
    cats = PILLARS[p].values()
    top = " + ".join(f"coalesce({w} * {_mean(c)}, 0)" for w, c in cats)
    low = " + ".join(f"CASE WHEN {_mean(c)} IS NOT NULL THEN {w} ELSE 0 END" for w, c in cats)
    every = [c for _, cols in cats for c in cols]
    score = f"({top}) / nullif({low}, 0)"
    return f"CASE WHEN {score} IS NOT NULL THEN least(100, greatest(0, 50 + 20 * ({score}))) END AS {p}_score, ({' + '.join(f'({c} IS NOT NULL)::INT' for c in every)}) / {len(every)}.0 AS {p}_coverage"


PILLARS_SQL = f"{ZWIDE_SQL}, pillars AS (SELECT entity_id, sector, country, {_pillar_sql('activity')}, {_pillar_sql('care')} FROM zw)"
SCR_PILLARS = f"{PILLARS_SQL} SELECT entity_id, round(activity_score, 5) AS activity_score, round(activity_coverage, 5) AS activity_coverage, round(care_score, 5) AS care_score, round(care_coverage, 5) AS care_coverage FROM pillars"
SECTOR_WEIGHTS = [("BUILDING", 0.7, 0.3), ("MACHINERY", 0.2, 0.8)]


def _composite(spark, sf_dir):
    w = spark.createDataFrame(SECTOR_WEIGHTS, "sector string, activity_score double, care_score double")
    return S.composite(S.pillar_scores(_zwide(spark, sf_dir), PILLARS), w, "sector", ["activity_score", "care_score"])


COMPOSITE_SQL = f"""{PILLARS_SQL}, comp AS (SELECT *, (coalesce(activity_score * wa, 0) + coalesce(care_score * wc, 0)) / nullif(CASE WHEN activity_score IS NULL THEN 0 ELSE wa END + CASE WHEN care_score IS NULL THEN 0 ELSE wc END, 0) AS composite
  FROM (SELECT *, CASE sector WHEN 'BUILDING' THEN 0.7::DOUBLE WHEN 'MACHINERY' THEN 0.2::DOUBLE ELSE 0.5::DOUBLE END AS wa, CASE sector WHEN 'BUILDING' THEN 0.3::DOUBLE WHEN 'MACHINERY' THEN 0.8::DOUBLE ELSE 0.5::DOUBLE END AS wc FROM pillars))"""


def scr_composite(spark, sf_dir):
    return rounded(_composite(spark, sf_dir).select("entity_id", "composite"))


SCR_COMPOSITE = f"{COMPOSITE_SQL} SELECT entity_id, round(composite, 5) AS composite FROM comp"


def scr_shrunk(spark, sf_dir):
    c = _composite(spark, sf_dir).withColumn("confidence", F.when(F.col("country") == "ASIA", 0.2).otherwise(0.9))
    c = settled(c.select("entity_id", "sector", "composite", "confidence"), "composites")
    return rounded(S.shrunk(c, "composite", "confidence", "sector", "shrunk").select("entity_id", "shrunk"))


SCR_SHRUNK = f"{COMPOSITE_SQL}, m AS (SELECT sector, quantile_cont(composite, 0.5) AS med FROM comp GROUP BY sector) SELECT entity_id, round(CASE WHEN c < 0.4 THEN c * composite + (1 - c) * coalesce(med, (SELECT quantile_cont(composite, 0.5) FROM comp)) ELSE composite END, 5) AS shrunk FROM (SELECT *, CASE WHEN country = 'ASIA' THEN 0.2::DOUBLE ELSE 0.9::DOUBLE END AS c FROM comp LEFT JOIN m USING (sector))"


def scr_harmonised(spark, sf_dir):
    return rounded(S.harmonised(entity_panel(spark, sf_dir).select("entity_id", "country", "mean_order"), "mean_order", "country", "score").select("entity_id", "score"), 3)


SCR_HARMONISED = f"""WITH {PANEL_SQL}, r AS (SELECT *, least(0.99, greatest(0.01, {sql_rank("mean_order", "country")})) AS p, count(mean_order) OVER (PARTITION BY country) AS n, avg(mean_order) OVER () AS m, stddev_samp(mean_order) OVER () AS sd FROM panel)
SELECT entity_id, round(CASE WHEN mean_order IS NULL THEN NULL WHEN n >= 5 THEN m + sd * ({probit_sql("p")}) ELSE mean_order END, 3) AS score FROM r"""


def scr_category(spark, sf_dir):
    """Weighted category score with nulls as 0, and the mean of what is there."""
    w = {"revenue": 0.5, "momentum": 0.3, "return_rate": 0.2}
    z = _zwide(spark, sf_dir)
    return rounded(z.select("entity_id", S.weighted_mean(w, "zero").alias("zero_filled"), S.weighted_mean(w).alias("renormalised"), S.row_mean(list(w)).alias("plain")))


SCR_CATEGORY = f"""{ZWIDE_SQL} SELECT entity_id, round(coalesce(revenue, 0) * 0.5 + coalesce(momentum, 0) * 0.3 + coalesce(return_rate, 0) * 0.2, 5) AS zero_filled,
  round((coalesce(revenue, 0) * 0.5 + coalesce(momentum, 0) * 0.3 + coalesce(return_rate, 0) * 0.2) / nullif(CASE WHEN revenue IS NULL THEN 0 ELSE 0.5 END + CASE WHEN momentum IS NULL THEN 0 ELSE 0.3 END + CASE WHEN return_rate IS NULL THEN 0 ELSE 0.2 END, 0), 5) AS renormalised,
  round({_mean(["revenue", "momentum", "return_rate"])}, 5) AS plain FROM zw"""


def scr_sector_blend(spark, sf_dir):
    panel = entity_panel(spark, sf_dir).withColumn("score", F.col("mean_discount") * 1500)
    return rounded(S.sector_blend(panel, "score", "sector", "blend").select("entity_id", "blend"))


SCR_SECTOR_BLEND = f"WITH {PANEL_SQL} SELECT entity_id, round(least(100, greatest(0, 0.7::DOUBLE * 1500 * mean_discount + 30 * coalesce({sql_rank('mean_discount', 'sector')}, 0.5))) + 0 * mean_discount, 5) AS blend FROM panel"


def scr_sector_position(spark, sf_dir):
    return rounded(S.sector_position(entity_panel(spark, sf_dir), ["revenue", "momentum", "unit_price", "return_rate"], "sector", "entity_id"))


SCR_SECTOR_POSITION = f"""WITH {PANEL_SQL}, cells AS ({long_sql(["revenue", "momentum", "unit_price", "return_rate"])}), s AS (SELECT indicator, sector, quantile_cont(value, 0.5) AS med, stddev_samp(value) AS sd FROM cells GROUP BY ALL),
m AS (SELECT entity_id, sector, avg((value - med) / CASE WHEN sd > 1e-10 THEN sd END) AS z FROM cells JOIN s USING (indicator, sector) GROUP BY ALL)
SELECT entity_id, sector, round(coalesce({sql_rank("z", "sector")}, 0.5), 5) AS sector_position FROM m"""
FACTORS = ["revenue", "momentum", "unit_price", "return_rate", "urgent_share"]
PROFILES = {"growth": {"revenue": 2.0, "momentum": 6.0, "unit_price": 2.0}, "steady": {"revenue": 3.0, "return_rate": 4.0, "urgent_share": 3.0}, "even": {f: 1.0 for f in FACTORS}}


def _preference(spark, sf_dir, mode="rank"):
    return S.preference(S.factor_norms(entity_panel(spark, sf_dir), "entity_id", FACTORS, mode), "entity_id", PROFILES)


FILLED_SQL = f"""WITH {PANEL_SQL}, full_panel AS (SELECT entity_id, sector, {", ".join(f"coalesce({f}, (SELECT quantile_cont({f}, 0.5) FROM panel)) AS {f}" for f in FACTORS)} FROM panel)"""
RANKED_SQL = f"{FILLED_SQL}, f AS (SELECT entity_id, sector, {', '.join(f'100 * ({sql_rank(x)}) AS {x}' for x in FACTORS)} FROM full_panel)"
EQUAL_SQL = f"{FILLED_SQL}, f AS (SELECT entity_id, sector, {', '.join(f'50 + 10 * ({x} - avg({x}) OVER ()) / stddev_samp({x}) OVER () AS {x}' for x in FACTORS)} FROM full_panel)"
PREF_ROWS = " UNION ALL ".join(f"SELECT entity_id, sector, '{n}' AS profile, {' + '.join(f'{x} * {w / sum(ws.values())!r}::DOUBLE' for x, w in ws.items())} AS score FROM f" for n, ws in PROFILES.items())
PREF_SQL = f"{RANKED_SQL}, pref AS ({PREF_ROWS})"


def pref_scores(spark, sf_dir):
    return rounded(_preference(spark, sf_dir), 4)


PREF_SCORES = f"{PREF_SQL} SELECT entity_id, profile, round(score, 4) AS score FROM pref"


def pref_equalized(spark, sf_dir):
    return rounded(_preference(spark, sf_dir, "variance_equalized"), 4)


PREF_EQUALIZED = f"{EQUAL_SQL}, pref AS ({PREF_ROWS}) SELECT entity_id, profile, round(score, 4) AS score FROM pref"


def pref_top(spark, sf_dir):
    scores = _preference(spark, sf_dir).withColumn("score", F.round("score", 8))
    return rounded(R.top(scores, "score", "entity_id", 20, ["profile"]), 4)


PREF_TOP = f"{PREF_SQL}, r AS (SELECT entity_id, profile, ROUND(score, 8) AS score FROM pref) SELECT entity_id, profile, round(score, 4) AS score, row_number() OVER (PARTITION BY profile ORDER BY score DESC, entity_id)::INT AS position FROM r QUALIFY row_number() OVER (PARTITION BY profile ORDER BY score DESC, entity_id) <= 20"


def pref_best_profile(spark, sf_dir):
    scores = _preference(spark, sf_dir).withColumn("score", F.round("score", 8))
    return scores.groupBy("entity_id").agg(F.max(F.struct("score", "profile")).alias("b")).groupBy(F.col("b.profile").alias("profile")).agg(F.count(F.lit(1)).alias("n"))


PREF_BEST = f"{PREF_SQL}, r AS (SELECT entity_id, profile FROM pref QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY ROUND(score, 8) DESC, profile DESC) = 1) SELECT profile, count(*) AS n FROM r GROUP BY profile"


def pref_gated(spark, sf_dir):
    s = _preference(spark, sf_dir).where("profile = 'even'").join(entity_panel(spark, sf_dir).select("entity_id", "revenue"), "entity_id")
    return rounded(S.gated(s, "score", "revenue").select("entity_id", "gated"), 4)


PREF_GATED = f"{PREF_SQL} SELECT entity_id, round(CASE WHEN coalesce(revenue, '-infinity'::DOUBLE) < (SELECT quantile_cont(revenue, 0.3) FROM panel) THEN 0 ELSE 100 * pow(least(100, greatest(0, score)) / 100, 1.5) END, 4) AS gated FROM pref JOIN panel USING (entity_id) WHERE profile = 'even'"


def pref_without_factor(spark, sf_dir):
    """Scores of a profile with one factor taken out, and the change of rank."""
    norms = S.factor_norms(entity_panel(spark, sf_dir), "entity_id", FACTORS, "rank")
    scores = S.preference(norms, "entity_id", {"with": PROFILES["growth"], "without": S.without_factor(PROFILES["growth"], "momentum")}).withColumn("score", F.round("score", 8))
    ranked = R.with_rank(scores, "score", ["profile"], "rank", descending=True)
    return ranked.groupBy("entity_id").agg((F.max(F.when(F.col("profile") == "with", F.col("rank"))) - F.max(F.when(F.col("profile") == "without", F.col("rank")))).alias("change"))


PREF_WITHOUT = f"""{RANKED_SQL}, s AS (SELECT entity_id, ROUND(revenue * 0.2::DOUBLE + momentum * 0.6::DOUBLE + unit_price * 0.2::DOUBLE, 8) AS a, ROUND(revenue * 0.5::DOUBLE + unit_price * 0.5::DOUBLE, 8) AS b FROM f)
SELECT entity_id, (rank() OVER (ORDER BY a DESC) + (count(*) OVER (PARTITION BY a) - 1) / 2.0) - (rank() OVER (ORDER BY b DESC) + (count(*) OVER (PARTITION BY b) - 1) / 2.0) AS change FROM s"""


def flagship(spark, sf_dir):
    """Panel to preference ranks: coverage filter, group-median fill, caps, robust z, two-level score, 50/10 standardising, top 20."""
    # Every frame that several passes read is written once.
    cells = settled(long_panel(enough_coverage(entity_panel(spark, sf_dir), INDICATORS, 0.5)), "cells")
    filled = settled(filled_by_group(cells, "sector").drop("filled"), "filled")
    z = S.robust_z(settled(quantile_clipped(filled, 0.01, 0.99, ["indicator"]), "clipped"), ["indicator"])
    z = z.withColumn("norm", F.when(F.col("indicator").isin(INVERSE), -F.col("norm")).otherwise(F.col("norm")))
    scores = S.pillar_scores(S.wide_norms(z, ["entity_id", "sector"], INDICATORS), PILLARS)
    scores = S.standardised(scores, ["activity_score", "care_score"]).withColumn("score", F.round(0.6 * F.col("activity_score") + 0.4 * F.col("care_score"), 6))
    return R.top(scores.select("entity_id", "sector", "score"), "score", "entity_id", 20)


QUERIES = {
    "flagship": (flagship, None),
    "rank_global": (rank_global, RANK_GLOBAL),
    "rank_descending": (rank_descending, RANK_DESCENDING),
    "nrm_zscore": (_norm("zscore", None, INVERSE), NRM_ZSCORE),
    "nrm_zscore_by_sector": (_norm("zscore", ["sector"]), NRM_ZSCORE_SECTOR),
    "nrm_minmax": (_norm("minmax", None, INVERSE), NRM_MINMAX),
    "nrm_percentile": (_norm("percentile", None, INVERSE), NRM_PERCENTILE),
    "nrm_robust": (_norm("robust"), NRM_ROBUST),
    "nrm_orthogonal": (nrm_orthogonal, NRM_ORTHOGONAL),
    "nrm_normal_scores": (nrm_normal_scores, NRM_NORMAL),
    "nrm_adaptive": (nrm_adaptive, NRM_ADAPTIVE),
    "nrm_standardised": (nrm_standardised, NRM_STANDARDISED),
    "scr_pillars": (scr_pillars, SCR_PILLARS),
    "scr_composite": (scr_composite, SCR_COMPOSITE),
    "scr_shrunk": (scr_shrunk, SCR_SHRUNK),
    "scr_harmonised": (scr_harmonised, SCR_HARMONISED),
    "scr_category": (scr_category, SCR_CATEGORY),
    "scr_sector_blend": (scr_sector_blend, SCR_SECTOR_BLEND),
    "scr_sector_position": (scr_sector_position, SCR_SECTOR_POSITION),
    "pref_scores": (pref_scores, PREF_SCORES),
    "pref_equalized": (pref_equalized, PREF_EQUALIZED),
    "pref_top": (pref_top, PREF_TOP),
    "pref_best_profile": (pref_best_profile, PREF_BEST),
    "pref_gated": (pref_gated, PREF_GATED),
    "pref_without_factor": (pref_without_factor, PREF_WITHOUT),
}
