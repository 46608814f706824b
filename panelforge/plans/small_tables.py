"""Registered queries: other similarities, plausibility tables, codes and agreements."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelforge.functions.tables import settled
from panelforge.operators import inference as I
from panelforge.operators import similarity as M
from panelforge.operators.ranking import quantiles, top, with_rank
from panelforge.plans.clean import CELLS_SQL, rounded
from panelforge.plans.score import PREF_SQL, _preference, sql_rank
from panelforge.sources.panels import PANEL_SQL, entity_panel, long_panel

WEIGHTS = [1.0 + (i % 4) for i in range(64)]
_VECTORS = f"n AS (SELECT vec_id, list_transform(embedding, lambda x, i: x::DOUBLE * (1 + (i - 1) % 4)) AS e FROM embeddings)"


def sim_euclidean(spark, sf_dir):
    """Five nearest by distance, dimensions weighted."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return rounded(M.nearest(e, "vec_id", "embedding", 5, metric="euclidean", weights=WEIGHTS), 5)


SIM_EUCLIDEAN = f"""WITH {_VECTORS}, p AS (SELECT a.vec_id, b.vec_id AS peer, ROUND(1 / (1 + list_distance(a.e, b.e)), 9) AS similarity FROM n a JOIN n b ON a.vec_id <> b.vec_id)
SELECT vec_id, peer, round(similarity, 5) AS similarity FROM p QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY similarity DESC, peer) <= 5"""


def sim_jaccard(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return rounded(M.nearest(e, "vec_id", "embedding", 5, metric="jaccard"), 5)


SIM_JACCARD = """WITH n AS (SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1.0::DOUBLE ELSE 0 END) AS e FROM embeddings), c AS (SELECT vec_id, e, list_sum(e) AS s FROM n),
p AS (SELECT a.vec_id, b.vec_id AS peer, list_inner_product(a.e, b.e) AS i, a.s + b.s AS s FROM c a JOIN c b ON a.vec_id <> b.vec_id), q AS (SELECT vec_id, peer, ROUND(CASE WHEN s > i THEN i / (s - i) ELSE 0 END, 9) AS similarity FROM p)
SELECT vec_id, peer, round(similarity, 5) AS similarity FROM q QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY similarity DESC, peer) <= 5"""
EXPECTED = [("BUILDING", 0.2, 0.3), ("MACHINERY", 0.3, 0.4), ("AUTOMOBILE", 0.2, 0.4)]


def agg_sector_economics(spark, sf_dir):
    """Sector means of two measures and whether one lies in the range expected of the sector (null without one)."""
    means = entity_panel(spark, sf_dir).groupBy("sector").agg(F.count(F.lit(1)).alias("n"), F.avg("return_rate").alias("return_rate"), F.avg("mean_order").alias("mean_order"))
    ranges = spark.createDataFrame(EXPECTED, "sector string, low double, high double")
    return rounded(means.join(F.broadcast(ranges), "sector", "left").withColumn("in_range", F.col("return_rate").between(F.col("low"), F.col("high"))).drop("low", "high"), 4)


AGG_SECTOR_ECONOMICS = f"""WITH {PANEL_SQL}, e(sector, low, high) AS (VALUES {", ".join(f"('{s}', {a}::DOUBLE, {b}::DOUBLE)" for s, a, b in EXPECTED)}), m AS (SELECT sector, count(*) AS n, avg(return_rate) AS r, avg(mean_order) AS o FROM panel GROUP BY sector)
SELECT sector, n, round(r, 4) AS return_rate, round(o, 4) AS mean_order, r BETWEEN low AND high AS in_range FROM m LEFT JOIN e USING (sector)"""
MEANING = {"revenue": "quantity", "mean_order": "unit_price", "n_orders": "return_rate"}


def agg_factor_meaning(spark, sf_dir):
    """Mean of a measure over the five best and worst entities by a factor, and whether the best have more of it."""
    p = settled(entity_panel(spark, sf_dir), "panel")
    rows = p.select("entity_id", F.explode(F.array(*[F.struct(F.lit(f).alias("factor"), F.col(f).alias("x"), F.col(m).alias("y")) for f, m in MEANING.items()])).alias("s")).select("entity_id", "s.*").where("x is not null")
    end = lambda sign, name: top(rows.withColumn("_x", sign * F.col("x")), "_x", "entity_id", 5, ["factor"]).groupBy("factor").agg(F.avg("y").alias(name))
    both = end(1, "top_mean").join(end(-1, "bottom_mean"), "factor")
    return rounded(both.withColumn("verdict", F.when(F.col("top_mean") > F.col("bottom_mean"), "PASS").otherwise("CHECK")), 4)


_MEANING = " UNION ALL ".join(f"SELECT entity_id, '{f}' AS factor, {f} AS x, {m} AS y FROM panel WHERE {f} IS NOT NULL" for f, m in MEANING.items())
AGG_FACTOR_MEANING = f"""WITH {PANEL_SQL}, r AS ({_MEANING}), k AS (SELECT *, row_number() OVER (PARTITION BY factor ORDER BY x DESC, entity_id) AS a, row_number() OVER (PARTITION BY factor ORDER BY x, entity_id) AS b FROM r), s AS (SELECT factor, avg(y) FILTER (a <= 5) AS t, avg(y) FILTER (b <= 5) AS l FROM k GROUP BY factor)
SELECT factor, round(t, 4) AS top_mean, round(l, 4) AS bottom_mean, CASE WHEN t > l THEN 'PASS' ELSE 'CHECK' END AS verdict FROM s"""


def dq_proxy_coverage(spark, sf_dir):
    """Cells by indicator and origin: number, deviation and interquartile range of their values."""
    real = F.when(F.col("value").isNotNull() & (F.col("entity_id") % 4 != 0), "real").when(F.col("value").isNotNull(), "proxy").otherwise("imputed")
    panel_cells = settled(long_panel(entity_panel(spark, sf_dir)).select("indicator", "value", real.alias("source")), "cells")
    s = panel_cells.groupBy("indicator", "source").agg(F.count(F.lit(1)).alias("n"), F.stddev_samp("value").alias("std"))
    box = quantiles(panel_cells, ["indicator", "source"], "value", {"_a": 0.25, "_b": 0.75})
    return rounded(s.join(box, ["indicator", "source"], "left").select("indicator", "source", "n", "std", (F.col("_b") - F.col("_a")).alias("iqr")), 4)


DQ_PROXY_COVERAGE = f"{CELLS_SQL}, v AS (SELECT indicator, source, value FROM origin JOIN cells USING (entity_id, indicator)) SELECT indicator, source, count(*) AS n, round(stddev_samp(value), 4) AS std, round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 4) AS iqr FROM v GROUP BY ALL"


def dq_result_bounds(spark, sf_dir):
    """Whether results lie within their bounds: correlations in -1..1, shares in 0..1."""
    p = settled(entity_panel(spark, sf_dir), "panel")
    one = p.agg(F.corr("revenue", "quantity").alias("correlation"), F.max("return_rate").alias("largest share"), F.min("mean_discount").alias("least share"))
    rows = one.unpivot([], ["correlation", "largest share", "least share"], "check", "value")
    low = F.when(F.col("check") == "correlation", -1.0).otherwise(0.0)
    return rounded(rows.withColumn("ok", F.col("value").between(low, F.lit(1.0))))


DQ_RESULT_BOUNDS = f"""WITH {PANEL_SQL}, r AS (SELECT 'correlation' AS "check", corr(revenue, quantity) AS value, -1 AS low FROM panel UNION ALL SELECT 'largest share', max(return_rate), 0 FROM panel UNION ALL SELECT 'least share', min(mean_discount), 0 FROM panel) SELECT "check", round(value, 5) AS value, value BETWEEN low AND 1 AS ok FROM r"""
COUNTRIES = {"UNITED STATES": "US", "INDIA": "IN", "UNITED KINGDOM": "UK"}


def trf_country(spark, sf_dir):
    """Country names brought to codes; of those without one, keys that end in 7 count as IN, the rest as OTHER."""
    c, n = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("customer", "nation"))
    name = F.upper(F.trim("n_name"))
    code = F.lit(None).cast("string")
    for k, v in COUNTRIES.items():
        code = F.when(name == k, v).otherwise(code)
    joined = c.join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return joined.select("c_custkey", F.coalesce(code, F.when(F.col("c_custkey").cast("string").endswith("7"), "IN"), F.lit("OTHER")).alias("country"))


TRF_COUNTRY = f"SELECT c_custkey, coalesce(CASE upper(trim(n_name)) {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in COUNTRIES.items())} END, CASE WHEN ends_with(c_custkey::VARCHAR, '7') THEN 'IN' END, 'OTHER') AS country FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey"
#: Numbers of rating letters.
LETTERS = {"AAA": 7, "AA": 6, "A": 5, "BBB": 4, "BB": 3, "B": 2, "CCC": 1}


def cls_numbers(spark, sf_dir):
    """Rating letters as numbers, and risk scores turned round."""
    from panelforge.operators.cleaning import rating

    p = entity_panel(spark, sf_dir).select("entity_id", (F.col("mean_discount") * 1000).alias("s"))
    number = F.lit(None).cast("int")
    for k, v in LETTERS.items():
        number = F.when(F.col("letter") == k, v).otherwise(number)
    return rounded(p.withColumn("letter", rating(F.col("s"))).select("entity_id", "letter", number.alias("number"), (100 - F.col("s")).alias("inverted")))


CLS_NUMBERS = f"""WITH {PANEL_SQL}, s AS (SELECT entity_id, mean_discount * 1000 AS s FROM panel), l AS (SELECT *, CASE WHEN s >= 60 THEN 'AAA' WHEN s >= 57 THEN 'AA' WHEN s >= 54 THEN 'A' WHEN s >= 50 THEN 'BBB' WHEN s >= 46 THEN 'BB' WHEN s >= 42 THEN 'B' WHEN s IS NOT NULL THEN 'CCC' END AS letter FROM s)
SELECT entity_id, letter, CASE letter {" ".join(f"WHEN '{k}' THEN {v}" for k, v in LETTERS.items())} END AS number, round(100 - s, 5) AS inverted FROM l"""


def corr_profiles(spark, sf_dir):
    """Rank correlation of each pair of profiles' scores and how many of their 20 best they share."""
    scores = settled(_preference(spark, sf_dir).withColumn("score", F.round("score", 8)), "scores")
    a, b = scores.toDF("entity_id", "a", "x"), scores.toDF("entity_id", "b", "y")
    rho = I.rank_correlation(settled(a.join(b, "entity_id").where("a < b"), "pairs"), ["a", "b"]).select("a", "b", "rho")
    best = top(scores, "score", "entity_id", 20, ["profile"]).select("entity_id", "profile")
    shared = best.toDF("entity_id", "a").join(best.toDF("entity_id", "b"), "entity_id").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))
    return rounded(rho.join(shared, ["a", "b"], "left").withColumn("shared", F.coalesce("shared", F.lit(0).cast("bigint"))), 4)


CORR_PROFILES = f"""{PREF_SQL}, s AS (SELECT entity_id, profile, ROUND(score, 8) AS score FROM pref), r AS (SELECT *, {sql_rank("score", "profile", False)} AS r, row_number() OVER (PARTITION BY profile ORDER BY score DESC, entity_id) <= 20 AS best FROM s)
SELECT p.profile AS a, q.profile AS b, round(corr(p.r, q.r), 4) AS rho, sum((p.best AND q.best)::INT)::BIGINT AS shared FROM r p JOIN r q ON p.entity_id = q.entity_id AND p.profile < q.profile GROUP BY ALL"""


def corr_providers(spark, sf_dir):
    """Agreement of own scores with each of two providers' on the entities that both have: Pearson and rank correlation."""
    p = settled(entity_panel(spark, sf_dir).where("revenue is not null").select("entity_id", "revenue", "n_orders", "mean_order"), "panel")
    one = p.where("entity_id % 2 = 0").select("entity_id", F.lit("first").alias("provider"), F.col("n_orders").alias("y"))
    two = p.where("entity_id % 3 = 0").select("entity_id", F.lit("second").alias("provider"), F.col("mean_order").alias("y"))
    rows = settled(p.select("entity_id", F.col("revenue").alias("x")).join(one.unionByName(two), "entity_id"), "pairs")
    ranked = with_rank(with_rank(rows, "x", ["provider"], "_rx"), "y", ["provider"], "_ry")
    return rounded(ranked.groupBy("provider").agg(F.count(F.lit(1)).alias("n"), F.corr("x", "y").alias("pearson"), F.corr("_rx", "_ry").alias("spearman")))


CORR_PROVIDERS = f"""WITH {PANEL_SQL}, r AS (SELECT 'first' AS provider, revenue AS x, n_orders AS y FROM panel WHERE entity_id % 2 = 0 AND revenue IS NOT NULL UNION ALL SELECT 'second', revenue, mean_order FROM panel WHERE entity_id % 3 = 0 AND revenue IS NOT NULL),
k AS (SELECT *, {sql_rank("x", "provider", False)} AS rx, {sql_rank("y", "provider", False)} AS ry FROM r) SELECT provider, count(*) AS n, round(corr(x, y), 5) AS pearson, round(corr(rx, ry), 5) AS spearman FROM k GROUP BY provider"""

QUERIES = {
    "sim_euclidean": (sim_euclidean, SIM_EUCLIDEAN), "sim_jaccard": (sim_jaccard, SIM_JACCARD), "agg_sector_economics": (agg_sector_economics, AGG_SECTOR_ECONOMICS), "agg_factor_meaning": (agg_factor_meaning, AGG_FACTOR_MEANING),
    "dq_proxy_coverage": (dq_proxy_coverage, DQ_PROXY_COVERAGE), "dq_result_bounds": (dq_result_bounds, DQ_RESULT_BOUNDS), "trf_country": (trf_country, TRF_COUNTRY), "cls_numbers": (cls_numbers, CLS_NUMBERS),
    "corr_profiles": (corr_profiles, CORR_PROFILES), "corr_providers": (corr_providers, CORR_PROVIDERS),
}
