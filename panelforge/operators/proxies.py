"""Proxies of indicators: percentiles of entities in a reference distribution, comparison with real values, validation on held-out entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions.expressions import clip
from panelforge.functions.skew import join_counted
from panelforge.functions.tables import settled
from panelforge.operators.draws import value_counts
from panelforge.operators.inference import adjusted_p, kendall, rank_correlation, two_sample_ks

#: Rows of either kind without which a comparison is not made, and both together for its rank correlation.
LEAST_REAL, LEAST_BOTH = 5, 10
SIGNIFICANT = 0.05


def placed_among(outside: DataFrame, reference: DataFrame, by: list[str], value: str, low: float = 5.0, high: float = 95.0, least: int = 2, default: float = 50.0) -> DataFrame:
    """outside with ``placed``: 100 times the share of the reference rows of its group that are smaller or (by half) equal, clipped to [low, high].

    Both frames are merged in one order of (group, value) by ranges and the reference rows below counted along it, so neither is collected. The default in
    groups of fewer than ``least`` reference rows; null for a null value."""
    names = settled(outside.select(*by).union(reference.select(*by)).distinct(), "groups")  # a row for each group
    number = names.withColumn("_g", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*by)).cast("int"))
    both = [reference.select(*by, F.col(value).alias("_v"), F.array(F.lit(1), F.lit(0)).alias("draws")), outside.select(*by, F.col(value).alias("_v"), F.array(F.lit(0), F.lit(1)).alias("draws"))]
    number = settled(number, "numbers")
    same = lambda a, b: [a[c].eqNullSafe(b[c]) for c in by]
    merged = both[0].unionByName(both[1])
    rows = merged.join(number, same(merged, number)).select("_g", "_v", "draws")
    counts = value_counts(settled(rows, "merged"), "_v", "_g").select(F.col("part").alias("_g"), F.col("value").alias("_v"), F.get("below", F.lit(0)).alias("_below"), F.get("own", F.lit(0)).alias("_own"), F.get("own", F.lit(1)).alias("_outside"))
    sizes = counts.groupBy("_g").agg(F.sum("_own").alias("_n"))
    base = settled(sizes.withColumn("_base", F.sum("_n").over(Window.partitionBy(F.lit(1)).orderBy("_g")) - F.col("_n")), "sizes")  # a row for each group
    share = 100 * (F.col("_below") - F.col("_base") + F.col("_own") / 2) / F.col("_n")
    placed = F.when(F.col("_n") >= least, clip(share, low, high)).otherwise(default)
    place = settled(counts.where("_outside > 0").join(base, "_g").select("_g", "_v", placed.alias("placed"), "_outside"), "places")
    total = place.agg(F.sum("_outside")).head()[0] or 0
    own = outside.join(number, same(outside, number)).select(*[outside[c] for c in outside.columns], "_g", F.col(value).cast("double").alias("_v"))
    found = join_counted(own.where("_v is not null"), place, ["_g", "_v"], "_outside", int(total)).select(*outside.columns, "placed")
    return found.unionByName(own.where("_v is null").select(*outside.columns, F.lit(None).cast("double").alias("placed")))


def effect_label(d: Column) -> Column:
    size = F.abs(d)
    return F.when(d.isNull(), "N/A").when(size < 0.2, "negligible").when(size < 0.5, "small").when(size < 0.8, "medium").otherwise("large")


def _effect(n1: Column, n2: Column, v1: Column, v2: Column, gap: Column) -> Column:
    pooled = ((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)
    return F.when((n1 >= 2) & (n2 >= 2) & (pooled > 0), gap / F.sqrt(pooled))


def calibration(long: DataFrame, indicators: list[str]) -> DataFrame:
    """Real against proxy values of each indicator, from rows (indicator, value, proxy): a row per indicator.

    (indicator, n_real, n_proxy, mean_real, mean_proxy, d, effect, ks, ks_p, rho, p, low, high, tau, p_adjusted, significant, note): rho and tau are between
    the value and whether it is a proxy, so they should be near 0. Without LEAST_REAL rows of either kind only the counts are given."""
    rows = settled(long.where("value is not null").select("indicator", F.col("value").cast("double").alias("value"), F.col("proxy").cast("boolean").alias("proxy")), "values")
    pick = lambda c, f: f(F.when(c, F.col("value")))
    real, made = ~F.col("proxy"), F.col("proxy")
    s = rows.groupBy("indicator").agg(
        pick(real, F.count).alias("n_real"), pick(made, F.count).alias("n_proxy"), pick(real, F.avg).alias("mean_real"), pick(made, F.avg).alias("mean_proxy"),
        pick(real, F.var_samp).alias("_v1"), pick(made, F.var_samp).alias("_v2"),
    )
    d = _effect(F.col("n_real"), F.col("n_proxy"), F.col("_v1"), F.col("_v2"), F.col("mean_real") - F.col("mean_proxy"))
    rho = rank_correlation(rows.select("indicator", F.col("value").alias("x"), F.col("proxy").cast("double").alias("y")), ["indicator"]).where(F.col("n") >= LEAST_BOTH).drop("n")
    each = [_each(rows.where(F.col("indicator") == i), i) for i in indicators]  # a few indicators
    tests = each[0]
    for t in each[1:]:
        tests = tests.unionByName(t)
    enough = (F.col("n_real") >= LEAST_REAL) & (F.col("n_proxy") >= LEAST_REAL)
    joined = settled(s.withColumn("d", d).join(rho, "indicator", "left").join(tests, "indicator", "left").withColumn("_enough", enough), "calibration")
    shown = [F.when(F.col("_enough"), F.col(c)).alias(c) for c in ("mean_real", "mean_proxy", "d", "ks", "ks_p", "rho", "p", "low", "high", "tau")]
    out = adjusted_p(settled(joined.select("indicator", "n_real", "n_proxy", *shown), "tests")).drop("bonferroni").withColumnRenamed("bh", "p_adjusted")
    note = F.when(F.col("p").isNull(), "insufficient data").when(F.col("p") < SIGNIFICANT, "proxies are offset").otherwise("proxies lie where real values do")
    return out.withColumns({"p_adjusted": F.when(F.col("p").isNotNull(), F.col("p_adjusted")), "effect": effect_label(F.col("d")), "significant": F.col("p_adjusted") < SIGNIFICANT, "note": note})


def _each(rows: DataFrame, indicator: str) -> DataFrame:
    ks = two_sample_ks(rows, "value", ~F.col("proxy")).select(F.col("d").alias("ks"), F.col("p").alias("ks_p"))
    tau = kendall(rows.withColumn("_p", F.col("proxy").cast("double")), "value", "_p").select(F.col("tau_b").alias("tau"))
    return ks.crossJoin(F.broadcast(tau)).select(F.lit(indicator).alias("indicator"), "ks", "ks_p", "tau")  # one row each


def held_out_validation(long: DataFrame, indicators: list[str]) -> DataFrame:
    """Recomputed proxies of entities with real values against these, from rows (indicator, real, proxy): a row per indicator.

    (indicator, n, rho, p, low, high, tau, tau_p, d, effect, mean_real, mean_proxy, p_adjusted, significant, note); rows without either value are left out,
    below LEAST_REAL rows only n is given."""
    rows = settled(long.where("real is not null and proxy is not null").select("indicator", F.col("real").cast("double").alias("x"), F.col("proxy").cast("double").alias("y")), "both")
    s = rows.groupBy("indicator").agg(F.avg("x").alias("mean_real"), F.avg("y").alias("mean_proxy"), F.var_samp("x").alias("_v1"), F.var_samp("y").alias("_v2"), F.count(F.lit(1)).alias("_n"))
    d = _effect(F.col("_n"), F.col("_n"), F.col("_v1"), F.col("_v2"), F.col("mean_real") - F.col("mean_proxy"))
    taus = [kendall(rows.where(F.col("indicator") == i), "x", "y").select(F.lit(i).alias("indicator"), F.col("tau_b").alias("tau"), F.col("p").alias("tau_p")) for i in indicators]
    tau = taus[0]
    for t in taus[1:]:
        tau = tau.unionByName(t)
    joined = settled(rank_correlation(rows, ["indicator"]).join(s.withColumn("d", d), "indicator").join(tau, "indicator", "left"), "validation")
    enough = F.col("n") >= LEAST_REAL
    shown = [F.when(enough, F.col(c)).alias(c) for c in ("rho", "p", "low", "high", "tau", "tau_p", "d", "mean_real", "mean_proxy")]
    out = adjusted_p(settled(joined.select("indicator", "n", *shown), "tests")).drop("bonferroni").withColumnRenamed("bh", "p_adjusted")
    note = F.when(F.col("p").isNull(), "too few real values").when(F.col("p") >= SIGNIFICANT, "ordering not validated").when(F.col("rho") > 0, "agrees with real").otherwise("inverse to real")
    return out.withColumns({"p_adjusted": F.when(F.col("p").isNotNull(), F.col("p_adjusted")), "effect": effect_label(F.col("d")), "significant": F.col("p_adjusted") < SIGNIFICANT, "note": note})
