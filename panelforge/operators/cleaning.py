"""Outlier flags, caps, imputation and transforms."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.functions.expressions import clip
from panelforge.operators.ranking import median_deviation, medians, quantiles, with_rank

#: What a type's values are capped at: low and high quantiles, or fixed bounds.
CAPS = {"ratio": (0.025, 0.975), "count": (0.01, 0.99), "continuous": (0.01, 0.99)}


def outlier_flags(long: DataFrame, k: float = 1.5, mad_limit: float = 3.5, sigmas: float = 3.0) -> DataFrame:
    """long (indicator, value, ...) with booleans iqr, mad and z; all false for null values and constant columns."""
    box = quantiles(long, ["indicator"], "value", {"_q1": 0.25, "_q3": 0.75})
    middle = median_deviation(long, ["indicator"], "value")
    moments = long.groupBy("indicator").agg(F.avg("value").alias("_m"), F.stddev_samp("value").alias("_s"))
    stats = box.join(middle, "indicator").join(moments, "indicator")
    v, reach = F.col("value"), k * (F.col("_q3") - F.col("_q1"))
    joined = long.join(F.broadcast(stats), "indicator", "left")
    sure = lambda c: F.coalesce(c, F.lit(False))
    flags = {
        "iqr": sure((v < F.col("_q1") - reach) | (v > F.col("_q3") + reach)),
        "mad": sure((F.col("mad") >= 1e-10) & (F.abs(0.6745 * (v - F.col("median")) / F.col("mad")) > mad_limit)),
        "z": sure((F.col("_s") > 0) & (F.abs((v - F.col("_m")) / F.col("_s")) > sigmas)),
    }
    return joined.select(*[long[c] for c in long.columns], *[f.alias(n) for n, f in flags.items()])


def consensus_outliers(long: DataFrame, methods: int = 2) -> DataFrame:
    """(indicator, n, n_iqr, n_mad, n_z, n_consensus): a consensus outlier has at least ``methods`` flags."""
    f = outlier_flags(long)
    votes = F.col("iqr").cast("int") + F.col("mad").cast("int") + F.col("z").cast("int")
    return f.groupBy("indicator").agg(F.count("value").alias("n"), *[F.sum(F.col(c).cast("int")).alias(f"n_{c}") for c in ("iqr", "mad", "z")], F.sum((votes >= methods).cast("int")).alias("n_consensus"))


def mahalanobis(df: DataFrame, columns: list[str], key: str = "entity_id") -> DataFrame:
    """(key, distance) of the rows without nulls: from the column means by the pseudo-inverse of their covariance."""
    whole = df.where(sum((F.col(c).isNull().cast("int") for c in columns), F.lit(0)) == 0)
    aggs = [F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)] + [F.covar_samp(a, b).alias(f"c{i}_{j}") for i, a in enumerate(columns) for j, b in enumerate(columns) if i <= j]
    row = whole.agg(*aggs).head()  # one row of k squared numbers
    k = len(columns)
    cov = np.array([[row[f"c{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)])
    scale = np.sqrt(np.where(np.diag(cov) > 0, np.diag(cov), 1.0))  # so that columns of different size weigh alike
    inverse = np.linalg.pinv(cov / np.outer(scale, scale))
    away = [(F.col(c) - F.lit(float(row[f"m{i}"] or 0.0))) / F.lit(float(scale[i])) for i, c in enumerate(columns)]
    square = sum((away[i] * away[j] * F.lit(float(inverse[i, j])) for i in range(k) for j in range(k)), F.lit(0.0))
    return whole.select(key, F.sqrt(F.greatest(square, F.lit(0.0))).alias("distance"))


def chi_square_cutoff(dimensions: int, level: float) -> float:
    """The quantile of chi-square with a whole number of degrees of freedom, by halving; its distribution function as the series of the incomplete gamma function."""

    def share(x: float) -> float:
        a, y = dimensions / 2, x / 2
        term = total = 1 / a
        k = 0
        while term > 1e-17 * total:
            k += 1
            term *= y / (a + k)
            total += term
        return total * math.exp(-y + a * math.log(y) - math.lgamma(a)) if y > 0 else 0.0

    low, high = 0.0, 10.0 * dimensions + 100
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if share(middle) < level else (low, middle)
    return (low + high) / 2


def mahalanobis_outliers(df: DataFrame, columns: list[str], level: float = 0.975, key: str = "entity_id") -> DataFrame:
    """(key, distance, cutoff, outlier): rows whose squared distance is beyond the chi-square quantile of as many degrees as columns."""
    cutoff = chi_square_cutoff(len(columns), level) ** 0.5
    return mahalanobis(df, columns, key).withColumns({"cutoff": F.lit(cutoff), "outlier": F.col("distance") > cutoff})


def winsorised(long: DataFrame, types: DataFrame) -> DataFrame:
    """long with ``value`` capped by its indicator's type (types: indicator, vtype): binary and ordinal rounded, percentages kept in 0..100, the rest capped at quantiles."""
    q = quantiles(long, ["indicator"], "value", {"_p1": 0.01, "_p25": 0.025, "_p975": 0.975, "_p99": 0.99})
    joined = long.join(F.broadcast(types.select("indicator", "vtype")), "indicator", "left").join(F.broadcast(q), "indicator", "left")
    v, t = F.col("value"), F.coalesce("vtype", F.lit("continuous"))
    low, high = F.when(t == "ratio", F.col("_p25")).otherwise(F.col("_p1")), F.when(t == "ratio", F.col("_p975")).otherwise(F.col("_p99"))
    capped = F.when(t == "binary", F.round(clip(v, 0.0, 1.0))).when(t == "ordinal", F.round(v)).when(t == "bounded_pct", clip(v, 0.0, 100.0)).when(v < low, low).when(v > high, high).otherwise(v)
    return joined.select(*[c if c != "value" else capped.alias("value") for c in long.columns])


def quantile_clipped(long: DataFrame, low: float, high: float, by: list[str]) -> DataFrame:
    """long with ``value`` kept within two quantiles of its group."""
    q = quantiles(long, by, "value", {"_lo": low, "_hi": high})
    v = F.col("value")
    return long.join(q, by, "left").select(*[c if c != "value" else F.when(v < F.col("_lo"), F.col("_lo")).when(v > F.col("_hi"), F.col("_hi")).otherwise(v).alias("value") for c in long.columns])


def binarised(x: Column, limit: float = 0.5) -> Column:
    return F.when(x.isNotNull(), (x > limit).cast("double"))


def filled_by_group(long: DataFrame, group: str) -> DataFrame:
    """long with null values replaced by the median of (indicator, group), else by that of the indicator; ``filled`` says which."""
    local = medians(long, ["indicator", group], "value", "_g")
    everywhere = medians(long, ["indicator"], "value", "_a")
    joined = long.join(local, ["indicator", group], "left").join(F.broadcast(everywhere), "indicator", "left")
    origin = F.when(F.col("value").isNotNull(), "real").when(F.col("_g").isNotNull(), "group").when(F.col("_a").isNotNull(), "all").otherwise("missing")
    return joined.select(*[c if c != "value" else F.coalesce("value", "_g", "_a").alias("value") for c in long.columns], origin.alias("filled"))


def modes(long: DataFrame, by: list[str], out: str = "mode") -> DataFrame:
    """The most frequent value of each group, the smallest among equals."""
    counts = long.where("value is not null").groupBy(*by, "value").agg(F.count(F.lit(1)).alias("_n"))
    best = counts.groupBy(*by).agg(F.max(F.struct("_n", (-F.col("value")).alias("_v"))).alias("_b"))
    return best.select(*by, (-F.col("_b._v")).alias(out))


def filled_by_type(long: DataFrame, types: DataFrame, group: str) -> DataFrame:
    """long with null values filled by type: binary by the group's mode (0 if it has none; without a group by the mode of all), ordinal by the median, the rest by the median, of the group and then of all; ordinal values are rounded, filled or not."""
    local = medians(long, ["indicator", group], "value", "_gm")
    everywhere = medians(long, ["indicator"], "value", "_am")
    mode = modes(long, ["indicator", group], "_gx")
    common = modes(long, ["indicator"], "_ax")
    joined = long.join(local, ["indicator", group], "left").join(mode, ["indicator", group], "left").join(everywhere, "indicator", "left").join(common, "indicator", "left").join(F.broadcast(types.select("indicator", "vtype")), "indicator", "left")
    t, middle = F.coalesce("vtype", F.lit("continuous")), F.coalesce("_gm", "_am")
    binary = F.coalesce("_gx", F.when(F.col(group).isNull(), F.col("_ax")), F.lit(0.0))
    filled = F.coalesce("value", F.when(t == "binary", binary).otherwise(middle))
    filled = F.when(t == "ordinal", F.round(filled)).otherwise(filled)
    return joined.select(*[c if c != "value" else filled.alias("value") for c in long.columns])


def filled_by_tier(candidates: DataFrame, cells: DataFrame, group: str, least: int = 3) -> DataFrame:
    """Cells (entity_id, group, indicator) with the value of the best tier of candidates (entity_id, indicator, tier, label, value), else the group's median, else that of all filled cells, each of at least ``least`` values; ``source`` names where from."""
    best = candidates.where("value is not null").groupBy("entity_id", "indicator").agg(F.min_by(F.struct("label", "value"), "tier").alias("_b"))
    base = cells.join(best, ["entity_id", "indicator"], "left").select(*cells.columns, F.col("_b.value").alias("value"), F.col("_b.label").alias("source"))
    enough = lambda by: base.groupBy(*by).agg(F.count("value").alias("_n")).where(F.col("_n") >= least).drop("_n")
    local = medians(base, ["indicator", group], "value", "_g").join(enough(["indicator", group]), ["indicator", group])
    step = base.join(local, ["indicator", group], "left").withColumn("source", F.coalesce("source", F.when(F.col("_g").isNotNull(), "sector_median"))).withColumn("value", F.coalesce("value", "_g")).drop("_g")
    everywhere = medians(step, ["indicator"], "value", "_a").join(step.groupBy("indicator").agg(F.count("value").alias("_n")).where(F.col("_n") >= least).drop("_n"), "indicator")
    out = step.join(F.broadcast(everywhere), "indicator", "left")
    return out.select(*cells.columns, F.coalesce("value", "_a").alias("value"), F.coalesce("source", F.when(F.col("_a").isNotNull(), "global_median"), F.lit("missing")).alias("source"))


def signed_log(x: Column) -> Column:
    return F.signum(x) * F.log1p(F.abs(x))


def signed_root(x: Column) -> Column:
    return F.signum(x) * F.sqrt(F.abs(x))


def logistic_around(x: Column, middle: Column, steepness: float = 1.0) -> Column:
    return 1 / (1 + F.exp(-steepness * (x - middle)))


def within_group_percentile(long: DataFrame, group: str, least: int = 2, default: float = 50.0, low: float = 2.0, high: float = 98.0) -> DataFrame:
    """long with ``proxy``: 100 times the percentile rank within (indicator, group), the default in groups with too few values, clipped."""
    ranked = with_rank(long, "value", ["indicator", group], "_r", pct=True)
    n = long.groupBy("indicator", group).agg(F.count("value").alias("_n"))
    joined = ranked.join(n, ["indicator", group])
    return joined.withColumn("proxy", clip(F.when((F.col("_n") >= least) & F.col("_r").isNotNull(), 100 * F.col("_r")).otherwise(F.lit(default)), low, high)).drop("_r", "_n")


def calibrated(df: DataFrame, value: str, group: list[str], out: str, centre: float = 50.0, spread: float = 15.0, least: int = 3, low: float = 2.0, high: float = 98.0) -> DataFrame:
    """df with ``out``: value standardised within its group (population deviation) to centre and spread and clipped; raw in groups of fewer than ``least``."""
    s = df.groupBy(*group).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"), F.count(value).alias("_n"))
    z = (F.col(value) - F.col("_m")) / F.when(F.col("_s") > 1e-10, F.col("_s"))
    scaled = F.when(F.col("_n") < least, F.col(value)).otherwise(clip(centre + spread * F.coalesce(z, F.when(F.col(value).isNotNull(), 0.0)), low, high))
    return df.join(s, group, "left").withColumn(out, scaled).drop("_m", "_s", "_n")


#: The least score of each letter bucket; CCC below.
RATINGS = ((42, "B"), (46, "BB"), (50, "BBB"), (54, "A"), (57, "AA"), (60, "AAA"))


def rating(score: Column) -> Column:
    """Letter bucket of a 0..100 score."""
    out = F.lit("CCC")
    for limit, name in RATINGS:
        out = F.when(score >= limit, name).otherwise(out)
    return F.when(score.isNotNull(), out)


def latest(df: DataFrame, by: list[str], order: str, value: str, out: str) -> DataFrame:
    """The value at the largest ``order`` of each group, nulls passed over."""
    return df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.max_by(value, order).alias(out))
