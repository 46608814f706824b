"""Analyses put together from ranks, bins, correlations and portfolios; every one is a frame of result rows."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions.expressions import ratio, two_sided
from panelforge.functions.tails import chi_square_tail, t_two_sided
from panelforge.operators.inference import rank_correlation
from panelforge.operators.ranking import top, with_bin, with_rank


def rank_matrix(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(a, b, rho, n, p, low, high): rank correlation of each pair of columns over rows with both."""
    pairs = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y")) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    rows = df.select(key, F.explode(F.array(*pairs)).alias("p")).select(key, "p.*").where("x is not null and y is not null")
    return rank_correlation(rows, ["a", "b"])


def demeaned_correlation(rows: DataFrame, by: list[str], group: str) -> DataFrame:
    """rank_correlation of y with x less its mean in the group."""
    means = rows.groupBy(*by, group).agg(F.avg("x").alias("_m"))
    return rank_correlation(rows.join(means, [*by, group]).withColumn("x", F.col("x") - F.col("_m")).drop("_m"), by)


#: Least share of the first horizon's correlation that the last keeps, and the class it gives.
DECAY = ((0.7, "slow_decay"), (0.4, "moderate_decay"))


def correlation_decay(ics: DataFrame, first: str, last: str, least: int = 15) -> DataFrame:
    """ics (factor, horizon, rho, n) by factor: mean, variability and sign stability over horizons, what the last keeps of the first, and its class."""
    rho = F.when(F.col("n") >= least, F.col("rho"))
    at = lambda h: F.abs(F.max(F.when(F.col("horizon") == h, rho)))
    out = ics.groupBy("factor").agg(
        F.avg(rho).alias("mean_ic"), F.when(F.count(rho) > 1, F.stddev_pop(rho)).alias("ic_variability"), F.abs(F.avg(F.signum(rho))).alias("sign_stability"),
        F.when(at(first) > 0, at(last) / at(first)).alias("retention"),
    )
    kind = F.lit("fast_decay")
    for limit, name in reversed(DECAY):
        kind = F.when(F.col("retention") >= limit, name).otherwise(kind)
    return out.withColumn("decay_class", F.when(F.col("retention").isNull(), "unknown").otherwise(kind))


def sign_verdicts(ics: DataFrame, expected: DataFrame, least: int = 10) -> DataFrame:
    """ics (factor, target, rho, p, n) against expected (factor, target, sign): whether the sign is right and significant."""
    right = F.col("rho") * F.col("sign") > 0
    verdict = F.when(F.col("n") < least, "INSUFFICIENT_DATA").when(right & (F.col("p") < 0.05), "CONSISTENT").when(right, "WEAK_CONSISTENT").otherwise("INCONSISTENT")
    return expected.join(ics, ["factor", "target"], "left").withColumn("verdict", F.when(F.col("rho").isNull(), "SKIP").otherwise(verdict))


def percentile_shift(long: DataFrame, group: str) -> DataFrame:
    """(indicator, group, n, mean percentile over all rows and in the group, mean, mean absolute and largest absolute shift) of long (indicator, value, group)."""
    there = long.where("value is not null")
    both = with_rank(with_rank(there, "value", ["indicator"], "_all", pct=True), "value", ["indicator", group], "_own", pct=True)
    shift = 100 * (F.col("_all") - F.col("_own"))
    return both.groupBy("indicator", group).agg(
        F.count(F.lit(1)).alias("n"), F.avg(100 * F.col("_all")).alias("mean_pooled"), F.avg(100 * F.col("_own")).alias("mean_within"), F.avg(shift).alias("mean_shift"), F.avg(F.abs(shift)).alias("mean_abs_shift"), F.max(F.abs(shift)).alias("max_abs_shift")
    )


def _demeaned(df: DataFrame, columns: list[str], group: str) -> DataFrame:
    whole = df.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])).select(group, *[F.col(c).cast("double").alias(c) for c in columns])
    means = whole.groupBy(group).agg(*[F.avg(c).alias(f"_m_{c}") for c in columns])
    return whole.join(means, group).select(group, *[(F.col(c) - F.col(f"_m_{c}")).alias(c) for c in columns])


def robust_regression(df: DataFrame, xs: list[str], y: str, group: str) -> DataFrame:
    """(term, coefficient, se, z, p, n) of y on xs and dummies of the group, with HC1 errors: X'X of columns less their group means, then the sum of e^2 x x'."""
    d = _demeaned(df, [*xs, y], group)
    pairs = [(i, j) for i in range(len(xs)) for j in range(i, len(xs))]
    row = d.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(group).alias("g"), *[F.sum(F.col(xs[i]) * F.col(xs[j])).alias(f"x{i}_{j}") for i, j in pairs], *[F.sum(F.col(x) * F.col(y)).alias(f"y{i}") for i, x in enumerate(xs)]).head()
    k, n = len(xs), row["n"]
    schema = "term string, coefficient double, se double, n bigint"
    if n <= k + row["g"]:
        return df.sparkSession.createDataFrame([], schema).withColumns({"z": F.lit(None).cast("double"), "p": F.lit(None).cast("double")})
    square = lambda r, name: np.array([[r[f"{name}{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
    bread = np.linalg.pinv(square(row, "x"))
    beta = bread @ np.array([row[f"y{i}"] for i in range(k)])
    e = F.col(y) - sum((F.col(x) * float(b) for x, b in zip(xs, beta, strict=True)), F.lit(0.0))
    meat = square(d.agg(*[F.sum(e * e * F.col(xs[i]) * F.col(xs[j])).alias(f"m{i}_{j}") for i, j in pairs]).head(), "m")
    se = np.sqrt(np.diag(bread @ meat @ bread) * n / (n - k - row["g"]))
    out = df.sparkSession.createDataFrame([(x, float(b), float(s), n) for x, b, s in zip(xs, beta, se, strict=True)], schema)
    z = F.col("coefficient") / F.col("se")
    return out.withColumns({"z": z, "p": two_sided(z)})


def controlled_difference(df: DataFrame, values: list[str], place: str, one: str, group: str, alpha: float = 0.05) -> DataFrame:
    """(factor, coefficient, t, p, significant, n): difference of one place from the rest in each value, with dummies of the group; significant after Bonferroni."""
    rows = df.select(group, (F.col(place) == one).cast("double").alias("x"), *values).unpivot([group, "x"], values, "factor", "y").where("y is not null and x is not null")
    g = rows.groupBy("factor", group).agg(F.count(F.lit(1)).alias("n"), F.regr_sxx("y", "x").alias("sxx"), F.regr_sxy("y", "x").alias("sxy"), F.regr_syy("y", "x").alias("syy"))
    s = g.groupBy("factor").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("_k"), F.sum("sxx").alias("_xx"), F.sum("sxy").alias("_xy"), F.sum("syy").alias("_yy"))
    free = F.col("n") - F.col("_k") - 1
    rest = F.col("_yy") - F.col("_xy") * F.col("_xy") / F.col("_xx")
    t = F.col("_xy") / F.col("_xx") / F.sqrt(rest / free / F.col("_xx"))
    out = s.withColumns({"coefficient": F.col("_xy") / F.col("_xx"), "t": t}).withColumn("p", t_two_sided(F.col("t"), free))
    return out.withColumn("significant", F.col("p") < alpha / len(values)).select("factor", "coefficient", "t", "p", "significant", "n")


def welch_anova(df: DataFrame, value: str, group: str) -> DataFrame:
    """(statistic, p, groups): Alexander and Govern's test of equal means without equal variances, from each group's n, mean and variance."""
    g = df.where(F.col(value).isNotNull() & F.col(group).isNotNull()).groupBy(group).agg(F.count(value).cast("double").alias("n"), F.avg(value).alias("m"), F.var_samp(value).alias("v")).where("n > 1")
    one = g.withColumn("w", F.col("n") / F.col("v"))
    mean = one.agg((F.sum(F.col("w") * F.col("m")) / F.sum("w")).alias("_mean"))
    t = (F.col("m") - F.col("_mean")) / F.sqrt(F.col("v") / F.col("n"))
    free = F.col("n") - 1
    a, b = free - 0.5, 48 * (free - 0.5) * (free - 0.5)
    c = F.sqrt(a * F.log(1 + t * t / free))
    z = c + (c * c * c + 3 * c) / b - (4 * F.pow(c, F.lit(7.0)) + 33 * F.pow(c, F.lit(5.0)) + 240 * c * c * c + 855 * c) / (10 * b * b + 8 * b * F.pow(c, F.lit(4.0)) + 1000 * b)
    s = one.crossJoin(F.broadcast(mean)).agg(F.sum(z * z).alias("statistic"), F.count(F.lit(1)).alias("groups"))
    return s.withColumn("p", chi_square_tail(F.col("statistic"), F.col("groups") - 1))


def bin_monotonicity(rows: DataFrame, bins: int = 5) -> DataFrame:
    """(factor, rho, p, spread, verdict) of rows (factor, x, y): rank correlation of the bins' numbers and mean y, the last less the first bin's mean."""
    means = with_bin(rows, "x", bins, ["factor"]).groupBy("factor", "bin").agg(F.avg("y").alias("y"))
    ranked = means.withColumn("x", F.col("bin").cast("double"))
    n = F.count(F.lit(1))
    order = Window.partitionBy("factor").orderBy("y")  # a few bins
    placed = ranked.withColumn("_r", F.rank().over(order) + (F.count(F.lit(1)).over(Window.partitionBy("factor", "y")) - 1) / 2)
    s = placed.groupBy("factor").agg(F.corr("x", "_r").alias("rho"), n.alias("_n"), (F.max_by("y", "x") - F.min_by("y", "x")).alias("spread"))
    rho = F.col("rho")
    t = rho * F.sqrt((F.col("_n") - 2) / F.greatest(1 - rho * rho, F.lit(1e-300)))
    p = F.when(F.abs(rho) > 1 - 1e-12, 0.0).otherwise(t_two_sided(t, F.col("_n") - 2))
    return s.withColumn("p", p).withColumn("monotonic", F.col("p") < 0.05).select("factor", "rho", "p", "monotonic", "spread")


def beta_decomposition(membership: DataFrame, df: DataFrame, ret: str, beta: str, strategy: str = "strategy", key: str = "entity_id") -> DataFrame:
    """(strategy, mean, benchmark, beta, excess, excess_over_beta, tracking_error, information_ratio): mean return less beta times that of all rows."""
    everyone = df.agg(F.avg(ret).alias("_b"))
    joined = membership.join(df.select(key, ret, beta), key).crossJoin(F.broadcast(everyone))
    s = joined.groupBy(strategy).agg(F.avg(ret).alias("mean"), F.max("_b").alias("benchmark"), F.avg(beta).alias("beta"), F.stddev_samp(F.col(ret) - F.col("_b")).alias("tracking_error"))
    excess = F.col("mean") - F.col("benchmark")
    return s.withColumns({"excess": excess, "excess_over_beta": F.col("mean") - F.col("beta") * F.col("benchmark"), "information_ratio": excess / (F.col("tracking_error") + 1e-10)})


def windows_beaten(df: DataFrame, score: str, windows: list[str], n: int, key: str = "entity_id") -> DataFrame:
    """(window, portfolio, universe, excess, beat): mean return of the n best with a return in each window against all of them."""
    rows = df.where(F.col(score).isNotNull()).unpivot([key, score], windows, "window", "ret").where("ret is not null")
    best = top(rows, score, key, n, ["window"]).groupBy("window").agg(F.avg("ret").alias("portfolio"), F.count(F.lit(1)).alias("size"))
    out = rows.groupBy("window").agg(F.avg("ret").alias("universe")).join(best, "window")
    return out.withColumn("excess", F.col("portfolio") - F.col("universe")).withColumn("beat", (F.col("excess") > 0).cast("int"))


def ends_compared(df: DataFrame, score: str, values: list[str], n: int, key: str = "entity_id") -> DataFrame:
    """(metric, top_mean, bottom_mean, all_mean, difference, t, p): the n best against the n worst rows by score, with Welch's test."""
    scored = df.where(F.col(score).isNotNull())
    first = top(scored, score, key, n).select(key, F.lit("top").alias("_end"))
    last = top(scored.withColumn("_minus", -F.col(score)), "_minus", key, n).select(key, F.lit("bottom").alias("_end"))
    sides = df.join(F.broadcast(first.union(last)), key, "left").select("_end", *values).unpivot("_end", values, "metric", "x")  # 2 n rows
    t, b = F.when(F.col("_end") == "top", F.col("x")), F.when(F.col("_end") == "bottom", F.col("x"))
    s = sides.groupBy("metric").agg(F.avg(t).alias("top_mean"), F.avg(b).alias("bottom_mean"), (F.var_samp(t) / F.count(t)).alias("_e1"), (F.var_samp(b) / F.count(b)).alias("_e2"), F.count(t).alias("_n1"), F.count(b).alias("_n2"))
    everyone = df.select(*values).unpivot([], values, "metric", "x").groupBy("metric").agg(F.avg("x").alias("all_mean"))
    e1, e2 = F.col("_e1"), F.col("_e2")
    gap = F.col("top_mean") - F.col("bottom_mean")
    free = (e1 + e2) * (e1 + e2) / (e1 * e1 / (F.col("_n1") - 1) + e2 * e2 / (F.col("_n2") - 1))
    tested = s.join(everyone, "metric").withColumns({"difference": gap, "t": gap / F.sqrt(e1 + e2)})
    return tested.withColumn("p", t_two_sided(F.col("t"), free)).select("metric", "top_mean", "bottom_mean", "all_mean", "difference", "t", "p")


def against_base(long: DataFrame, inside: str, limit: float = 2.5) -> DataFrame:
    """(indicator, base and other mean, deviation, mean_abs_z, n_flagged) of long (indicator, value, a boolean column): rows outside the base by its mean and deviation; flagged beyond ``limit``."""
    base = long.where(F.col(inside)).groupBy("indicator").agg(F.avg("value").alias("base_mean"), F.stddev_samp("value").alias("base_std"))
    z = F.when(F.col("base_std") > 1e-10, (F.col("value") - F.col("base_mean")) / F.col("base_std"))
    other = long.where(~F.col(inside) & F.col("value").isNotNull()).join(base, "indicator")
    out = other.groupBy("indicator").agg(F.max("base_mean").alias("base_mean"), F.max("base_std").alias("base_std"), F.avg("value").alias("other_mean"), F.avg(F.abs(z)).alias("mean_abs_z"), F.sum((F.abs(z) > limit).cast("int")).alias("n_flagged"))
    return out.withColumn("mean_deviation", F.col("other_mean") - F.col("base_mean"))


def verdict_summary(verdicts: DataFrame, good: list[str]) -> DataFrame:
    """(check, n, n_good, share, verdict) of verdicts (check, verdict) and a last row ``overall``: PASS from 70 pct good, WARN from 50 (fixed values); overall
    FAIL on any FAIL or three WARN, CONDITIONAL_PASS on any WARN."""
    checked = verdicts.where("verdict <> 'SKIP'").groupBy("check").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("verdict").isin(good).cast("int")).alias("n_good"))
    each = checked.withColumn("share", 100 * F.col("n_good") / F.col("n")).withColumn("verdict", F.when(F.col("share") >= 70, "PASS").when(F.col("share") >= 50, "WARN").otherwise("FAIL"))
    count = lambda v: F.sum((F.col("verdict") == v).cast("int"))
    overall = F.when((count("FAIL") > 0) | (count("WARN") >= 3), "FAIL").when(count("WARN") > 0, "CONDITIONAL_PASS").otherwise("PASS")
    last = each.agg(F.sum("n").alias("n"), F.sum("n_good").alias("n_good"), overall.alias("verdict")).withColumn("share", 100 * F.col("n_good") / F.col("n"))
    return each.unionByName(last.withColumn("check", F.lit("overall")))


def entity_card(ranks: DataFrame, scores: DataFrame, key: str) -> DataFrame:
    """(key, factor, score, rank): scores and ranks of an entity's factors as rows."""
    factors = [c for c in scores.columns if c != key]
    a = scores.unpivot(key, factors, "factor", "score")
    b = ranks.toDF(key, *factors).unpivot(key, factors, "factor", "rank")
    return a.join(b, [key, "factor"])


def merged_preferring_right(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join on the key; of columns that both have the right one's value, or the left one's where it is null."""
    shared = [c for c in left.columns if c in right.columns and c != key]
    r = right.select(key, *[F.col(c).alias(f"_r_{c}") if c in shared else F.col(c) for c in right.columns if c != key])
    joined = left.join(r, key)
    own = [F.coalesce(F.col(f"_r_{c}"), F.col(c)).alias(c) if c in shared else F.col(c) for c in left.columns]
    return joined.select(*own, *[c for c in right.columns if c not in left.columns])


def with_and_without(ics: DataFrame) -> DataFrame:
    """(target, rho_with, rho_without, change) of ics (factor with or without, target, rho)."""
    of = lambda f: F.max(F.when(F.col("factor") == f, F.col("rho")))
    out = ics.groupBy("target").agg(of("with").alias("rho_with"), of("without").alias("rho_without"))
    return out.withColumns({"change": F.col("rho_with") - F.col("rho_without"), "kept": ratio(F.abs("rho_without"), F.abs("rho_with"))})
