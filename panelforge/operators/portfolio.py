"""Top-k portfolios, group comparisons, bins, overlaps and inequality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions.expressions import ratio
from panelforge.operators.ranking import cumulative, top, with_bin


def members(scores: DataFrame, n: int, strategy: str = "strategy", score: str = "score", key: str = "entity_id") -> DataFrame:
    """(strategy, key): the n best of each strategy of (key, strategy, score), smaller keys first among equals."""
    return top(scores, score, key, n, [strategy]).select(strategy, key)


def performance(membership: DataFrame, returns: DataFrame, benchmark: float | None = None, strategy: str = "strategy", key: str = "entity_id", value: str = "ret") -> DataFrame:
    """One row for each strategy (and horizon, if returns has it): n, mean, std, mean / std, downside ratio, share of positive returns, excess over all entities and its ratio to the deviation."""
    keys = [strategy, *(["horizon"] if "horizon" in returns.columns else [])]
    by_horizon = keys[1:]
    r = F.col(value)
    whole = returns.groupBy(*by_horizon).agg(F.avg(r).alias("_all")) if by_horizon else returns.agg(F.avg(r).alias("_all"))
    rows = membership.join(returns, key)
    joined = rows.join(F.broadcast(whole), by_horizon) if by_horizon else rows.crossJoin(F.broadcast(whole))
    out = joined.groupBy(*keys).agg(
        F.count(r).alias("n"), F.avg(r).alias("mean"), F.stddev_samp(r).alias("std"), F.sqrt(F.avg(F.when(r < 0, r * r).when(r.isNotNull(), 0.0))).alias("_down"), F.avg((r > 0).cast("int")).alias("positive"),
        (F.avg(r) - F.max("_all")).alias("excess"), F.stddev_samp(r - F.col("_all")).alias("_te"),
    )
    return out.select(*keys, "n", "mean", "std", ratio(F.col("mean"), F.col("std")).alias("cs_ir"), ratio(F.col("mean"), F.col("_down")).alias("downside_ratio"), "positive", "excess", ratio(F.col("excess"), F.col("_te")).alias("information_ratio"))


def concentration(membership: DataFrame, groups: DataFrame, group: str = "sector", strategy: str = "strategy", key: str = "entity_id") -> DataFrame:
    """(strategy, hhi, n_groups, top_share): sum of squared group shares and the largest share."""
    counts = membership.join(groups.select(key, group), key).groupBy(strategy, group).agg(F.count(F.lit(1)).alias("_n"))
    shares = counts.withColumn("_s", F.col("_n") / F.sum("_n").over(Window.partitionBy(strategy)))
    return shares.groupBy(strategy).agg(F.sum(F.col("_s") * F.col("_s")).alias("hhi"), F.count(F.lit(1)).alias("n_groups"), F.max("_s").alias("top_share"))


def group_table(df: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """Mean, deviation and count of each value by groups."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[f(v).alias(f"{v}_{name}") for v in values for name, f in (("mean", F.avg), ("std", F.stddev_samp))])


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, n, margin, share) with margins, where the margin's label is All and ``margin`` says which rows are: 0 a cell, 1 over b, 2 over a, 3 over both. A null
    group stays null. share: of its row's total (1 for row totals)."""
    cube = df.cube(a, b).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().cast("int").alias("margin"), F.grouping(a).alias("_a"), F.grouping(b).alias("_b"))
    label = lambda c, g: F.when(F.col(g) == 1, "All").otherwise(F.col(c).cast("string")).alias(c)
    row = F.sum(F.when(F.col("_b") == 1, F.col("n"))).over(Window.partitionBy("_a", a))  # as many rows as b has groups
    return cube.withColumn("share", F.col("n") / row).select(label(a, "_a"), label(b, "_b"), "n", "margin", "share")


def bin_table(df: DataFrame, score: str, bins: int, values: list[str]) -> DataFrame:
    """(bin, n, mean score, mean of each value) over quantile bins of the score."""
    binned = with_bin(df, score, bins).where("bin is not null")
    return binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("score_mean"), *[F.avg(v).alias(f"{v}_mean") for v in values])


def spread(table: DataFrame, value: str, bins: int) -> DataFrame:
    """(spread, monotone, direction) of a bin table: last less first bin, and whether the means only rise or only fall."""
    means = F.transform(F.array_sort(F.collect_list(F.struct("bin", value))), lambda x: x[value])
    steps = F.zip_with(F.slice(F.col("m"), 1, bins - 1), F.slice(F.col("m"), 2, bins - 1), lambda a, b: b - a)
    one = table.agg(means.alias("m")).select("m", steps.alias("s"))
    up, down = F.forall("s", lambda x: x >= 0), F.forall("s", lambda x: x <= 0)
    return one.select((F.element_at("m", bins) - F.element_at("m", 1)).alias("spread"), (up | down).alias("monotone"), F.when(up, "up").when(down, "down").otherwise("none").alias("direction"))


def composition(df: DataFrame, scores: DataFrame, n: int, group: str, key: str = "entity_id") -> DataFrame:
    """(group, share of all, share of the n best, difference in points)."""
    best = top(scores, "score", key, n).select(key, F.lit(1).alias("_in"))
    flagged = df.select(key, group).join(F.broadcast(best), key, "left")
    counts = flagged.groupBy(group).agg(F.count(F.lit(1)).alias("_n"), F.count("_in").alias("_k"))
    whole = counts.agg(F.sum("_n").alias("_nn"), F.sum("_k").alias("_kk"))
    out = counts.crossJoin(F.broadcast(whole)).select(group, (F.col("_n") / F.col("_nn")).alias("share"), (F.col("_k") / F.col("_kk")).alias("top_share"))
    return out.withColumn("difference", 100 * (F.col("top_share") - F.col("share")))


def weighted_returns(df: DataFrame, weights: dict[str, Column], value: str) -> DataFrame:
    """(scheme, mean, std): weighted mean and weighted deviation of a value under each scheme of non-negative weights."""
    rows = df.where(F.col(value).isNotNull()).select(F.col(value).alias("_x"), F.explode(F.array(*[F.struct(F.lit(n).alias("scheme"), w.cast("double").alias("_w")) for n, w in weights.items()])).alias("_s")).select("_x", "_s.*")
    sums = rows.where("_w is not null").groupBy("scheme").agg(F.sum("_w").alias("w"), F.sum(F.col("_w") * F.col("_x")).alias("wx"), F.sum(F.col("_w") * F.col("_x") * F.col("_x")).alias("wxx"))
    mean = F.col("wx") / F.col("w")
    return sums.select("scheme", mean.alias("mean"), F.sqrt(F.greatest(F.lit(0.0), F.col("wxx") / F.col("w") - mean * mean)).alias("std"))


def overlaps(membership: DataFrame, strategy: str = "strategy", key: str = "entity_id") -> DataFrame:
    """(a, b, shared, either, jaccard) of each pair of strategies' members."""
    a, b = (membership.select(F.col(strategy).alias(s), key) for s in "ab")
    shared = a.join(b, key).where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))
    size = membership.groupBy(strategy).agg(F.count(F.lit(1)).alias("_n"))
    names = size.select(F.col(strategy).alias("a"), F.col("_n").alias("_a")).crossJoin(F.broadcast(size.select(F.col(strategy).alias("b"), F.col("_n").alias("_b")))).where("a < b")
    out = names.join(shared, ["a", "b"], "left").withColumn("shared", F.coalesce("shared", F.lit(0).cast("bigint")))
    return out.withColumn("either", F.col("_a") + F.col("_b") - F.col("shared")).select("a", "b", "shared", "either", (F.col("shared") / F.col("either")).alias("jaccard"))


def gini(df: DataFrame, value: str) -> DataFrame:
    """(gini) of a value less its minimum (and 1e-6 more), by trapezoids under the Lorenz curve at every row, as a sum over distinct values; null below 5 rows."""
    low = df.agg(F.min(value).alias("_lo"))
    shifted = df.crossJoin(F.broadcast(low)).select((F.col(value) - F.col("_lo") + 1e-6).alias("_x"))
    c = cumulative(shifted, [], "_x")
    middle, n = F.col("below") + (F.col("n") + 1) / 2, F.max("total")
    sums = F.sum(F.col("n") * F.col("_x"))
    # The curve's first trapezoid begins at the first row, not at 0.
    area = 2 * F.sum(middle * F.col("n") * F.col("_x")) / (n * sums) - (n + 1) / n + F.min("_x") / sums / n
    return c.agg(F.when(n >= 5, area).alias("gini"))


def ecdf(df: DataFrame, value: str) -> DataFrame:
    """(value, share of rows at or below it) for each distinct value."""
    return cumulative(df, [], value).select(value, ((F.col("below") + F.col("n")) / F.col("total")).alias("ecdf"))


def variance_parts(df: DataFrame, value: str, group: str) -> DataFrame:
    """(between, within, eta_squared): sums of squares between and within groups."""
    g = df.where(F.col(value).isNotNull()).groupBy(group).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v"))
    mean = F.sum(F.col("n") * F.col("m")) / F.sum("n")
    sums = g.agg((F.sum(F.col("n") * F.col("m") * F.col("m")) - F.sum("n") * mean * mean).alias("between"), F.sum(F.col("n") * F.col("v")).alias("within"))
    return sums.withColumn("eta_squared", F.col("between") / (F.col("between") + F.col("within")))


def group_leaders(df: DataFrame, group: str, values: list[str]) -> DataFrame:
    """(factor, best, worst): the groups with the largest and smallest mean of each value."""
    means = df.groupBy(group).agg(*[F.avg(v).alias(v) for v in values]).unpivot(group, values, "factor", "mean").where("mean is not null")
    return means.groupBy("factor").agg(F.max(F.struct("mean", group))[group].alias("best"), F.min(F.struct("mean", group))[group].alias("worst"))


def attribution(df: DataFrame, score: str, ret: str) -> DataFrame:
    """(top, bottom, spread): mean return in the top and bottom fifth of a score."""
    b = with_bin(df, score, 5)
    t, l = F.avg(F.when(F.col("bin") == 5, F.col(ret))), F.avg(F.when(F.col("bin") == 1, F.col(ret)))  # noqa: E741
    return b.agg(t.alias("top"), l.alias("bottom"), (t - l).alias("spread"))


def contributions(df: DataFrame, best: DataFrame, weights: dict[str, float], key: str = "entity_id") -> DataFrame:
    """(factor, contribution): weight times the mean of the best less the mean of all."""
    inside = df.join(F.broadcast(best.select(key, F.lit(1).alias("_in"))), key, "left").select("_in", *weights).unpivot("_in", list(weights), "factor", "x")
    w = F.lit(0.0)
    for f, x in weights.items():
        w = F.when(F.col("factor") == f, F.lit(float(x))).otherwise(w)
    means = inside.groupBy("factor").agg((F.avg(F.when(F.col("_in") == 1, F.col("x"))) - F.avg("x")).alias("_d"))
    return means.select("factor", (w * F.col("_d")).alias("contribution"))
