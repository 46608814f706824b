"""Price-series operators: trailing measures, momentum, drawdown, forward returns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions.expressions import adjusted_kurtosis, adjusted_skewness, ratio

MOMENTUM_DAYS = {"1m": 21, "3m": 63, "6m": 126, "12m": 252}


def with_returns(prices: DataFrame) -> DataFrame:
    """prices (entity, day, close, volume) with the daily return and the row's number from the last day on."""
    ahead = Window.partitionBy("entity").orderBy("day")
    back = Window.partitionBy("entity").orderBy(F.desc("day"))
    return prices.withColumn("ret", ratio(F.col("close"), F.lag("close").over(ahead)) - 1).withColumn("rn", F.row_number().over(back))


def trailing_measures(prices: DataFrame, year: int = 252) -> DataFrame:
    """One row for each entity: mean volumes, annualised volatilities, momenta, drawdown, Sharpe, Sortino, moments and illiquidity.

    Null where the series is too short: a measure over the last k days needs more than k prices, one of returns more than k returns."""
    r = with_returns(prices)
    last = Window.partitionBy("entity").orderBy("day")
    r = r.withColumn("_peak", F.when(F.col("rn") <= year, F.max(F.when(F.col("rn") <= year, F.col("close"))).over(last.rowsBetween(Window.unboundedPreceding, 0))))
    rn, ret = F.col("rn"), F.col("ret")
    recent = lambda k, x: F.when(rn <= k, x)
    enough = lambda k, x: F.when(F.max(rn) > k, x)
    returns = lambda k, x: F.when(F.count(ret) > k, x)
    at = lambda k: F.max(F.when(rn == k, F.col("close")))
    n = F.count(ret)
    annual = lambda x: F.stddev_samp(x) * F.lit(float(year)) ** 0.5
    return r.groupBy("entity").agg(
        F.count(F.lit(1)).alias("n_days"),
        F.avg(recent(30, F.col("volume"))).alias("volume_30"), enough(90, F.avg(recent(90, F.col("volume")))).alias("volume_90"),
        (100 * annual(ret)).alias("volatility"), returns(30, 100 * annual(recent(30, ret))).alias("volatility_30"),
        *[enough(k, at(1) / at(k) - 1).alias(f"momentum_{name}") for name, k in MOMENTUM_DAYS.items()],
        enough(year, F.min(F.col("close") / F.col("_peak") - 1)).alias("max_drawdown"),
        returns(year, F.avg(recent(year, ret)) * year / (annual(recent(year, ret)) + 1e-10)).alias("sharpe"),
        returns(year, F.avg(recent(year, ret)) * year / (annual(recent(year, F.when(ret < 0, ret))) + 1e-10)).alias("sortino"),
        F.avg(ret).alias("mean_return"), adjusted_skewness(F.skewness(ret), n).alias("skew"), adjusted_kurtosis(F.kurtosis(ret), n).alias("kurtosis"),
        (F.avg(F.abs(ret) / F.when(F.col("volume") * F.col("close") > 0, F.col("volume") * F.col("close"))) * 1e6).alias("illiquidity"),
    )


def snapshot_day(prices: DataFrame, back: int = 127, least: float = 0.5) -> DataFrame:
    """(snapshot): of the days on which at least a share of entities has a price, the ``back``-th from the last (the first if there are fewer)."""
    n = prices.agg(F.count_distinct("entity").alias("_n"))
    days = prices.groupBy("day").agg(F.count_distinct("entity").alias("_k")).crossJoin(F.broadcast(n)).where(F.col("_k") >= least * F.col("_n"))
    return days.orderBy(F.desc("day")).limit(back).agg(F.min("day").alias("snapshot"))


def forward_returns(prices: DataFrame, snapshot: DataFrame, horizons: dict[str, int], least: int = 5) -> DataFrame:
    """(entity, anchor, one return and partial flag for each horizon): from the first day on or after the snapshot to the n-th row after, or the last one if the series ends before (partial, with more than ``least`` rows)."""
    later = prices.crossJoin(F.broadcast(snapshot)).where(F.col("day") >= F.col("snapshot"))
    numbered = later.withColumn("_i", F.row_number().over(Window.partitionBy("entity").orderBy("day")) - 1)
    first, n = F.max(F.when(F.col("_i") == 0, F.col("close"))), F.max("_i")
    aggs = [F.min("day").alias("anchor")]
    for name, k in horizons.items():
        whole, last = F.max(F.when(F.col("_i") == k, F.col("close"))), F.max_by("close", "_i")
        aggs += [F.when(n >= k, whole / first - 1).when(n + 1 > least, last / first - 1).alias(f"fwd_{name}"), (n < k).alias(f"partial_{name}")]
    return numbered.groupBy("entity").agg(*aggs)


def as_of(prices: DataFrame, day) -> DataFrame:
    """(entity, anchor, close): the first day on or after the given one."""
    return prices.where(F.col("day") >= F.lit(day)).groupBy("entity").agg(F.min("day").alias("anchor"), F.min_by("close", "day").alias("close"))
