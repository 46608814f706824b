"""Ranks, quantiles and bins that no task sees whole.

All start from ``cumulative``: rows are first added up to (group, value, count), dealt by ranges of (group, value)
and counted up within a range; the ranges' totals, a few numbers for each, give the offsets. So a global rank or an exact
quantile never sorts a column in one task, and a group's size doesn't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions.tables import settled


def cumulative(df: DataFrame, by: list[str], value: str, weight: str | None = None) -> DataFrame:
    """(by, value, n, below, total): the rows of each distinct non-null value, those with smaller values, and all rows of its group; with ``weight``, rows count as often as it says."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("n"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # The ranges are settled, as sampling could draw them otherwise when the plan runs again.
    ranged = settled(counts.repartitionByRange(parts, *by, value).withColumn("_range", F.spark_partition_id()), "ranges")
    inside = Window.partitionBy("_range", *by).orderBy(value)
    sums = ranged.groupBy("_range", *by).agg(F.sum("n").alias("_sum"))
    # One row for each range and group in it; groups cut by a range border are few.
    before = Window.partitionBy(*by).orderBy("_range") if by else Window.partitionBy(F.lit(1)).orderBy("_range")
    whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    offsets = sums.select(
        F.col("_range").alias("_r"), *[F.col(b).alias(f"_b{k}") for k, b in enumerate(by)], (F.sum("_sum").over(before.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_sum")).alias("_offset"), F.sum("_sum").over(whole).alias("total")
    )
    same = F.col("_range") == F.col("_r")
    for k, b in enumerate(by):
        same = same & F.col(b).eqNullSafe(F.col(f"_b{k}"))
    run = F.sum("n").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    return ranged.withColumn("_run", run).join(offsets, same).select(*by, value, "n", (F.col("_run") + F.col("_offset")).alias("below"), "total")


def with_rank(df: DataFrame, value: str, by: list[str] | None = None, out: str = "rank", pct: bool = False, descending: bool = False) -> DataFrame:
    """df with the average rank of ``value`` within ``by`` (over all rows if none); pct divides by the non-null rows; null stays null."""
    by = by or []
    c = cumulative(df, by, value)
    up = F.col("below") + (F.col("n") + 1) / 2
    rank = F.col("total") - up + 1 if descending else up
    ranks = c.select(*[F.col(b).alias(f"__rank_key{k}") for k, b in enumerate(by)], F.col(value).alias("__rank_value"), (rank / F.col("total") if pct else rank).alias(out))
    same = F.col(value) == F.col("__rank_value")
    for k, b in enumerate(by):
        same = same & F.col(b).eqNullSafe(F.col(f"__rank_key{k}"))
    return df.join(ranks, same, "left").drop("__rank_value", *[f"__rank_key{k}" for k in range(len(by))])


def rank_columns(df: DataFrame, key: str, columns: list[str], pct: bool = False, descending: bool = False, suffix: str = "_rank") -> DataFrame:
    """(key, one rank column for each of columns): all columns ranked in one pass over (column, value)."""
    long = df.select(key, *columns).unpivot(key, columns, "_column", "_value").where("_value is not null")
    ranked = with_rank(long, "_value", ["_column"], "_rank", pct, descending)
    return ranked.groupBy(key).agg(*[F.max(F.when(F.col("_column") == c, F.col("_rank"))).alias(f"{c}{suffix}") for c in columns])


def quantiles(df: DataFrame, by: list[str], value: str, probabilities: dict[str, float]) -> DataFrame:
    """(by, one column for each name): exact quantiles with linear interpolation, read from the cumulative counts."""
    c = cumulative(df, by, value)
    out = []
    for name, p in probabilities.items():
        place = (F.col("total") - 1) * F.lit(p)
        low, high = F.floor(place), F.ceil(place)
        holds = lambda at: (F.col("below") <= at) & (at < F.col("below") + F.col("n"))
        a, b = (F.max(F.when(holds(at), F.col(value))) for at in (low, high))
        share = F.max(place - low)
        out.append((a + (b - a) * share).alias(name))
    return c.groupBy(*by).agg(*out)


def medians(df: DataFrame, by: list[str], value: str, out: str = "median") -> DataFrame:
    return quantiles(df, by, value, {out: 0.5})


def median_deviation(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, median, mad): the median and the median distance from it."""
    middle = medians(df, by, value)
    parted = df.where(F.col(value).isNotNull()).join(middle, by) if by else df.where(F.col(value).isNotNull()).crossJoin(F.broadcast(middle))
    away = parted.withColumn("_away", F.abs(F.col(value) - F.col("median")))
    mad = medians(away, by, "_away", "mad")
    return middle.join(mad, by) if by else middle.crossJoin(F.broadcast(mad))


def with_bin(df: DataFrame, value: str, bins: int, by: list[str] | None = None, out: str = "bin") -> DataFrame:
    """df with the number 1..bins of the right-closed quantile bin of ``value``; equal values share a bin; null stays null."""
    by = by or []
    names = {f"_q{k}": k / bins for k in range(1, bins)}
    edges = quantiles(df, by, value, names)
    joined = df.join(edges, by, "left") if by else df.crossJoin(F.broadcast(edges))
    number = sum(((F.col(value) > F.col(q)).cast("int") for q in names), F.lit(1))
    return joined.withColumn(out, F.when(F.col(value).isNotNull(), number)).drop(*names)


def top(df: DataFrame, score: str, key: str, n: int, by: list[str] | None = None, out: str = "position") -> DataFrame:
    """The n rows with the largest score (the smaller key first among equals), numbered; within each group if by is given."""
    order = (F.col(score).desc_nulls_last(), F.col(key))
    if by:
        return df.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(out) <= n)
    first = df.orderBy(*order).limit(n)
    return first.withColumn(out, F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order)))  # n rows


def numbered(df: DataFrame, by: list[str], order: list[str], out: str = "place") -> DataFrame:
    """df with ``out``, the number of each row (from 0) within its group in an order without ties; rows are dealt by ranges, so no task needs a whole group."""
    dealt = df.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
    dealt = settled(dealt.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "numbered")
    # A row for each range and group in it; a group cut by range borders has as many as ranges.
    parts = dealt.groupBy("_part", *by).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_count"))
    before = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))).orderBy("_part")
    names = {c: f"_by{k}" for k, c in enumerate(by)}
    add = (F.sum("_count").over(before) - F.col("_count") - F.col("_first")).alias("_add")
    offsets = parts.select(F.col("_part").alias("_p"), add, *[F.col(c).alias(n) for c, n in names.items()])
    same = F.col("_part") == F.col("_p")
    for c, n in names.items():
        same = same & F.col(c).eqNullSafe(F.col(n))
    return dealt.join(offsets, same).withColumn(out, F.col("_at") + F.col("_add")).drop("_part", "_at", "_p", "_add", *names.values())
