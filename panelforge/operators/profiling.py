"""Column statistics, missingness, coverage, and data-quality reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions.expressions import adjusted_kurtosis, adjusted_skewness
from panelforge.operators.ranking import quantiles


def column_statistics(long: DataFrame, by: list[str]) -> DataFrame:
    """One row for each group of (by, value) rows: counts, moments (sample ones) and exact quartiles."""
    v = F.col("value")
    moments = long.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"),
        F.count_distinct(v).alias("n_unique"), F.sum((v == 0).cast("int")).alias("n_zero"), F.sum((v < 0).cast("int")).alias("n_negative"),
        F.skewness(v).alias("_g1"), F.kurtosis(v).alias("_g2"),
    )
    n = F.col("n")
    out = moments.withColumn("skew", adjusted_skewness(F.col("_g1"), n)).withColumn("kurtosis", adjusted_kurtosis(F.col("_g2"), n)).drop("_g1", "_g2")
    return out.join(quantiles(long, by, "value", {"p25": 0.25, "p50": 0.5, "p75": 0.75}), by, "left")


def missingness(long: DataFrame, sigmas: float = 4.0) -> DataFrame:
    """(indicator, n_rows, n_missing, missing_share, n_extreme): extreme cells lie over ``sigmas`` standard deviations from the mean."""
    stats = long.groupBy("indicator").agg(F.avg("value").alias("_m"), F.stddev_samp("value").alias("_s"))
    away = F.abs((F.col("value") - F.col("_m")) / F.when(F.col("_s") > 0, F.col("_s"))) > sigmas
    return long.join(F.broadcast(stats), "indicator").groupBy("indicator").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(F.col("value").isNull().cast("int")).alias("n_missing"), F.avg(F.col("value").isNull().cast("int")).alias("missing_share"), F.sum(F.coalesce(away, F.lit(False)).cast("int")).alias("n_extreme")
    )


def with_coverage(df: DataFrame, required: list[str], out: str = "coverage") -> DataFrame:
    """df with the share of non-null columns among those of ``required`` that it has."""
    present = [c for c in required if c in df.columns]
    if not present:
        return df.withColumn(out, F.lit(1.0))
    return df.withColumn(out, sum((F.col(c).isNotNull().cast("int") for c in present), F.lit(0)) / len(present))


def enough_coverage(df: DataFrame, required: list[str], least: float) -> DataFrame:
    """Rows whose coverage of the required columns is at least ``least``."""
    return with_coverage(df, required, "_coverage").where(F.col("_coverage") >= least).drop("_coverage")


def covered_columns(long: DataFrame, least: float) -> DataFrame:
    """(indicator, coverage, kept) of each column of a long frame."""
    return long.groupBy("indicator").agg(F.avg(F.col("value").isNotNull().cast("int")).alias("coverage")).withColumn("kept", F.col("coverage") >= least)


#: Variable types by the end of a column's name, for columns that no table names: (end, type).
SUFFIX_TYPES = (("_pct", "bounded_pct"), ("_percent", "bounded_pct"), ("_policy", "binary"), ("_target", "binary"), ("_flag", "binary"), ("_rank", "ordinal"), ("_share", "bounded_pct"), ("_rate", "bounded_pct"), ("_ratio", "ratio"), ("n_", "count"))
TREATMENTS = {"binary": "round to 0 or 1", "ordinal": "percentile rank", "bounded_pct": "clip to its range", "ratio": "cap 2.5 / 97.5 pct", "count": "log1p, cap 1 / 99 pct", "continuous": "cap 1 / 99 pct"}


def variable_types(names: DataFrame, known: dict[str, str]) -> DataFrame:
    """(indicator, vtype, treatment) of each name: from ``known``, else by its ending or start, else continuous."""
    kind = F.lit("continuous")
    for end, t in reversed(SUFFIX_TYPES):
        fits = F.col("indicator").startswith(end) if end.endswith("_") else F.col("indicator").endswith(end)
        kind = F.when(fits, t).otherwise(kind)
    for name, t in known.items():
        kind = F.when(F.col("indicator") == name, t).otherwise(kind)
    typed = names.withColumn("vtype", kind)
    advice = F.lit(None).cast("string")
    for t, text in TREATMENTS.items():
        advice = F.when(F.col("vtype") == t, text).otherwise(advice)
    return typed.withColumn("treatment", advice)


def first_rows(df: DataFrame, key: str, order: list) -> DataFrame:
    """One row for each non-null key: the first by ``order``."""
    ranked = df.where(F.col(key).isNotNull()).withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return ranked.where("_n = 1").drop("_n")


#: Weights of a cell's origin in the quality score.
ORIGIN_WEIGHTS = {"real": 1.0, "proxy": 0.6, "imputed": 0.25}


def origin_quality(cells: DataFrame, weights: dict[str, float] = ORIGIN_WEIGHTS) -> DataFrame:
    """(entity_id, quality, one share column for each origin) from cells (entity_id, indicator, source)."""
    worth = F.lit(0.0)
    for s, w in weights.items():
        worth = F.when(F.col("source") == s, F.lit(w)).otherwise(worth)
    return cells.groupBy("entity_id").agg(F.avg(worth).alias("quality"), *[F.avg((F.col("source") == s).cast("int")).alias(f"{s}_share") for s in weights])


def dominant_source(cells: DataFrame, priority: list[str]) -> DataFrame:
    """(entity_id, source): the first label of ``priority`` that an entity's cells have."""
    place = F.array_position(F.array(*map(F.lit, priority)), F.col("source"))
    best = cells.withColumn("_p", place).where("_p > 0").groupBy("entity_id").agg(F.min("_p").alias("_p"))
    return best.select("entity_id", F.element_at(F.array(*map(F.lit, priority)), F.col("_p").cast("int")).alias("source"))


def origin_distribution(cells: DataFrame) -> DataFrame:
    """(indicator, source, n, share of the indicator's cells)."""
    counts = cells.groupBy("indicator", "source").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("indicator")))


def range_verdicts(long: DataFrame, ranges: DataFrame) -> DataFrame:
    """Range checks of (indicator, value) against (indicator, low, high, hard_low, hard_high): counts, share in range and a verdict.

    PASS: at least 80 pct in range; WARN: at least 60 pct; else FAIL, and so are more than 5 pct beyond the hard limits (fixed values)."""
    joined = long.where("value is not null").join(F.broadcast(ranges), "indicator")
    v = F.col("value")
    flag = lambda c: F.sum(c.cast("int"))
    out = joined.groupBy("indicator").agg(F.count(F.lit(1)).alias("n"), flag(v < F.col("low")).alias("n_below"), flag(v > F.col("high")).alias("n_above"), flag((v < F.col("hard_low")) | (v > F.col("hard_high"))).alias("n_hard"))
    out = out.withColumn("in_range", 1 - (F.col("n_below") + F.col("n_above")) / F.col("n"))
    broken = F.col("n_hard") > 0.05 * F.col("n")
    return out.withColumn("verdict", F.when(broken, "FAIL").when(F.col("in_range") >= 0.8, "PASS").when(F.col("in_range") >= 0.6, "WARN").otherwise("FAIL"))
