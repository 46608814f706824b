"""Factors made monotone in a target: indicators reweighted by their association with it, isotonic fit on bins, blend of ranks.

Only the bins' means (ten points) and one coefficient for each indicator are handled on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.functions.expressions import clip
from panelforge.functions.tables import settled
from panelforge.operators.inference import pair_rows, rank_correlation
from panelforge.operators.ranking import with_bin, with_rank

QUINTILES, DECILES = 5, 10
#: Rows without which means of bins, coefficients and the fit are not taken.
LEAST_BINNED, LEAST_PAIRED, LEAST_FITTED = 25, 10, 20


def bin_means(df: DataFrame, value: str, target: str, bins: int) -> DataFrame:
    """(bin, x, y, n): means of value and target over the rows with both, by quantile bins of value; equal values share a bin."""
    both = df.where(F.col(value).isNotNull() & F.col(target).isNotNull())
    return with_bin(both, value, bins, out="bin").groupBy("bin").agg(F.avg(value).alias("x"), F.avg(target).alias("y"), F.count(F.lit(1)).alias("n"))


def _quintiles(df: DataFrame, value: str, target: str) -> list[float | None]:
    rows = {r["bin"]: r for r in bin_means(df, value, target, QUINTILES).collect()}
    if sum(r["n"] for r in rows.values()) < LEAST_BINNED:
        return [None] * QUINTILES
    return [rows[k]["y"] if k in rows else None for k in range(1, QUINTILES + 1)]


def rising_steps(means: list[float | None]) -> int:
    """Steps between neighbouring bins that do not fall."""
    return sum(a is not None and b is not None and b >= a for a, b in zip(means, means[1:], strict=False))


def is_monotone(means: list[float | None]) -> bool:
    return None not in means and all(b - a >= -1e-10 for a, b in zip(means, means[1:], strict=False))


def pool_adjacent(y: list[float]) -> list[float]:
    """The non-falling numbers nearest to y in squares: neighbours that fall are pooled to their mean."""
    blocks: list[list[float]] = []  # sum, count
    for v in y:
        blocks.append([v, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] > blocks[-1][0] * blocks[-2][1]:
            total, count = blocks.pop()
            blocks[-1][0] += total
            blocks[-1][1] += count
    return [total / count for total, count in blocks for _ in range(int(count))]


def interpolated(x: Column, points: list[tuple[float, float]]) -> Column:
    """Linear between points by rising x, constant beyond the ends; null stays null."""
    out = F.lit(points[-1][1])
    for (x0, y0), (x1, y1) in reversed(list(zip(points, points[1:], strict=False))):
        out = F.when(x < x1, y0 + (y1 - y0) * (x - x0) / (x1 - x0)).otherwise(out)
    return F.when(x.isNull(), F.lit(None).cast("double")).when(x <= points[0][0], F.lit(points[0][1])).otherwise(out)


def reweighted(df: DataFrame, key: str, target: str, indicators: list[str]) -> Column | None:
    """The mean of standardised indicators, weighted by the absolute rank correlation of each with the target; nulls count as 0. None without any correlation."""
    if not indicators:
        return None
    ics = rank_correlation(pair_rows(df, key, indicators, [target]), ["factor"]).where((F.col("n") >= LEAST_PAIRED) & F.col("rho").isNotNull() & ~F.isnan("rho"))
    weights = {r["factor"]: abs(r["rho"]) for r in ics.collect()}  # a row for each indicator
    total = sum(weights.values())
    if total <= 1e-12:
        return None
    return sum((F.coalesce(F.col(c), F.lit(0.0)) * (weights[c] / total) for c in indicators if c in weights), F.lit(0.0))


def corrected(
    df: DataFrame, key: str, factor: str, target: str, indicators: list[str], centre: float = 50.0, spread: float = 10.0, low: float = 0.0, high: float = 100.0
) -> DataFrame:
    """(key, corrected): the factor as it is where its quintiles' mean targets do not fall; else

    the weighted mean of its (standardised) indicators, if its quintiles have as many rising steps at least; then ranks of the factor and of its isotonic
    fit to the target on deciles, blended with 0.6 of the fit (0.1 more for each rising step below 3, 0.9 at most), brought to [low, high],
    standardised and clipped. Rows without a target keep their factor for the standardisation; what is null is the centre. Below LEAST_FITTED rows with both,
    or three bins, the factor stays as the first step leaves it.
    """
    rows = settled(df.select(key, F.round(F.col(factor).cast("double"), 9).alias("_f"), F.col(target).cast("double").alias("_t"), *indicators), "factor")
    base = _quintiles(rows, "_f", "_t")
    if is_monotone(base):
        return rows.select(key, F.col("_f").alias("corrected"))
    candidate = reweighted(rows, key, "_t", indicators)
    if candidate is not None:
        moved = settled(rows.withColumn("_f", F.round(candidate, 9)), "candidate")
        means = _quintiles(moved, "_f", "_t")
        if rising_steps(means) >= rising_steps(base):
            rows, base = moved, means
    both = F.col("_f").isNotNull() & F.col("_t").isNotNull()
    points = sorted((r["x"], r["y"], r["n"]) for r in bin_means(rows, "_f", "_t", DECILES).collect())
    n = sum(p[2] for p in points)
    if n < LEAST_FITTED or len(points) < 3:
        return rows.select(key, F.col("_f").alias("corrected"))
    fit = list(zip([p[0] for p in points], pool_adjacent([p[1] for p in points]), strict=True))
    share = min(0.9, 0.6 + 0.1 * max(0, 3 - rising_steps(base)))
    fitted = settled(rows.withColumns({"_own": F.when(both, F.col("_f")), "_fit": F.when(both, F.round(interpolated(F.col("_f"), fit), 9))}), "fitted")
    ranked = with_rank(with_rank(fitted, "_own", out="_r"), "_fit", out="_s")
    blended = (share * F.col("_s") + (1 - share) * F.col("_r")) / n * (high - low) + low
    scored = settled(ranked.select(key, F.when(both, blended).otherwise(F.col("_f")).alias("_x")), "blended")
    s = scored.agg(F.avg("_x").alias("_m"), F.stddev_samp("_x").alias("_sd"))  # one row
    z = clip((F.col("_x") - F.col("_m")) / F.col("_sd") * spread + centre, low, high)
    out = F.when(F.col("_sd") > 1e-10, z).otherwise(F.col("_x"))
    return scored.crossJoin(F.broadcast(s)).select(key, F.coalesce(out, F.lit(centre)).alias("corrected"))
