"""Search for weights within bounds around those that principal components suggest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.functions.tables import settled
from panelforge.operators.resampling import evaluated, ratio_of_top, weight_rows

#: Reach around a suggested weight and step within it, least and most weight, passes.
REACH, STEP, LEAST, MOST, PASSES = 0.05, 0.025, 0.02, 0.40, 3


def steps_around(weight: float, reach: float = REACH, step: float = STEP) -> list[float]:
    """Candidate weights from weight - reach to weight + reach, within the bounds."""
    low, high = max(LEAST, weight - reach), min(MOST, weight + reach)
    out = []
    while low + len(out) * step < high + step / 2 - 1e-12:
        out.append(low + len(out) * step)
    return out


def scaled(weights: dict[str, float], fixed: dict[str, float]) -> dict[str, float]:
    """weights brought to what the fixed ones leave of 1, with these."""
    left, total = 1 - sum(fixed.values()), sum(weights.values())
    return {f: w * left / total for f, w in weights.items()} | fixed


def coordinate_search(long: DataFrame, returns: DataFrame, start: dict[str, float], n: int, fixed: dict[str, float] | None = None, passes: int = PASSES) -> tuple[dict[str, float], float, int]:
    """(weights, ratio, evaluations): weights near ``start`` whose n best rows have the largest ratio of mean to deviation of returns.

    One weight after another takes the best of its steps, the others staying; a step counts only if it beats the best so far. All steps of a weight are
    candidates of one job over long (key, factor, x); a pass without improvement ends the search. Candidates are scaled to add up to 1 with the fixed ones."""
    spark, fixed = long.sparkSession, fixed or {}
    long, returns = settled(long, "factors"), settled(returns, "returns")

    def ratios(candidates: dict[str, dict[str, float]]) -> dict[str, float]:
        scores = evaluated(long, weight_rows(spark, {name: scaled(w, fixed) for name, w in candidates.items()}))
        return {r["candidate"]: r["cs_ir"] for r in ratio_of_top(scores, returns, n, ["candidate"]).collect()}  # a few candidates

    current, count = dict(start), 1
    best = round(ratios({"start": current}).get("start", 0.0), 9)
    for _ in range(passes):
        improved = False
        for factor in start:
            steps = steps_around(start[factor])
            found = ratios({str(k): current | {factor: w} for k, w in enumerate(steps)})
            count += len(steps)
            for k, w in enumerate(steps):
                if round(found.get(str(k), 0.0), 9) > best:
                    best, current[factor], improved = round(found[str(k)], 9), w, True
        if not improved:
            break
    return scaled(current, fixed), best, count


def search_table(long: DataFrame, returns: DataFrame, start: dict[str, float], n: int, fixed: dict[str, float] | None = None) -> DataFrame:
    """(factor, start, low, high, weight, ratio, evaluations) of a coordinate search, a row per factor; fixed factors have no start and bounds."""
    weights, ratio, count = coordinate_search(long, returns, start, n, fixed)
    bounds = lambda w: (max(LEAST, w - REACH), min(MOST, w + REACH))
    rows = [(f, start[f], *bounds(start[f]), w, ratio, count) if f in start else (f, None, None, None, w, ratio, count) for f, w in weights.items()]
    return long.sparkSession.createDataFrame(rows, "factor string, start double, low double, high double, weight double, ratio double, evaluations int")


def weight_distances(a: dict[str, float], b: dict[str, float], spark) -> DataFrame:
    """(l1, l2, largest, cosine) between two weight vectors, each scaled to add up to 1."""
    pairs = [(a[f] / sum(a.values()), b.get(f, 0.0) / sum(b.values())) for f in a]
    rows = spark.createDataFrame(pairs, "a double, b double")
    d = F.col("a") - F.col("b")
    cosine = F.sum(F.col("a") * F.col("b")) / F.sqrt(F.sum(F.col("a") * F.col("a")) * F.sum(F.col("b") * F.col("b")))
    return rows.agg(F.sum(F.abs(d)).alias("l1"), F.sqrt(F.sum(d * d)).alias("l2"), F.max(F.abs(d)).alias("largest"), cosine.alias("cosine"))
