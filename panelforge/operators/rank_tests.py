"""Rank tests of every group against one reference group, for all scores in one pass.

For every value the rows of each group below it and on it are counted (one vector with a number a group), so a Mann-Whitney statistic of any two groups is a
sum over the values: no row is ranked again for a comparison, and no pair of groups needs a pass of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.functions.expressions import two_sided
from panelforge.functions.tables import settled
from panelforge.operators.draws import value_counts

LEAST = 5
SIGNIFICANT, LARGE = 0.05, 0.3


def against_reference(long: DataFrame, scores: list[str], groups: list[str], reference: str) -> DataFrame:
    """(score, group, n, mean, std, difference, u, z, p, rank_biserial, significant, risk) of rows (score, group, value) for each group.

    u counts pairs in which the reference is larger (ties by half), with the tie-corrected normal approximation; rank_biserial is 1 - 2 u / (n n'). The
    reference itself, and groups where either has fewer than LEAST rows, have moments only. risk is HIGH for a significant difference with an effect beyond
    LARGE, MODERATE for another significant one. Rows without a value, or of other scores and groups, are left out."""
    number = lambda c, names: F.coalesce(*[F.when(F.col(c) == F.lit(v), F.lit(k)) for k, v in enumerate(names)])
    rows = long.where("value is not null").select(number("score", scores).alias("part"), number("group", groups).alias("g"), F.col("value").cast("double").alias("value"))
    one = F.transform(F.sequence(F.lit(0), F.lit(len(groups) - 1)), lambda k: (k == F.col("g")).cast("int"))
    rows = settled(rows.where("part is not null and g is not null").withColumn("draws", one), "rows")
    moments = rows.groupBy("part", "g").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
    moments = settled(moments, "moments")  # a row for each score and group
    ref = groups.index(reference)
    counts = value_counts(rows, "value", "part")
    each = counts.select("part", F.posexplode("own").alias("g", "own"), "below", F.get("own", F.lit(ref)).alias("_r"))
    # Of the pairs of a row of the group with the reference: those in which the reference lies below, counted from the start of the score.
    below = F.get("below", F.lit(ref)).cast("double")
    own, r = F.col("own").cast("double"), F.col("_r").cast("double")
    tied = own + r
    s = each.groupBy("part", "g").agg(F.sum(own * (below + r / 2)).alias("_under"), F.sum(tied * tied * tied - tied).alias("_ties"), F.sum(own).alias("_own"))
    base = {row["part"]: 0 for row in moments.select("part").distinct().collect()}  # a row per score
    size = {row["part"]: row["n"] for row in moments.where(F.col("g") == ref).collect()}
    started = 0
    for part in sorted(base):
        base[part], started = started, started + size.get(part, 0)
    lookup = lambda values: F.get(F.array(*[F.lit(float(values.get(k, 0))) for k in range(len(scores))]), F.col("part"))
    reference_rows = moments.where(F.col("g") == ref).select("part", F.col("n").alias("_n1"), F.col("mean").alias("_mean1"))
    joined = moments.join(s, ["part", "g"]).join(reference_rows, "part", "left")
    n1, n2 = F.col("_n1").cast("double"), F.col("n").cast("double")
    enough = (F.col("g") != ref) & (n1 >= LEAST) & (n2 >= LEAST)
    u = n1 * n2 - (F.col("_under") - lookup(base) * F.col("_own"))
    n = n1 + n2
    var = n1 * n2 / 12 * ((n + 1) - F.col("_ties") / (n * (n - 1)))
    out = joined.withColumn("u", F.when(enough, u)).withColumn("z", F.when(enough & (var > 0), (u - n1 * n2 / 2) / F.sqrt(F.when(var > 0, var))))
    out = out.withColumns({"p": F.when(F.col("z").isNotNull(), two_sided(F.col("z"))), "rank_biserial": F.when(enough, 1 - 2 * F.col("u") / (n1 * n2))})
    low = F.col("p") < SIGNIFICANT
    risk = F.when(F.col("p").isNull(), None).when(low & (F.abs("rank_biserial") > LARGE), "HIGH").when(low, "MODERATE").otherwise("LOW")
    name = lambda values, at: F.get(F.array(*map(F.lit, values)), F.col(at))
    return out.select(
        name(scores, "part").alias("score"), name(groups, "g").alias("group"), "n", "mean", "std", F.when(enough, F.col("_mean1") - F.col("mean")).alias("difference"),
        "u", "z", "p", "rank_biserial", low.alias("significant"), risk.alias("risk"),
    )
