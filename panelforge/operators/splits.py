"""Cross-validation: statistics of many splits into training and test groups from one pass over the rows.

A row is not copied into the splits that hold it. For every value, the rows of each group that lie below it and on it are counted (one vector with a number
a group); its rank and its quintile among any union of groups are sums over that vector. So the statistics of all splits, folds as well as every choice of
held-out sectors, are sums that tasks give for a batch of rows at once. Groups are few (folds, sectors); splits and pairs of columns are a handful of names.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions.skew import join_counted
from panelforge.functions.tables import settled
from panelforge.operators.draws import value_counts, vectors
from panelforge.operators.ranking import medians, numbered

BINS = 5
LEAST_PAIRED, LEAST_BINNED = 10, 15
#: Bounds of a factor's weight, and what squares and entropy of the weights cost or add.
LEAST_WEIGHT, MOST_WEIGHT = 0.02, 0.35
SQUARES, ENTROPY = 0.25, 0.05
_SUMS = ["n", "x", "y", "xx", "yy", "xy", "low_n", "low", "high_n", "high"]
_ROWS = 2048


def quasi_temporal_folds(df: DataFrame, size: str, order: str, k: int, key: str = "entity_id") -> DataFrame:
    """df with ``fold`` 0..k-1: rows in as many bins of equal count by size (2 to 5 bins), numbered within them in an order such as age, modulo k.

    Missing sizes and orders are the median's; ties go by key."""
    bins = min(5, max(2, k))
    middles = medians(df, [], size, "_ms").crossJoin(F.broadcast(medians(df, [], order, "_mo")))  # one row
    filled = df.crossJoin(F.broadcast(middles)).withColumns({"_size": F.coalesce(size, "_ms"), "_order": F.coalesce(order, "_mo")}).drop("_ms", "_mo")
    ranked = numbered(filled, [], ["_size", key], "_rank")
    n = df.count()
    binned = ranked.withColumn("_bin", sum(((F.col("_rank") > (n - 1) * F.lit(j / bins)).cast("int") for j in range(1, bins)), F.lit(0)))
    return numbered(binned, ["_bin"], ["_order", key], "_place").withColumn("fold", (F.col("_place") % k).cast("int")).drop("_size", "_order", "_rank", "_bin", "_place")


def held_out_sets(groups: list, many: int) -> dict[str, list]:
    """Every choice of ``many`` groups to hold out, by its name."""
    return {"|".join(map(str, c)): list(c) for c in combinations(groups, many)}


def _split_sums(batches, totals: np.ndarray, training: np.ndarray):
    """Sums of every (pair, split, side) over a task's rows; totals: rows of each pair and group, training: which groups train in each split."""
    sides = np.concatenate([training, ~training]).astype(np.int64)
    size = totals @ sides.T
    base = np.cumsum(totals, axis=0) - totals
    cut = [(size - 1) * k // BINS + 1 for k in (1, BINS - 1)]
    sums = np.zeros((len(totals), len(sides), len(_SUMS)))
    for whole in batches:
        for lo in range(0, whole.num_rows, _ROWS):
            b = whole.slice(lo, _ROWS)
            p, g, y = (b.column(c).to_numpy(zero_copy_only=False) for c in ("part", "group", "y"))
            below_x, own_x, below_y, own_y = (vectors(b.column(c), np.int64) for c in ("x_below", "x_own", "y_below", "y_own"))
            inside = sides.T[g]
            bx = (below_x - base[p]) @ sides.T
            # Ranks from their mean, so that squares stay small.
            rx, ry = (v + (o @ sides.T + 1) / 2 - (size[p] + 1) / 2 for v, o in ((bx, own_x), ((below_y - base[p]) @ sides.T, own_y)))
            low, high = inside * (bx < cut[0][p]), inside * (bx >= cut[1][p])
            each = (inside, inside * rx, inside * ry, inside * rx * rx, inside * ry * ry, inside * rx * ry, low, low * y[:, None], high, high * y[:, None])
            for k, v in enumerate(each):
                np.add.at(sums[:, :, k], p, v)
    if sums.any():
        part, side = np.indices(sums.shape[:2])
        columns = [pa.array(part.ravel().astype(np.int32)), pa.array(side.ravel().astype(np.int32)), *(pa.array(sums[:, :, k].ravel()) for k in range(len(_SUMS)))]
        yield pa.RecordBatch.from_arrays(columns, ["part", "side", *_SUMS])


def split_statistics(long: DataFrame, pairs: list[str], groups: list, splits: dict[str, list]) -> DataFrame:
    """(pair, split, side, n, rho, spread) of rows (pair, group, x, y) for splits (name -> groups that are tested), sides train and test.

    rho is the rank correlation of x and y (null below LEAST_PAIRED rows), spread the mean y of the highest less that of the lowest fifth by x (null below
    LEAST_BINNED rows, or without rows in one). Rows without x or y, or of other pairs and groups, are left out."""
    number = lambda c, names: F.coalesce(*[F.when(F.col(c) == F.lit(v), F.lit(k)) for k, v in enumerate(names)])
    rows = long.where("x is not null and y is not null").select(number("pair", pairs).alias("part"), number("group", groups).alias("group"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    one = F.transform(F.sequence(F.lit(0), F.lit(len(groups) - 1)), lambda k: (k == F.col("group")).cast("int"))
    rows = settled(rows.where("part is not null and `group` is not null").withColumn("draws", one), "rows")
    totals = np.zeros((len(pairs), len(groups)), np.int64)
    for r in rows.groupBy("part", "group").count().collect():  # a row for each pair and group
        totals[r["part"], r["group"]] = r["count"]
    placed = rows
    for c in ("x", "y"):
        counts = value_counts(rows, c, "part").select("part", F.col("value").alias(c), F.col("below").alias(f"{c}_below"), F.col("own").alias(f"{c}_own"), F.col("n").alias("_n"))
        placed = join_counted(placed, counts, ["part", c], "_n", int(totals.sum())).drop("_n")
    training = np.array([[g not in tested for g in groups] for tested in splits.values()], bool).reshape(len(splits), len(groups))
    columns = ["part", "group", "y", "x_below", "x_own", "y_below", "y_own"]
    sums = placed.select(*columns).mapInArrow(lambda it: _split_sums(it, totals, training), f"part int, side int, {', '.join(f'{c} double' for c in _SUMS)}")
    s = sums.groupBy("part", "side").agg(*[F.sum(c).alias(c) for c in _SUMS])
    name = lambda values, at: F.get(F.array(*map(F.lit, values)), at)
    c, n = F.col, F.col("n")
    spread_x, spread_y = n * c("xx") - c("x") * c("x"), n * c("yy") - c("y") * c("y")
    rho = F.when((n >= LEAST_PAIRED) & (spread_x > 0) & (spread_y > 0), (n * c("xy") - c("x") * c("y")) / F.sqrt(spread_x * spread_y))
    ends = F.when((n >= LEAST_BINNED) & (c("low_n") > 0) & (c("high_n") > 0), c("high") / c("high_n") - c("low") / c("low_n"))
    many = len(splits)
    return s.where("n > 0").select(
        name(pairs, c("part")).alias("pair"), name(list(splits), (c("side") % many).cast("int")).alias("split"), F.when(c("side") < many, "train").otherwise("test").alias("side"),
        n.cast("bigint").alias("n"), rho.alias("rho"), ends.alias("spread"),
    )


def bounded_weights(candidates: DataFrame, factors: int, low: float = LEAST_WEIGHT, high: float = MOST_WEIGHT) -> DataFrame:
    """Of candidates (candidate, factor, w), w adding up to 1, those that stay within [low, high] when every weight is low and a share w of the rest."""
    moved = candidates.withColumn("w", low + (1 - factors * low) * F.col("w"))
    return moved.withColumn("_most", F.max("w").over(Window.partitionBy("candidate"))).where(F.col("_most") <= high).drop("_most")


def shrunken_within(ics: DataFrame, by: list[str], value: str, n: str, out: str) -> DataFrame:
    """ics with James-Stein shrinkage of value towards its mean in each group of a few rows; three at most stay, values that do not differ become their mean."""
    w = Window.partitionBy(*by)
    k, mean = F.count(value).over(w), F.avg(value).over(w)
    spread = F.var_pop(value).over(w) * k
    keep = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - (k - 3) * F.avg(1 / F.greatest(F.col(n) - 3, F.lit(1))).over(w) / spread))
    shrunk = F.when(k <= 3, F.col(value)).when(spread <= 1e-12, mean).otherwise(mean + keep * (F.col(value) - mean))
    return ics.withColumn(out, F.when(F.col(value).isNotNull(), shrunk))


def fold_weights(statistics: DataFrame, candidates: DataFrame, sizes: DataFrame) -> DataFrame:
    """(split, candidate, goal, factor, ic, shrunk, w): the candidate weights that each split's training groups prefer.

    statistics has (factor, target, split, side, n, rho, spread), sizes (split, side, rows); a factor's mean training coefficient over targets is shrunk
    within the split, and the goal is the sum of w times it, less SQUARES times the sum of w squared, plus ENTROPY times the entropy; the last name among equals."""
    rows = sizes.where("side = 'train'").select("split", F.col("rows").alias("_rows"))
    ics = statistics.where("side = 'train'").groupBy("split", "factor").agg(F.avg("rho").alias("ic")).join(rows, "split")
    shrunk = settled(shrunken_within(ics, ["split"], "ic", "_rows", "shrunk").drop("_rows"), "ics")
    w = F.col("w")
    goal = F.sum(w * F.coalesce("shrunk", F.lit(0.0))) - SQUARES * F.sum(w * w) - ENTROPY * F.sum(w * F.log(F.greatest(w, F.lit(1e-10))))
    scored = candidates.join(F.broadcast(shrunk), "factor").groupBy("split", "candidate").agg(F.round(goal, 12).alias("goal"))  # splits x factors are few
    best = scored.groupBy("split").agg(F.max(F.struct("goal", "candidate")).alias("b")).select("split", "b.goal", "b.candidate")
    chosen = best.join(candidates, "candidate").join(shrunk, ["split", "factor"])
    # Factors without a coefficient have no weight, the others' add up to 1.
    used = F.when(F.col("shrunk").isNotNull(), w).otherwise(0.0)
    return settled(chosen.withColumn("w", used / F.sum(used).over(Window.partitionBy("split"))), "weights")


def weighted_ratios(statistics: DataFrame, weights: DataFrame, sizes: DataFrame) -> DataFrame:
    """(split, train_ir, test_ir, train_adjusted, test_adjusted, ratio, n_train, n_test): mean over deviation (over targets) of the weighted spreads.

    Adjusted by the root of effective over all rows; sizes has (split, side, rows, effective). Spreads that are missing count as 0."""
    joined = statistics.join(weights.select("split", "factor", "w"), ["split", "factor"])
    spreads = joined.groupBy("split", "side", "target").agg(F.sum(F.col("w") * F.coalesce("spread", F.lit(0.0))).alias("s"))
    sd = F.stddev_samp("s")
    ir = spreads.groupBy("split", "side").agg(F.when((F.count("s") > 1) & (sd > 1e-12), F.avg("s") / sd).alias("ir")).join(sizes, ["split", "side"])
    own = ir.withColumn("adjusted", F.col("ir") * F.sqrt(F.col("effective") / F.col("rows")))
    pick = lambda side, c: F.max(F.when(F.col("side") == side, F.col(c)))
    out = own.groupBy("split").agg(*[pick(s, c).alias(f"{s}_{c}") for s in ("train", "test") for c in ("ir", "adjusted", "rows")])
    ratio = F.when(F.abs("test_adjusted") > 1e-12, F.col("train_adjusted") / F.col("test_adjusted"))
    return out.select("split", "train_ir", "test_ir", "train_adjusted", "test_adjusted", ratio.alias("ratio"), F.col("train_rows").alias("n_train"), F.col("test_rows").alias("n_test"))


def split_sizes(df: DataFrame, group: str, sector: str, splits: dict[str, list]) -> DataFrame:
    """(split, side, rows, effective): rows of each side, and the effective number that their spread over sectors leaves (null sectors are not counted in it)."""
    counts = df.groupBy(F.col(group).alias("_g"), F.col(sector).alias("_s")).agg(F.count(F.lit(1)).cast("double").alias("_n"))
    tested = lambda names: F.coalesce(F.col("_g").isin(names), F.lit(False)) if names else F.lit(False)
    sides = F.array(*[F.struct(F.lit(s).alias("split"), F.when(tested(names), "test").otherwise("train").alias("side")) for s, names in splits.items()])
    by_sector = counts.select(F.explode(sides).alias("x"), "_s", "_n").groupBy("x.split", "x.side", "_s").agg(F.sum("_n").alias("n"))
    known = F.when(F.col("_s").isNotNull(), F.col("n"))
    out = by_sector.groupBy("split", "side").agg(F.sum("n").cast("bigint").alias("rows"), (F.sum(known) * F.sum(known) / F.sum(known * known)).alias("effective"))
    return out.withColumn("effective", F.coalesce("effective", F.col("rows").cast("double")))


def pair_name(factor: Column | str, target: Column | str) -> Column:
    return F.concat_ws("~", factor, target)
