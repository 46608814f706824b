"""Resampling and weight sensitivity: replicates and candidate weights are rows, never driver loops."""

from __future__ import annotations

from functools import reduce
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions.expressions import uniform
from panelforge.functions.tables import settled
from panelforge.functions.uniforms import uniforms
from panelforge.operators import rank_intervals
from panelforge.operators.ranking import cumulative, numbered, with_bin

#: Rows (replicates x entities) that one batch of replicates makes at most.
BATCH_ROWS = 200_000_000
#: Cells (rows x replicates or candidates) that a task works on at once.
CELLS = 1_000_000


def weight_rows(spark, candidates: dict[str, dict[str, float]]) -> DataFrame:
    """(candidate, factor, w), each candidate's weights scaled to add up to 1."""
    rows = [(c, f, float(w) / sum(ws.values())) for c, ws in candidates.items() for f, w in ws.items()]
    return spark.createDataFrame(rows, "candidate string, factor string, w double")


def grid(values: dict[str, list[float]], rest: list[str], least_rest: float = 0.15) -> dict[str, dict[str, float]]:
    """Candidates over a grid of some factors' weights; what is left, if at least ``least_rest``, is dealt evenly to the others."""
    out = {}
    for point in product(*values.values()):
        left = 1 - sum(point)
        if left >= least_rest - 1e-12:
            name = "-".join(f"{p:.2f}" for p in point)
            out[name] = dict(zip(values, point, strict=True)) | {r: left / len(rest) for r in rest}
    return out


def one_at_a_time(base: dict[str, float], changes: list[float]) -> dict[str, dict[str, float]]:
    """Candidates with one weight changed by a share."""
    return {f"{f}{c:+.2f}": base | {f: base[f] * (1 + c)} for f in base for c in changes}


def ablations(base: dict[str, float]) -> dict[str, dict[str, float]]:
    """Candidates with one factor left out."""
    return {f"without_{f}": {g: w for g, w in base.items() if g != f} for f in base}


def perturbed(weights: DataFrame, replicates: tuple[int, int], share: float, seed: int) -> DataFrame:
    """(candidate, replicate, factor, w) of replicates first to last: weights changed by a uniform share of up to +-share and scaled to 1 again."""
    r = _repeated(weights, *replicates)
    moved = r.withColumn("w", F.col("w") * (1 + share * (2 * uniform(F.lit(seed), F.col("replicate"), F.col("candidate"), F.col("factor")) - 1)))
    return moved.withColumn("w", F.col("w") / F.sum("w").over(Window.partitionBy("candidate", "replicate")))


def evaluated(long: DataFrame, weights: DataFrame, key: str = "entity_id") -> DataFrame:
    """(key, candidate keys, score) of long (key, factor, x) under each weight vector: one join on the factor and one sum."""
    names = [c for c in weights.columns if c not in ("factor", "w")]
    return long.join(F.broadcast(weights), "factor").groupBy(key, *names).agg(F.round(F.sum(F.col("w") * F.col("x")), 8).alias("score"))


def top_sets(scores: DataFrame, n: int, names: list[str], key: str = "entity_id") -> DataFrame:
    """scores' n best rows of each candidate, smaller keys first among equals."""
    w = Window.partitionBy(*names).orderBy(F.desc("score"), key)
    return scores.withColumn("position", F.row_number().over(w)).where(F.col("position") <= n)


def ratio_of_top(scores: DataFrame, returns: DataFrame, n: int, names: list[str], key: str = "entity_id") -> DataFrame:
    """(names, mean, std, cs_ir) of the returns (key, ret) of each candidate's n best; cs_ir is 0 where the returns don't vary."""
    r = top_sets(scores, n, names, key).join(returns, key)
    out = r.groupBy(*names).agg(F.avg("ret").alias("mean"), F.stddev_samp("ret").alias("std"))
    return out.withColumn("cs_ir", F.when(F.col("std") > 1e-12, F.col("mean") / F.col("std")).otherwise(0.0))


def overlap_with_base(scores: DataFrame, base: DataFrame, n: int, names: list[str], key: str = "entity_id") -> DataFrame:
    """(names, overlap): share of base's n best (key, score) among each candidate's."""
    best = base.orderBy(F.desc("score"), key).limit(n).select(key, F.lit(1).alias("_in"))
    return top_sets(scores, n, names, key).join(F.broadcast(best), key, "left").groupBy(*names).agg((F.count("_in") / n).alias("overlap"))


def batches(rows: int, replicates: int) -> list[tuple[int, int]]:
    """Ranges of replicates (first, last) so that rows times replicates stays within BATCH_ROWS."""
    size = max(1, BATCH_ROWS // max(rows, 1))
    return [(a, min(a + size, replicates) - 1) for a in range(0, replicates, size)]


def in_batches(rows: DataFrame, replicates: int, of) -> DataFrame:
    """``of(first, last)``, a frame for a range of replicates, for all of them: batch by batch, each settled, where one frame would be too large."""
    parts = [of(*b) for b in batches(rows.count(), replicates)]
    return parts[0] if len(parts) == 1 else reduce(lambda a, b: a.unionByName(b), [settled(p, "replicates") for p in parts])


def _repeated(rows: DataFrame, first: int, last: int) -> DataFrame:
    return rows.withColumn("replicate", F.explode(F.sequence(F.lit(first), F.lit(last))))


def poisson_weight(u: Column, most: int = 8) -> Column:
    """Number of times a row is drawn in a bootstrap replicate: the Poisson(1) quantile of a uniform number."""
    out, total = F.lit(most), 0.0
    steps = []
    p = 2.718281828459045**-1
    for k in range(most):
        total += p
        steps.append((k, total))
        p /= k + 1
    for k, limit in reversed(steps):
        out = F.when(u < limit, k).otherwise(out)
    return out


def bootstrap(rows: DataFrame, replicates: tuple[int, int], seed: int, key: str = "entity_id") -> DataFrame:
    """rows for each replicate (first to last) that draws them, with the number of draws ``m`` (Poisson bootstrap: replicates need no count of rows)."""
    return _repeated(rows, *replicates).withColumn("m", poisson_weight(uniform(F.lit(seed), F.col("replicate"), F.col(key)))).where("m > 0")


def weighted_rank_correlation(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, rho, n) of (x, y, m): rank correlation where a row counts m times."""

    def ranked(df: DataFrame, c: str) -> DataFrame:
        rank = F.col("below") + (F.col("n") + 1) / 2
        return df.join(cumulative(df, by, c, "m").select(*by, c, rank.alias(f"_r{c}")), [*by, c])

    r = ranked(ranked(settled(rows, "draws"), "x"), "y")
    m, x, y = F.col("m"), F.col("_rx"), F.col("_ry")
    s = r.groupBy(*by).agg(F.sum(m).alias("n"), *[F.sum(m * e).alias(n) for n, e in (("sx", x), ("sy", y), ("sxx", x * x), ("syy", y * y), ("sxy", x * y))])
    n = F.col("n")
    return s.select(*by, ((n * F.col("sxy") - F.col("sx") * F.col("sy")) / F.sqrt((n * F.col("sxx") - F.col("sx") * F.col("sx")) * (n * F.col("syy") - F.col("sy") * F.col("sy")))).alias("rho"), "n")


def subsample(rows: DataFrame, replicates: tuple[int, int], share: float, seed: int, key: str = "entity_id") -> DataFrame:
    """rows in each replicate (first to last) whose uniform number is below ``share``."""
    return _repeated(rows, *replicates).where(uniform(F.lit(seed), F.col("replicate"), F.col(key)) < share)


def subsample_tops(scores: DataFrame, replicates: int, share: float, n: int, seed: int, key: str = "entity_id") -> DataFrame:
    """(key, drawn, n) of scores (key, score): how many subsamples (see ``subsample``) an entity is in, and how many have it among their n best.

    A task counts its rows and passes on the n best of each batch in each replicate; no row is copied for the replicates."""

    def of(batches):
        for batch in batches:
            t = pa.Table.from_batches([batch]).sort_by([("score", "descending"), (key, "ascending")])
            ids, drawn, tops = t.column("_id").to_pylist(), np.zeros(t.num_rows, np.int64), []
            step = max(1, CELLS // max(1, t.num_rows))
            for lo in range(0, replicates, step):
                numbers = range(lo, min(lo + step, replicates))
                inside = uniforms(seed, numbers, ids) < share
                drawn += inside.sum(1)
                r, i = np.nonzero((inside & (np.cumsum(inside, axis=0) <= n)).T)
                tops.append((r + lo, i))
            if t.num_rows:
                replicate, i = map(np.concatenate, zip(*tops, strict=True))
                rows = t.select([key, "score"])
                yield from rows.append_column("drawn", pa.array(drawn)).append_column("replicate", pa.nulls(len(drawn), pa.int32())).to_batches()
                yield from rows.take(pa.array(i)).append_column("drawn", pa.nulls(len(i), pa.int64())).append_column("replicate", pa.array(replicate.astype(np.int32))).to_batches()

    kind = scores.schema[key].dataType.simpleString()
    rows = scores.select(key, F.col("score").cast("double").alias("score"), F.col(key).cast("string").alias("_id"))
    both = settled(rows.mapInArrow(of, f"`{key}` {kind}, score double, drawn bigint, replicate int"), "subsamples")
    inside = top_sets(both.where("replicate is not null"), n, ["replicate"], key).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return both.where("drawn > 0").select(key, "drawn").join(inside, key, "left").fillna(0, ["n"])


def candidate_tops(long: DataFrame, weights: DataFrame, n: int, key: str = "entity_id") -> DataFrame:
    """(candidate, key, score) of long (key, factor, x): rows of ``evaluated`` that hold each candidate's n best (smaller keys first among equals).

    Each task multiplies its rows with all weight vectors and passes on the n best of each batch, so no row is copied for the candidates."""
    names, factors, w = _weight_vectors(weights)
    return _tops(_wide(long, factors, key), names, w, n, key)


def _weight_vectors(weights: DataFrame) -> tuple[list[str], list[str], np.ndarray]:
    """Candidates, factors and the weights of each candidate, which every task gets."""
    given = weights.groupBy("candidate").agg(F.map_from_entries(F.collect_list(F.struct("factor", "w"))).alias("w")).collect()
    names = [r["candidate"] for r in given]
    factors = sorted({f for r in given for f in r["w"]})
    return names, factors, np.array([[r["w"].get(f, 0.0) for f in factors] for r in given]).reshape(len(names), len(factors))


def _wide(long: DataFrame, factors: list[str], key: str) -> DataFrame:
    """(key, _x0, _x1, ...): a column for each factor."""
    return long.where(F.col("factor").isin(factors)).groupBy(key).agg(*[F.max(F.when(F.col("factor") == f, F.col("x"))).alias(f"_x{k}") for k, f in enumerate(factors)])


def _tops(wide: DataFrame, names: list[str], w: np.ndarray, n: int, key: str) -> DataFrame:
    """See ``candidate_tops``; of wide rows and weights w (names x factors)."""

    def of(batches):
        for batch in batches:
            t = pa.Table.from_batches([batch]).sort_by(key)
            x = [t.column(f"_x{k}").to_numpy() for k in range(w.shape[1])]
            step = max(1, CELLS // max(1, t.num_rows))
            for lo in range(0, len(names) if t.num_rows else 0, step):
                score = rank_intervals.weighted_sums(x, w[lo : lo + step])
                least = np.partition(score, -n, axis=1)[:, -n] if t.num_rows > n else np.full(len(score), -np.inf)
                c, i = np.nonzero(score >= least[:, None])
                s = score[c, i]
                order = np.lexsort((i, -s, c))
                c, i, s = c[order], i[order], s[order]
                kept = np.arange(len(c)) - np.searchsorted(c, c) < n
                yield pa.RecordBatch.from_arrays([pa.array([names[lo + j] for j in c[kept]]), t.column(key).take(pa.array(i[kept])).combine_chunks(), pa.array(s[kept])], ["candidate", key, "score"])

    return wide.mapInArrow(of, f"candidate string, `{key}` {wide.schema[key].dataType.simpleString()}, score double")


def rank_stability(long: DataFrame, weights: DataFrame, replicates: int, share: float, n: int, seed: int, steady: float = 5.0, key: str = "entity_id") -> DataFrame:
    """(key, mean_rank, std_rank, low_rank, high_rank, kept, stable) of every entity over replicates of changed weights: ``kept`` is the share that has it among the n best, ``stable`` a deviation below ``steady``."""

    moved = perturbed(weights, (0, replicates - 1), share, seed).select(F.col("replicate").cast("string").alias("candidate"), "factor", "w")
    names, factors, w = _weight_vectors(moved)
    wide = settled(_wide(long, factors, key), "factors")
    scored = wide.where(F.coalesce(*[f"_x{k}" for k in range(len(factors))]).isNotNull())
    ranks = rank_intervals.ranks_by_weights(scored, [f"_x{k}" for k in range(len(factors))], w, key)
    inside = top_sets(_tops(scored, names, w, n, key), n, ["candidate"], key).groupBy(key).agg(F.count(F.lit(1)).alias("in"))
    each = wide.select(key).join(ranks, key, "left").join(inside, key, "left")
    std = F.col("std")
    return each.select(key, F.col("mean").alias("mean_rank"), std.alias("std_rank"), F.col("lo").alias("low_rank"), F.col("hi").alias("high_rank"), (F.coalesce("in", F.lit(0)) / replicates).alias("kept"), (std < steady).alias("stable"))


def draw_stability(scores: DataFrame, replicates: int, seed: int, tops: tuple[int, ...] = (10, 20), near: int = 10, key: str = "entity_id") -> DataFrame:
    """(metric, mean, std) over bootstrap draws of scores (key, score), every entity counted once: overlap of each draw's best with the best of all, and
    the rank correlation of successive draws and the share of entities within ``near`` ranks. Rows without a score are left out.

    No row is copied for the draws: a draw's best that are among the best of all are those of them that are drawn, ranks come from totals of chunks in the order
    of scores, and as ranks of both draws fall with the score, those of the entities in both are the same, their correlation 1 wherever two scores differ."""
    present = 1 - 2.718281828459045**-1  # of a Poisson(1) draw
    rows = settled(scores.where("score is not null").select(key, F.col("score").cast("double").alias("score")), "scores")
    steps = rank_intervals.successive(rows, lambda ids: (uniforms(seed, range(replicates), ids) < present).astype(np.int64), near, key)
    frames = []
    for n in tops:
        best = rows.orderBy(F.desc("score"), key).limit(n)
        inside = _repeated(best, 0, replicates - 1).groupBy("replicate").agg(F.sum((uniform(F.lit(seed), F.col("replicate"), F.col(key)) < present).cast("double")).alias("value"))
        frames.append(inside.join(steps.where("drawn > 0"), "replicate").select("value", F.lit(f"top{n}_overlap").alias("metric")))
    both = steps.where("both > 0")
    frames.append(both.select(F.when(F.col("high") > F.col("low"), 1.0).alias("value"), F.lit("successive_correlation").alias("metric")))
    frames.append(both.select((100 * F.col("within") / F.col("both")).alias("value"), F.lit(f"pct_within_{near}").alias("metric")))
    return reduce(lambda a, b: a.unionByName(b), frames).groupBy("metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


def double_halve(base: dict[str, float], most: float = 0.5, least: float = 0.01) -> dict[str, dict[str, float]]:
    """Candidates with one factor's share doubled (to ``most`` at most) and another's halved."""
    share = {f: w / sum(base.values()) for f, w in base.items()}
    return {f"{a}+{b}-": share | {a: min(most, 2 * share[a]), b: max(least, share[b] / 2)} for a in share for b in share if a != b}


def random_weights(spark, factors: list[str], n: int, seed: int, name: str = "") -> DataFrame:
    """(candidate, factor, w): n evenly random weight vectors (Dirichlet with parameters 1, from exponential numbers)."""
    names = spark.range(n).select(F.concat(F.lit(name), F.col("id").cast("string")).alias("candidate"), F.explode(F.array(*map(F.lit, factors))).alias("factor"))
    drawn = names.withColumn("w", -F.log(F.greatest(uniform(F.lit(seed), F.col("candidate"), F.col("factor")), F.lit(1e-12))))
    return drawn.withColumn("w", F.col("w") / F.sum("w").over(Window.partitionBy("candidate")))


def best_candidates(table: DataFrame) -> DataFrame:
    """(goal, candidate, mean, std, cs_ir) of a table of candidates: largest ratio, least deviation, largest mean; the first name among equals."""
    pick = lambda goal, order: table.where("std is not null").orderBy(order, "candidate").limit(1).select(F.lit(goal).alias("goal"), "candidate", "mean", "std", "cs_ir")
    return pick("best_ratio", F.desc("cs_ir")).union(pick("least_risk", F.asc("std"))).union(pick("largest_return", F.desc("mean")))


def weights_cross_validated(scores: DataFrame, returns: DataFrame, folds: DataFrame, weights: DataFrame, n: int, key: str = "entity_id") -> DataFrame:
    """(fold, candidate, train_ir, test_ir, hhi, overfit) of the candidate with the best ratio outside each fold, judged inside it; scores (key, candidate, score), folds (key, fold)."""
    places = scores.join(folds, key)
    number = folds.select(F.col("fold").alias("held")).distinct()
    tagged = settled(places.join(F.broadcast(number), F.lit(True)).withColumn("test", F.col("fold") == F.col("held")), "folds")  # a few folds
    table = settled(ratio_of_top(tagged.select(key, "candidate", "score", "held", "test"), returns, n, ["held", "test", "candidate"], key), "fold_ratios")
    train = table.where("not test").groupBy("held").agg(F.max(F.struct(F.col("cs_ir"), F.col("candidate"))).alias("b")).select("held", F.col("b.candidate").alias("candidate"), F.col("b.cs_ir").alias("train_ir"))
    out = train.join(table.where("test").select("held", "candidate", F.col("cs_ir").alias("test_ir")), ["held", "candidate"], "left")
    hhi = weights.groupBy("candidate").agg(F.sum(F.col("w") * F.col("w")).alias("hhi"))
    return out.join(hhi, "candidate").select(F.col("held").alias("fold"), "candidate", "train_ir", "test_ir", "hhi", (F.col("train_ir") / F.when(F.col("test_ir") != 0, F.col("test_ir"))).alias("overfit"))


def folds(df: DataFrame, size: str, k: int, bins: int, key: str = "entity_id") -> DataFrame:
    """df with ``fold`` 0..k-1: entities numbered by a hash within size bins, modulo k; no task needs a whole bin."""
    binned = with_bin(df, size, bins, out="_bin").withColumn("_u", uniform(F.lit("fold"), F.col(key)))
    return numbered(binned, ["_bin"], ["_u", key], "_place").withColumn("fold", (F.col("_place") % k).cast("int")).drop("_bin", "_u", "_place")


def restandardised(df: DataFrame, column: str, group: str) -> DataFrame:
    """df with ``z``: each row standardised by the mean and deviation of all groups but its own, from totals less the group's sums."""
    g = df.groupBy(group).agg(F.count(column).alias("n"), F.sum(column).alias("s"), F.sum(F.col(column) * F.col(column)).alias("q"))
    t = g.agg(F.sum("n").alias("tn"), F.sum("s").alias("ts"), F.sum("q").alias("tq"))
    rest = g.crossJoin(F.broadcast(t)).select(group, (F.col("tn") - F.col("n")).alias("_n"), (F.col("ts") - F.col("s")).alias("_s"), (F.col("tq") - F.col("q")).alias("_q"))
    var = (F.col("_q") - F.col("_s") * F.col("_s") / F.col("_n")) / (F.col("_n") - 1)
    return df.join(rest, group).withColumn("z", (F.col(column) - F.col("_s") / F.col("_n")) / F.sqrt(var)).drop("_n", "_s", "_q")


def turnover(scores: DataFrame, replicates: int, share: float, n: int, seed: int, cost: float, key: str = "entity_id") -> DataFrame:
    """(replicate, turnover, cost): share of the n best that a random change of scores by up to +-share replaces."""
    r = scores.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    moved = r.withColumn("score", F.round(F.col("score") * (1 + share * (2 * uniform(F.lit(seed), F.col("replicate"), F.col(key)) - 1)), 8))
    o = overlap_with_base(moved, scores, n, ["replicate"], key)
    return o.select("replicate", (1 - F.col("overlap")).alias("turnover"), ((1 - F.col("overlap")) * 2 * cost).alias("cost"))


def turnover_levels(scores: DataFrame, levels: list[float], replicates: int, n: int, seed: int, key: str = "entity_id") -> DataFrame:
    """(level, overlap, turnover, std, low, high): means over random changes of scores (key, score) by up to each level, the turnover's deviation and quartiles."""
    spread = F.explode(F.array(*map(F.lit, levels))).alias("level")
    rows = scores.select(key, "score", spread).withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    move = 2 * uniform(F.lit(seed), F.col("level").cast("string"), F.col("replicate"), F.col(key)) - 1
    moved = rows.select(key, "level", "replicate", F.round(F.col("score") * (1 + F.col("level") * move), 8).alias("score"))
    o = overlap_with_base(moved, scores, n, ["level", "replicate"], key)
    t = 1 - F.col("overlap")
    quartile = lambda p: F.percentile(t, F.lit(p))
    return o.groupBy("level").agg(F.avg("overlap").alias("overlap"), F.avg(t).alias("turnover"), F.stddev_pop(t).alias("std"), quartile(0.25).alias("low"), quartile(0.75).alias("high"))


def market_impact(value: Column, volume: Column, volatility: Column) -> Column:
    """Square-root impact in basis points of trading ``value`` against daily ``volume``, sigma * 1e4 * sqrt(participation); 0 without value or volume."""
    return F.when((volume > 0) & (value > 0), 1e4 * volatility * F.sqrt(value / volume)).otherwise(0.0)


def capacity(df: DataFrame, tiers: list[float], weight: str, volume: str, most: float = 0.1) -> DataFrame:
    """(tier, mean_participation, pass_rate): positions of each size of assets against daily volume; a position passes up to ``most``."""
    t = df.select(F.col(weight).alias("_w"), F.col(volume).alias("_v"), F.explode(F.array(*map(F.lit, tiers))).alias("tier"))
    p = F.col("tier") * F.col("_w") / F.when(F.col("_v") > 0, F.col("_v"))
    return t.groupBy("tier").agg(F.avg(p).alias("mean_participation"), F.avg((p <= most).cast("int")).alias("pass_rate"))
