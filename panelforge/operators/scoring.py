"""Normalisation, hierarchical scores and preference scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.functions.expressions import clip, probit
from panelforge.functions.tables import settled
from panelforge.operators.ranking import median_deviation, quantiles, rank_columns, with_rank

DIRECTIONS = {"zscore": lambda x: -x, "robust": lambda x: -x, "minmax": lambda x: 1 - x, "percentile": lambda x: 100 - x}


def normalised(long: DataFrame, method: str, by: list[str] | None = None, inverse: list[str] | None = None) -> DataFrame:
    """long (indicator, value, ...) with ``norm``: zscore, minmax, percentile (0..100) or robust, over all rows or within ``by``; indicators in ``inverse`` are flipped (negated, 1 - x, 100 - x). A constant column gets 0 (50 for percentile by its ranks)."""
    keys = ["indicator", *(by or [])]
    v = F.col("value")
    if method == "percentile":
        out = with_rank(long, "value", keys, "_r", pct=True).withColumn("norm", 100 * F.col("_r")).drop("_r")
    elif method == "robust":
        out = robust_z(long, keys)
    else:
        s = long.groupBy(*keys).agg(F.avg(v).alias("_m"), F.stddev_samp(v).alias("_s"), F.min(v).alias("_lo"), F.max(v).alias("_hi"))
        spread = F.col("_hi") - F.col("_lo")
        norm = (v - F.col("_m")) / (F.col("_s") + 1e-10) if method == "zscore" else F.when(spread > 0, (v - F.col("_lo")) / spread).otherwise(F.when(v.isNotNull(), 0.0))
        out = long.join(s, keys, "left").withColumn("norm", norm).drop("_m", "_s", "_lo", "_hi")
    if inverse:
        out = out.withColumn("norm", F.when(F.col("indicator").isin(inverse), DIRECTIONS[method](F.col("norm"))).otherwise(F.col("norm")))
    return out


def robust_z(long: DataFrame, by: list[str], limit: float = 3.0, value: str = "value", out: str = "norm") -> DataFrame:
    """long with (x - median) / (1.4826 MAD) clipped to +-limit; by mean and population deviation where MAD is 0; 0 where all values are equal."""
    middle = median_deviation(long, by, value)
    s = long.groupBy(*by).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s")).join(middle, by) if by else long.agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s")).crossJoin(middle)
    v = F.col(value)
    z = F.when(F.col("mad") > 1e-10, (v - F.col("median")) / (1.4826 * F.col("mad"))).when(F.col("_s") > 1e-10, (v - F.col("_m")) / F.col("_s")).otherwise(F.when(v.isNotNull(), 0.0))
    joined = long.join(s, by, "left") if by else long.crossJoin(F.broadcast(s))
    return joined.withColumn(out, clip(z, -limit, limit)).drop("_m", "_s", "median", "mad")


def orthogonalised(df: DataFrame, column: str, against: str, out: str) -> DataFrame:
    """df with column less beta times ``against``; beta from rows where both are there."""
    both = F.col(column).isNotNull() & F.col(against).isNotNull()
    beta = df.where(both).agg((F.covar_samp(column, against) / F.var_samp(against)).alias("_beta"))
    return df.crossJoin(F.broadcast(beta)).withColumn(out, F.col(column) - F.col("_beta") * F.col(against)).drop("_beta")


def normal_scores(df: DataFrame, column: str, out: str, by: list[str] | None = None) -> DataFrame:
    """df with the normal quantile of the percentile rank, kept in 0.01..0.99."""
    return with_rank(df, column, by, "_p", pct=True).withColumn(out, probit(clip(F.col("_p"), 0.01, 0.99))).drop("_p")


def adaptive_z(long: DataFrame, inverse: list[str], small: int = 20, medium: int = 100, skewed: float = 2.0) -> DataFrame:
    """long with ``norm``: normal scores for columns of fewer than ``small`` values or an absolute skewness over ``skewed``, robust z below ``medium`` values, else z; clipped to +-3, flipped for ``inverse``, 0 for nulls."""
    n = long.groupBy("indicator").agg(F.count("value").alias("_n"), F.skewness("value").alias("_g"), F.avg("value").alias("_m"), F.stddev_samp("value").alias("_s"))
    each = normal_scores(robust_z(long, ["indicator"], out="_robust"), "value", "_normal", ["indicator"]).join(n, "indicator")
    plain = F.when(F.col("_s") > 1e-10, (F.col("value") - F.col("_m")) / F.col("_s")).otherwise(F.when(F.col("value").isNotNull(), 0.0))
    z = F.when((F.col("_n") < small) | (F.abs("_g") > skewed), F.col("_normal")).when(F.col("_n") < medium, F.col("_robust")).otherwise(plain)
    z = F.coalesce(clip(z, -3.0, 3.0), F.lit(0.0))
    return each.withColumn("norm", F.when(F.col("indicator").isin(inverse), -z).otherwise(z)).select(*long.columns, "norm")


def row_mean(columns: list[str]) -> Column:
    """Mean of the columns that are not null; null if all are."""
    there = sum((F.col(c).isNotNull().cast("int") for c in columns), F.lit(0))
    return F.when(there > 0, sum((F.coalesce(F.col(c), F.lit(0.0)) for c in columns), F.lit(0.0)) / there)


def weighted_mean(weights: dict[str, float], missing: str = "renormalise") -> Column:
    """Weighted mean of columns: weights of null columns are left out (renormalise) or count with value 0 (zero)."""
    total = sum((F.coalesce(F.col(c), F.lit(0.0)) * w for c, w in weights.items()), F.lit(0.0))
    if missing == "zero":
        return total / sum(weights.values())
    there = sum((F.when(F.col(c).isNotNull(), F.lit(float(w))).otherwise(0.0) for c, w in weights.items()), F.lit(0.0))
    return F.when(there > 0, total / there)


def standardised(df: DataFrame, columns: list[str], centre: float = 50.0, spread: float = 10.0, low: float = 0.0, high: float = 100.0) -> DataFrame:
    """df with each column brought to centre and spread and clipped; a constant column is left as it is."""
    s = df.agg(*[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.stddev_samp(c).alias(f"_s_{c}") for c in columns])
    joined = df.crossJoin(F.broadcast(s))
    changed = {c: F.when(F.col(f"_s_{c}") > 1e-10, clip(centre + spread * (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}"), low, high)).otherwise(F.col(c)) for c in columns}
    return joined.withColumns(changed).drop(*[f"_{k}_{c}" for k in "ms" for c in columns])


def wide_norms(long: DataFrame, key: list[str], columns: list[str], value: str = "norm") -> DataFrame:
    """One row for each key with a column for each indicator."""
    return long.groupBy(*key).agg(*[F.max(F.when(F.col("indicator") == c, F.col(value))).alias(c) for c in columns])


def pillar_scores(wide: DataFrame, pillars: dict[str, dict[str, tuple[float, list[str]]]]) -> DataFrame:
    """wide (z columns) with a score and a coverage for each pillar: category means weighted over the categories that are there, 50 + 20 z clipped to 0..100; pillars: name -> category -> (weight, columns)."""
    out = wide
    for pillar, categories in pillars.items():
        names = {f"_{pillar}_{k}": c for k, c in categories.items()}
        out = out.withColumns({n: row_mean(cols) for n, (_, cols) in names.items()})
        every = [c for _, cols in categories.values() for c in cols]
        score = weighted_mean({n: w for n, (w, _) in names.items()})
        covered = sum((F.col(c).isNotNull().cast("int") for c in every), F.lit(0)) / len(every)
        out = out.withColumns({f"{pillar}_score": clip(50 + 20 * score, 0.0, 100.0), f"{pillar}_coverage": covered}).drop(*names)
    return out


def composite(df: DataFrame, weights: DataFrame, group: str, columns: list[str], out: str = "composite") -> DataFrame:
    """df with the mean of columns weighted by its group's weights (group, one column for each), equal weights where the group has none; null columns are left out."""
    w = weights.select(F.col(group).alias("_g"), *[F.col(c).alias(f"_w_{c}") for c in columns])
    joined = df.join(w, F.col(group) == F.col("_g"), "left")
    weight = lambda c: F.coalesce(f"_w_{c}", F.lit(1.0 / len(columns)))
    there = sum((F.when(F.col(c).isNotNull(), weight(c)).otherwise(0.0) for c in columns), F.lit(0.0))
    total = sum((F.coalesce(F.col(c), F.lit(0.0)) * weight(c) for c in columns), F.lit(0.0))
    return joined.withColumn(out, F.when(there > 0, total / there)).drop("_g", *[f"_w_{c}" for c in columns])


def shrunk(df: DataFrame, score: str, confidence: str, group: str, out: str, least: float = 0.4) -> DataFrame:
    """df with scores of a confidence c below ``least`` drawn to c * score + (1 - c) * median, that of their group, or of all rows where it has none."""
    middle = quantiles(df, [group], score, {"_median": 0.5})
    everywhere = quantiles(df, [], score, {"_all": 0.5})
    c = F.col(confidence)
    drawn = c * F.col(score) + (1 - c) * F.coalesce("_median", "_all")
    joined = df.join(middle, group, "left").join(F.broadcast(everywhere), how="left")  # one row
    return joined.withColumn(out, F.when(c < least, drawn).otherwise(F.col(score))).drop("_median", "_all")


def harmonised(df: DataFrame, score: str, source: str, out: str, least: int = 5) -> DataFrame:
    """df with normal scores within each source of at least ``least`` rows, rescaled to the overall mean and deviation; rows of smaller sources keep their score."""
    s = df.agg(F.avg(score).alias("_m"), F.stddev_samp(score).alias("_s"))
    n = df.groupBy(source).agg(F.count(score).alias("_n"))
    joined = normal_scores(df, score, "_z", [source]).join(n, source).crossJoin(F.broadcast(s))
    return joined.withColumn(out, F.when(F.col("_n") >= least, F.col("_m") + F.col("_s") * F.col("_z")).otherwise(F.col(score))).drop("_m", "_s", "_n", "_z")


def sector_blend(df: DataFrame, score: str, group: str, out: str, share: float = 0.3) -> DataFrame:
    """(1 - share) of the score and share of its percentile rank (0..100; 50 without one) in its group, kept in 0..100."""
    blend = (1 - share) * F.col(score) + share * 100 * F.coalesce("_p", F.lit(0.5))
    return with_rank(df, score, [group], "_p", pct=True).withColumn(out, clip(blend, 0.0, 100.0)).drop("_p")


def sector_position(df: DataFrame, columns: list[str], group: str, key: str, out: str = "sector_position") -> DataFrame:
    """(key, group, out): percentile rank in the group of the mean of group-median-centred z of the columns; 0.5 without any."""
    long = df.select(key, group, *columns).unpivot([key, group], columns, "indicator", "value")
    middle = quantiles(long, ["indicator", group], "value", {"_med": 0.5}).join(long.groupBy("indicator", group).agg(F.stddev_samp("value").alias("_s")), ["indicator", group])
    z = (F.col("value") - F.col("_med")) / F.when(F.col("_s") > 1e-10, F.col("_s"))
    mean = long.join(middle, ["indicator", group], "left").groupBy(key, group).agg(F.avg(z).alias("_z"))
    return with_rank(mean, "_z", [group], "_p", pct=True).select(key, group, F.coalesce("_p", F.lit(0.5)).alias(out))


def factor_norms(df: DataFrame, key: str, factors: list[str], mode: str) -> DataFrame:
    """(key, factors): null factors filled by the median, then as percentile ranks 0..100 (rank), z brought to 50 and 10 (variance_equalized), or as they are (raw)."""
    long = settled(df.select(key, *factors).unpivot(key, factors, "indicator", "value"), "factors")
    middle = quantiles(long, ["indicator"], "value", {"_med": 0.5})
    full = long.join(F.broadcast(middle), "indicator", "left").select(key, "indicator", F.coalesce("value", "_med").alias("value"))
    wide = settled(wide_norms(full, [key], factors, "value"), "filled")
    if mode == "rank":
        ranked = rank_columns(wide, key, factors, pct=True, suffix="")
        return ranked.select(key, *[(100 * F.col(f)).alias(f) for f in factors])
    return standardised(wide, factors, low=-1e9, high=1e9) if mode == "variance_equalized" else wide


def preference(norms: DataFrame, key: str, profiles: dict[str, dict[str, float]]) -> DataFrame:
    """(key, profile, score): weighted means of the factors; weights are scaled to add up to 1."""
    scores = [F.struct(F.lit(name).alias("profile"), sum((F.col(f) * (w / sum(ws.values())) for f, w in ws.items()), F.lit(0.0)).alias("score")) for name, ws in profiles.items()]
    return norms.select(key, F.explode(F.array(*scores)).alias("_s")).select(key, "_s.*")


def gated(df: DataFrame, score: str, gate: str, share: float = 0.3, power: float = 1.5, least: int = 20) -> DataFrame:
    """df with the score raised to ``power`` on 0..100, and 0 below the gate column's ``share`` quantile, or without a gate value, in universes of at least ``least`` rows (unless no row has one)."""
    q = quantiles(df, [], gate, {"_q": share}).crossJoin(df.agg(F.count(F.lit(1)).alias("_n")))
    lifted = 100 * F.pow(clip(F.col(score), 0.0, 100.0) / 100, F.lit(power))
    shut = (F.col("_n") >= least) & F.col("_q").isNotNull() & (F.col(gate).isNull() | (F.col(gate) < F.col("_q")))
    return df.crossJoin(F.broadcast(q)).withColumn("gated", F.when(shut, 0.0).otherwise(lifted)).drop("_q", "_n")


def without_factor(weights: dict[str, float], factor: str) -> dict[str, float]:
    """A profile without one factor, its weight dealt to the others in proportion."""
    left = {f: w for f, w in weights.items() if f != factor}
    return {f: w / sum(left.values()) for f, w in left.items()}


def config_score(z: DataFrame, section: dict[str, tuple[float, dict[str, float]]], fallbacks: dict[str, str] | None = None, restandardise: bool = False, out: str = "score") -> DataFrame:
    """z (columns of z values, inverse ones flipped) with a two-level score: section maps a category to (weight, indicator -> weight).

    An absent indicator is replaced by its fallback or left out, a category without any by the others; null z values count as 0. With ``restandardise``
    category values are standardised before they are weighted. 50 + 20 times the weighted value, kept in 0..100; 50 without any category."""
    resolved = lambda c: c if c in z.columns else (fallbacks or {}).get(c, c)
    values, weights = {}, {}
    for category, (weight, indicators) in section.items():
        used = {resolved(c): w for c, w in indicators.items() if resolved(c) in z.columns and w > 0}
        if weight > 0 and used:
            values[f"_{category}"] = sum((F.coalesce(F.col(c), F.lit(0.0)) * (w / sum(used.values())) for c, w in used.items()), F.lit(0.0))
            weights[f"_{category}"] = weight
    if not values:
        return z.withColumn(out, F.lit(50.0))
    made = z.withColumns(values)
    if restandardise:
        s = made.agg(*[f(c).alias(f"{c}{k}") for c in values for k, f in (("_m", F.avg), ("_s", F.stddev_samp))])
        made = made.crossJoin(F.broadcast(s)).withColumns({c: F.when(F.col(f"{c}_s") > 1e-10, (F.col(c) - F.col(f"{c}_m")) / F.col(f"{c}_s")).otherwise(F.col(c)) for c in values})
        made = made.drop(*[f"{c}{k}" for c in values for k in ("_m", "_s")])
    total = sum((F.col(c) * (w / sum(weights.values())) for c, w in weights.items()), F.lit(0.0))
    return made.withColumn(out, F.coalesce(clip(50 + 20 * total, 0.0, 100.0), F.lit(50.0))).drop(*values)


def market_score(norms: DataFrame, categories: dict[str, tuple[float, dict[str, float]]]) -> DataFrame:
    """norms (columns of z values, inverse ones negated before) with ``market_<category>_score``, weighted sums over the category's whole weight,
    and ``market_score``, 50 + 20 times their weighted mean, kept in 0..100; null values count as 0, an absent category as 0."""
    per = {}
    for name, (_, indicators) in categories.items():
        used = {c: w for c, w in indicators.items() if c in norms.columns}
        per[f"market_{name}_score"] = sum((F.coalesce(F.col(c), F.lit(0.0)) * (w / sum(used.values())) for c, w in used.items()), F.lit(0.0))
    weight = sum(w for w, _ in categories.values())
    out = norms.withColumns(per)
    total = sum((F.col(f"market_{name}_score") * (w / weight) for name, (w, _) in categories.items()), F.lit(0.0)) if weight else F.lit(0.0)
    return out.withColumn("market_score", clip(50 + 20 * total, 0.0, 100.0))


#: Weights of the market score's categories without momentum.
EX_MOMENTUM = {"market_liquidity_score": 0.40 / 0.70, "market_volatility_score": 0.30 / 0.70}


def market_ex_momentum(df: DataFrame, weights: dict[str, float] = EX_MOMENTUM, out: str = "market_score_ex_momentum") -> DataFrame:
    """df with the market score of the categories without momentum; null category values count as 0."""
    total = sum((F.coalesce(F.col(c), F.lit(0.0)) * w for c, w in weights.items()), F.lit(0.0))
    return df.withColumn(out, clip(50 + 20 * total, 0.0, 100.0))


#: Provenance weights by what a source's name contains; the last that fits wins.
PROVENANCE = (("proxy|calibrated", 0.5), ("imput", 0.4), ("epa|sec|real|yahoo|sbti|cdp|ungc", 1.0))


def provenance_weight(source: Column) -> Column:
    out = F.lit(1.0)
    for pattern, weight in PROVENANCE:
        out = F.when(F.lower(source).rlike(pattern), F.lit(weight)).otherwise(out)
    return out


def pillar_table(wide: DataFrame, pillars: dict[str, dict[str, tuple[float, list[str]]]], uncalibrated: set[str] | None = None) -> DataFrame:
    """wide (columns of z values) with ``<pillar>_score``, ``_coverage`` and ``_confidence``: category means of columns that are not constant, each
    category's weight cut by 0.7 times its share of ``uncalibrated`` columns, renormalised over the categories that a row has; scores stay on the z scale."""
    columns = sorted({c for categories in pillars.values() for _, cols in categories.values() for c in cols})
    row = wide.agg(*[(F.min(c) < F.max(c)).alias(c) for c in columns]).head()
    varied = {c for c in columns if row[c]}
    out = wide
    for pillar, categories in pillars.items():
        names, weights = {}, {}
        for category, (weight, cols) in categories.items():
            used = [c for c in cols if c in varied]
            if used:
                names[f"_{pillar}_{category}"] = row_mean(used)
                weights[f"_{pillar}_{category}"] = weight * (1 - 0.7 * len(set(used) & (uncalibrated or set())) / len(used))
        total = sum(w for w, _ in categories.values())
        there = lambda c, w: F.when(F.col(c).isNotNull(), F.lit(w)).otherwise(0.0)
        out = out.withColumns(names)
        got = sum((there(c, w) for c, w in weights.items()), F.lit(0.0))
        coverage = got / total
        summed = sum((F.coalesce(F.col(c), F.lit(0.0)) * w for c, w in weights.items()), F.lit(0.0))
        out = out.withColumns({f"{pillar}_score": F.when(got > 0, summed / got), f"{pillar}_coverage": coverage, f"{pillar}_confidence": clip(coverage, 0.0, 1.0)}).drop(*names)
    return out


def decoupled(df: DataFrame, score: str, against: str, group: str) -> DataFrame:
    """df with ``score`` less what ``against`` explains of it, then as percentile rank in its group, then standardised; 0 where ranks don't vary."""
    both = F.col(score).isNotNull() & F.col(against).isNotNull()
    beta = df.where(both).agg(F.when(F.var_samp(against) > 1e-12, F.covar_samp(score, against) / F.var_samp(against)).alias("_beta"))
    rest = F.when(both, F.col(score) - F.coalesce("_beta", F.lit(0.0)) * F.col(against)).otherwise(F.col(score))
    ranked = with_rank(df.crossJoin(F.broadcast(beta)).withColumn(score, rest).drop("_beta"), score, [group], "_p", pct=True)
    s = ranked.agg(F.avg("_p").alias("_m"), F.stddev_samp("_p").alias("_s"))
    z = F.when(F.coalesce(F.col("_s"), F.lit(0.0)) <= 1e-12, 0.0).otherwise((F.col("_p") - F.col("_m")) / (F.col("_s") + 1e-10))
    return ranked.crossJoin(F.broadcast(s)).withColumn(score, z).drop("_p", "_m", "_s")


def empirical_weights(df: DataFrame, columns: list[str], against: str) -> DataFrame:
    """One row of weights for columns: the inverse of their absolute correlation with ``against``, scaled to add up to 1."""
    inverse = {c: 1 / (F.abs(F.corr(c, against)) + 1e-6) for c in columns}
    one = df.agg(*[F.coalesce(v, F.lit(0.0)).alias(c) for c, v in inverse.items()])
    total = sum((F.col(c) for c in columns), F.lit(0.0))
    return one.select(*[(F.col(c) / total).alias(c) for c in columns])


def quality_proxy(df: DataFrame, key: str, metrics: list[str], fallback: list[str], least: int = 20) -> DataFrame:
    """(key, proxy): mean percentile rank (0..100) of the metrics with more than ``least`` values; the first fallback column with a value if fewer than two have."""
    row = df.agg(*[F.count(c).alias(c) for c in [*metrics, *fallback]]).head()
    used = [c for c in metrics if row[c] > least]
    if len(used) >= 2:
        ranks = rank_columns(df, key, used, pct=True, suffix="")
        mean = row_mean([f"_{c}" for c in used])
        return df.select(key).join(ranks.select(key, *[(100 * F.col(c)).alias(f"_{c}") for c in used]), key, "left").select(key, mean.alias("proxy"))
    there = next((c for c in fallback if row[c] > 0), None)
    return df.select(key, (F.col(there) if there else F.lit(None).cast("double")).alias("proxy"))


def momentum_percentile(df: DataFrame, momenta: list[str], out: str = "momentum_percentile") -> DataFrame:
    """df with the percentile rank (0..100) of the mean of the momentum columns, the median standing in for a row without any."""
    mean = df.withColumn("_mean", row_mean(momenta))
    middle = quantiles(mean, [], "_mean", {"_med": 0.5})
    full = mean.join(F.broadcast(middle), how="left").withColumn("_mean", F.coalesce("_mean", "_med", F.lit(0.0)))  # one row
    return with_rank(full, "_mean", out="_p", pct=True).withColumn(out, 100 * F.col("_p")).drop("_mean", "_med", "_p")


def tilted(score: Column, percentile: Column, share: float = 0.15) -> Column:
    """A preference score drawn to the momentum percentile, kept in 0..100."""
    return clip((1 - share) * score + share * percentile, 0.0, 100.0)


def reranked(norms: DataFrame, key: str, base: dict[str, float], own: dict[str, float]) -> DataFrame:
    """(key, score, rank, change): ranks by a user's weights, scaled to 1, and how many places up from those of the base weights."""
    scores = preference(norms, key, {"base": base, "own": own}).withColumn("score", F.round("score", 8))
    ranked = with_rank(scores, "score", ["profile"], "rank", descending=True)
    of = lambda profile, c: F.max(F.when(F.col("profile") == profile, F.col(c)))
    return ranked.groupBy(key).agg(of("own", "score").alias("score"), of("own", "rank").alias("rank"), (of("base", "rank") - of("own", "rank")).alias("change"))


#: Sources of an entity's cells in order of trust, with the label that each gives it; without any of them the last label.
SOURCE_LABELS = (
    ("real_epa", "real_epa"), ("real_sec", "real_sec"), ("real_yahoo", "real_yahoo"), ("financial_proxy", "proxy_calibrated"),
    ("sector_imputed", "imputed"), ("cross_sector_imputed", "imputed"), ("missing", "imputed"),
)


def simple_pillars(df: DataFrame, key: str, pillars: dict[str, list[str]], sources: DataFrame, anchored: str, filed: str = "real_sec") -> DataFrame:
    """(key, a mean of its columns for each pillar, source): plain means of what is there, one pillar lifted by filings.

    The ``anchored`` pillar (50 if missing) is multiplied by 0.9 plus 0.2 times the share of its columns that ``sources`` (key, column, source) has as ``filed``,
    and kept within 0 and 100. source is the label of the most trusted source of any cell. Columns that df lacks are left out; a pillar without any is null."""
    there = {p: [c for c in columns if c in df.columns] for p, columns in pillars.items()}
    rank = F.coalesce(*[F.when(F.col("source") == s, F.lit(k)) for k, (s, _) in enumerate(SOURCE_LABELS)])
    own = sources.groupBy(key).agg(F.sum((F.col("column").isin(there[anchored]) & (F.col("source") == filed)).cast("int")).alias("_filed"), F.min(rank).alias("_rank"))
    means = {p: row_mean(columns) if columns else F.lit(None).cast("double") for p, columns in there.items()}
    joined = df.select(key, *[m.alias(p) for p, m in means.items()]).join(own, key, "left")
    if there[anchored]:
        share = F.coalesce("_filed", F.lit(0)) / len(there[anchored])
        joined = joined.withColumn(anchored, clip(F.coalesce(F.col(anchored), F.lit(50.0)) * (0.9 + 0.2 * share), 0.0, 100.0))
    label = F.coalesce(F.get(F.array(*[F.lit(name) for _, name in SOURCE_LABELS]), F.col("_rank")), F.lit(SOURCE_LABELS[-1][1]))
    return joined.select(key, *pillars, label.alias("source"))
