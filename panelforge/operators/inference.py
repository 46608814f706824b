"""Correlation, regression and hypothesis tests as aggregates; ranks come from distributed rank operators."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions.expressions import adjusted_kurtosis, adjusted_skewness, normal_cdf, ratio, two_sided
from panelforge.functions.tables import settled
from panelforge.functions.tails import chi_square_tail, f_tail, t_two_sided
from panelforge.operators.ranking import cumulative, with_bin, with_rank


def pearson_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, r, n) of each pair of columns over rows where both are there, in one aggregate."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    both = lambda a, b: F.col(a).isNotNull() & F.col(b).isNotNull()
    row = df.agg(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(F.when(both(a, b), F.col(a)), F.when(both(a, b), F.col(b))).alias("r"), F.sum(both(a, b).cast("bigint")).alias("n")).alias(f"p{k}") for k, (a, b) in enumerate(pairs)])
    return row.select(F.explode(F.array(*[f"p{k}" for k in range(len(pairs))])).alias("p")).select("p.*")


def pair_rows(df: DataFrame, key: str, xs: list[str], ys: list[str]) -> DataFrame:
    """(key, factor, target, x, y) of each pair of columns, rows with both only."""
    pairs = [F.struct(F.lit(a).alias("factor"), F.lit(b).alias("target"), F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y")) for a in xs for b in ys if a != b]
    return df.select(key, F.explode(F.array(*pairs)).alias("p")).select(key, "p.*").where("x is not null and y is not null")


def _whole_sum(x: Column) -> Column:
    """The exact sum of products of ranks, which are whole numbers: as two sums, so that none overflows."""
    return F.sum(F.shiftright(x, 24)).cast("decimal(38,0)") * F.lit(1 << 24).cast("decimal(9,0)") + F.sum(x.bitwiseAND(F.lit((1 << 24) - 1).cast("bigint"))).cast("decimal(38,0)")


def _correlation_of_ranks(x: str, y: str) -> Column:
    """Correlation of two columns of ranks, which are halves: sums are exact, so that a coefficient near 0 keeps its digits in any order of rows. Null where one doesn't vary."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = (F.when(both, (2 * F.col(c)).cast("bigint")) for c in (x, y))
    n, one, two = F.count(F.when(both, F.lit(1))).cast("decimal(19,0)"), F.sum(a).cast("decimal(19,0)"), F.sum(b).cast("decimal(19,0)")
    xy, xx, yy = (n * _whole_sum(p) - q for p, q in ((a * b, one * two), (a * a, one * one), (b * b, two * two)))
    xx, yy = xx.cast("double"), yy.cast("double")
    return F.when((xx > 0) & (yy > 0), xy.cast("double") / F.sqrt(xx * yy))


def rank_correlation(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, rho, n, p, low, high): Spearman coefficient of (x, y), its normal-approximation p-value and Fisher interval."""
    ranked = with_rank(with_rank(rows, "x", by, "_rx"), "y", by, "_ry")
    out = ranked.groupBy(*by).agg(_correlation_of_ranks("_rx", "_ry").alias("rho"), F.count(F.lit(1)).alias("n"))
    z, se = F.atanh(F.greatest(F.least("rho", F.lit(1 - 1e-12)), F.lit(-1 + 1e-12))), 1 / F.sqrt(F.col("n") - 3)
    return out.withColumns({"p": F.when(F.col("n") > 3, two_sided(z / se)), "low": F.when(F.col("n") > 3, F.tanh(z - 1.959963984540054 * se)), "high": F.when(F.col("n") > 3, F.tanh(z + 1.959963984540054 * se))})


def shrunken(ics: DataFrame, value: str = "rho") -> DataFrame:
    """ics with James-Stein shrinkage of ``value`` towards its mean, and ``intensity``, the share that is taken off.

    The sampling variance is the mean of 1 / max(n - 3, 1). Up to three rows stay as they are; values that don't differ become their mean."""
    s = ics.agg(F.avg(value).alias("_m"), F.count(F.lit(1)).alias("_k"), F.var_pop(value).alias("_var"), F.count(value).alias("_n"), F.avg(1 / F.greatest(F.col("n") - 3, F.lit(1))).alias("_v"))
    spread = F.col("_var") * F.col("_n")
    keep = F.when(spread <= 1e-12, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - (F.col("_k") - 3) * F.col("_v") / spread)))
    kept = ics.crossJoin(F.broadcast(s)).withColumn("_keep", F.when(F.col("_k") <= 3, 1.0).otherwise(keep))
    shrunk = F.when(F.col("_k") <= 3, F.col(value)).otherwise(F.col("_m") + F.col("_keep") * (F.col(value) - F.col("_m")))
    return kept.withColumns({"shrunk": shrunk, "intensity": 1 - F.col("_keep")}).drop("_m", "_k", "_var", "_n", "_v", "_keep")


def within_group_correlation(df: DataFrame, a: str, b: str, group: str) -> DataFrame:
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    return both.groupBy(group).agg(F.corr(a, b).alias("r"), F.count(F.lit(1)).alias("n"))


def phi(df: DataFrame, a: Column, b: Column) -> DataFrame:
    """(n11, n10, n01, n00, phi, chi2, p): association of two conditions; chi2 has Yates' correction."""
    both = df.select(a.cast("int").alias("a"), b.cast("int").alias("b")).where("a is not null and b is not null")
    c = both.agg(*[F.coalesce(F.sum(((F.col("a") == i) & (F.col("b") == j)).cast("bigint")), F.lit(0)).alias(f"n{i}{j}") for i in (1, 0) for j in (1, 0)])
    n11, n10, n01, n00 = (F.col(x).cast("double") for x in ("n11", "n10", "n01", "n00"))
    n, margins = n11 + n10 + n01 + n00, (n11 + n10) * (n01 + n00) * (n11 + n01) * (n10 + n00)
    cross = n11 * n00 - n10 * n01
    out = c.withColumns({"phi": F.when(margins > 0, cross / F.sqrt(margins)), "chi2": F.when(margins > 0, n * F.pow(F.greatest(F.abs(cross) - n / 2, F.lit(0.0)), F.lit(2.0)) / margins)})
    return out.withColumn("p", chi_square_tail(F.col("chi2"), F.lit(1)))


def simple_regression(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, slope, intercept, r2, se, t, p, n) of y on x."""
    out = rows.groupBy(*by).agg(F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.regr_r2("y", "x").alias("r2"), F.count(F.lit(1)).alias("n"), F.regr_sxx("y", "x").alias("_sxx"), F.regr_syy("y", "x").alias("_syy"))
    rest = (1 - F.col("r2")) * F.col("_syy") / (F.col("n") - 2)
    out = out.withColumn("se", F.when(F.col("n") > 2, F.sqrt(rest / F.col("_sxx")))).withColumn("t", F.col("slope") / F.col("se"))
    return out.withColumn("p", t_two_sided(F.col("t"), F.col("n") - 2)).drop("_sxx", "_syy")


def moments(df: DataFrame, columns: list[str]) -> tuple[np.ndarray, np.ndarray, int]:
    """Means, covariance matrix and number of the rows where all columns are there: k squared numbers in one aggregate."""
    whole = df.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns]))
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    row = whole.agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)], *[F.covar_samp(columns[i], columns[j]).alias(f"c{i}_{j}") for i, j in pairs]
    ).head()
    cov = np.array([[row[f"c{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(len(columns))] for i in range(len(columns))])
    return np.array([row[f"m{i}"] or 0.0 for i in range(len(columns))]), cov, int(row["n"])


def multiple_regression(df: DataFrame, xs: list[str], y: str) -> DataFrame:
    """(term, coefficient, se, t, p) of the least-squares fit on standardised regressors, with r2, adjusted r2, F, its p and n repeated on each row; no row where there are too few to fit."""
    means, cov, n = moments(df, [*xs, y])
    k, free = len(xs), n - len(xs) - 1
    schema = "term string, coefficient double, se double, t double, r2 double, adjusted_r2 double, f double, n bigint"
    rows = []
    if free > 0:
        sd = np.sqrt(np.where(np.diag(cov)[:k] > 0, np.diag(cov)[:k], 1.0))
        inverse = np.linalg.pinv((n - 1) * cov[:k, :k] / np.outer(sd, sd))
        xy, total = (n - 1) * cov[:k, k] / sd, (n - 1) * cov[k, k]
        beta = inverse @ xy
        rest = max(total - beta @ xy, 0.0)
        r2 = 1 - rest / total if total > 0 else 0.0
        se = np.sqrt(np.append(1 / n, np.maximum(np.diag(inverse), 0)) * rest / free)
        f = (r2 / k) / ((1 - r2) / free) if r2 < 1 else None
        whole = (float(r2), float(1 - (1 - r2) * (n - 1) / free), f and float(f), n)
        rows = [(t, float(b), float(e), float(b / e) if e else None, *whole) for t, b, e in zip(["intercept", *xs], np.append(means[k], beta), se, strict=True)]
    out = df.sparkSession.createDataFrame(rows, schema)
    free_rows = F.col("n") - k - 1
    return out.withColumns({"p": t_two_sided(F.col("t"), free_rows), "f_p": f_tail(F.col("f"), F.lit(k), free_rows)})


def incremental_r2(df: DataFrame, x: str, y: str, group: str) -> DataFrame:
    """(r2_group, r2_full, gain, f, p, n): what x adds to group means in explaining y, by demeaning within groups."""
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    g = d.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.avg(y).alias("my"), F.regr_sxx(y, x).alias("sxx"), F.regr_sxy(y, x).alias("sxy"), F.regr_syy(y, x).alias("syy"))
    mean = F.sum(F.col("n") * F.col("my")) / F.sum("n")
    total = F.sum("syy") + F.sum(F.col("n") * F.col("my") * F.col("my")) - F.sum("n") * mean * mean
    one = g.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("_k"), F.sum("sxx").alias("_sxx"), F.sum("sxy").alias("_sxy"), F.sum("syy").alias("_within"), total.alias("_total"))
    out = one.withColumn("r2_group", 1 - F.col("_within") / F.col("_total")).withColumn("gain", F.col("_sxy") * F.col("_sxy") / F.col("_sxx") / F.col("_total"))
    out = out.withColumn("r2_full", F.col("r2_group") + F.col("gain"))
    out = out.withColumn("f", F.col("gain") / ((1 - F.col("r2_full")) / (F.col("n") - F.col("_k") - 1)))
    return out.withColumn("p", f_tail(F.col("f"), F.lit(1), F.col("n") - F.col("_k") - 1)).select("r2_group", "r2_full", "gain", "f", "p", "n")


def inflation(df: DataFrame, columns: list[str]) -> DataFrame:
    """(factor, vif, condition) from the inverse of the correlation matrix of complete rows; condition: the root of its largest over its smallest eigenvalue."""
    _, cov, _ = moments(df, columns)
    sd = np.sqrt(np.where(np.diag(cov) > 0, np.diag(cov), 1.0))
    r = cov / np.outer(sd, sd)
    values = np.linalg.eigvalsh(r)
    condition = float(np.sqrt(values[-1] / values[0])) if values[0] > 1e-12 else None
    return df.sparkSession.createDataFrame([(c, float(v), condition) for c, v in zip(columns, np.diag(np.linalg.pinv(r)), strict=True)], "factor string, vif double, condition double")


def anova(df: DataFrame, value: str, group: str) -> DataFrame:
    """(f, df1, df2, p, eta_squared, size, n) of the one-way analysis of variance; size names eta squared by the usual limits .01, .06, .14."""
    g = df.where(F.col(value).isNotNull()).groupBy(group).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v"))
    mean = F.sum(F.col("n") * F.col("m")) / F.sum("n")
    between, within = F.sum(F.col("n") * F.col("m") * F.col("m")) - F.sum("n") * mean * mean, F.sum(F.col("n") * F.col("v"))
    one = g.agg(F.sum("n").alias("n"), (F.count(F.lit(1)) - 1).alias("df1"), (F.sum("n") - F.count(F.lit(1))).alias("df2"), between.alias("_b"), within.alias("_w"))
    out = one.select("n", "df1", "df2", ((F.col("_b") / F.col("df1")) / (F.col("_w") / F.col("df2"))).alias("f"), (F.col("_b") / (F.col("_b") + F.col("_w"))).alias("eta_squared"))
    eta = F.col("eta_squared")
    size = F.when(eta < 0.01, "negligible").when(eta < 0.06, "small").when(eta < 0.14, "medium").when(eta.isNotNull(), "large")
    return out.withColumns({"p": f_tail(F.col("f"), F.col("df1"), F.col("df2")), "size": size})


def two_groups(df: DataFrame, value: str, first: Column) -> DataFrame:
    """(n1, n2, mean1, mean2, t, p, welch_t, welch_df, welch_p, low, high, d) of rows where ``first`` holds and the others; low and high: 95 pct limits of the difference of means, by Welch."""
    v = lambda c: F.when(c, F.col(value))
    a, b = v(first), v(~first)
    s = df.agg(F.count(a).alias("n1"), F.count(b).alias("n2"), F.avg(a).alias("mean1"), F.avg(b).alias("mean2"), F.var_samp(a).alias("_v1"), F.var_samp(b).alias("_v2"))
    n1, n2, v1, v2, gap = F.col("n1"), F.col("n2"), F.col("_v1"), F.col("_v2"), F.col("mean1") - F.col("mean2")
    pooled = ((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)
    e1, e2 = v1 / n1, v2 / n2
    out = s.withColumns({"t": gap / F.sqrt(pooled * (1 / n1 + 1 / n2)), "welch_t": gap / F.sqrt(e1 + e2), "welch_df": (e1 + e2) * (e1 + e2) / (e1 * e1 / (n1 - 1) + e2 * e2 / (n2 - 1)), "d": gap / F.sqrt(pooled)})
    reach = t_quantile_975(F.col("welch_df")) * F.sqrt(e1 + e2)
    tails = {"p": t_two_sided(F.col("t"), n1 + n2 - 2), "welch_p": t_two_sided(F.col("welch_t"), F.col("welch_df")), "low": gap - reach, "high": gap + reach}
    return out.withColumns(tails).drop("_v1", "_v2")


def t_quantile_975(df: Column) -> Column:
    """97.5 pct quantile of Student's t by the Cornish-Fisher expansion (error below 1e-4 from 10 degrees of freedom on)."""
    z = 1.959963984540054
    terms = ((z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96, (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384, (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160)
    return sum((F.lit(c) / F.pow(df, F.lit(float(k + 1))) for k, c in enumerate(terms)), F.lit(z))


def rank_sums(df: DataFrame, value: str, group: str) -> DataFrame:
    """Helper frame of rank tests: (group, n, r, total, ties) with rank sums, all rows and the sum of t^3 - t over ties."""
    d = df.where(F.col(value).isNotNull() & F.col(group).isNotNull()).select(group, value)
    c = cumulative(d, [], value)
    tie = c.agg(F.sum(F.pow(F.col("n").cast("double"), F.lit(3.0)) - F.col("n")).alias("ties"), F.max("total").alias("total"))
    sums = with_rank(d, value, out="_r").groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.sum("_r").alias("r"))
    return sums.crossJoin(F.broadcast(tie))


def mann_whitney(df: DataFrame, value: str, group: str, first: str, second: str) -> DataFrame:
    """(u, z, p, rank_biserial, cliffs_delta, n1, n2) of two groups, with the tie-corrected normal approximation."""
    s = rank_sums(df.where(F.col(group).isin(first, second)), value, group)
    pick = lambda g, c: F.max(F.when(F.col(group) == g, F.col(c)))
    one = s.agg(pick(first, "n").alias("n1"), pick(second, "n").alias("n2"), pick(first, "r").alias("_r1"), F.max("ties").alias("_t"), F.max("total").alias("_n"))
    n1, n2, n = F.col("n1"), F.col("n2"), F.col("_n")
    u = F.col("_r1") - n1 * (n1 + 1) / 2
    sd = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.col("_t") / (n * (n - 1))))
    out = one.withColumn("u", u).withColumn("z", (F.col("u") - n1 * n2 / 2) / sd)
    delta = 2 * F.col("u") / (n1 * n2) - 1
    return out.withColumns({"p": two_sided(F.col("z")), "rank_biserial": delta, "cliffs_delta": delta}).select("u", "z", "p", "rank_biserial", "cliffs_delta", "n1", "n2")


def kruskal(df: DataFrame, value: str, group: str) -> DataFrame:
    """(h, p, groups, n) with the tie correction."""
    s = rank_sums(df, value, group)
    one = s.agg(F.sum(F.col("r") * F.col("r") / F.col("n")).alias("_q"), F.max("total").alias("n"), F.max("ties").alias("_t"), F.count(F.lit(1)).alias("groups"))
    n = F.col("n").cast("double")
    h = (12 / (n * (n + 1)) * F.col("_q") - 3 * (n + 1)) / (1 - F.col("_t") / (n * n * n - n))
    return one.select(h.alias("h"), chi_square_tail(h, F.col("groups") - 1).alias("p"), "groups", F.col("n").cast("bigint").alias("n"))


def friedman(df: DataFrame, columns: list[str]) -> DataFrame:
    """(chi2, p, kendalls_w, n) of repeated measures in columns, by ranks within a row; rows with nulls are left out."""
    k = len(columns)
    whole = df.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns]))
    rank = lambda c: sum(((F.col(o) < F.col(c)).cast("int") + 0.5 * (F.col(o) == F.col(c)).cast("int") for o in columns if o != c), F.lit(1.0))
    ties = sum((F.pow(sum(((F.col(o) == F.col(c)).cast("double") for o in columns), F.lit(0.0)), F.lit(2.0)) - 1 for c in columns), F.lit(0.0))  # sum over rows of t^3 - t for each tie of t
    s = whole.agg(F.count(F.lit(1)).alias("n"), F.sum(ties).alias("_t"), *[F.sum(rank(c)).alias(f"r{i}") for i, c in enumerate(columns)])
    n, q = F.col("n"), sum((F.col(f"r{i}") * F.col(f"r{i}") for i in range(k)), F.lit(0.0))
    chi2 = (12 * q - 3 * n * n * k * (k + 1) * (k + 1)) / (n * k * (k + 1) - F.col("_t") / (k - 1))
    return s.select(chi2.alias("chi2"), chi_square_tail(chi2, F.lit(k - 1)).alias("p"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), chi2 / (n * (k - 1)))).alias("kendalls_w"), "n")


def wilcoxon(df: DataFrame, a: str, b: str) -> DataFrame:
    """(w, z, p, effect, n): signed-rank test of a - b without zero differences, tie-corrected."""
    d = df.select((F.col(a) - F.col(b)).alias("_d")).where("_d <> 0").withColumn("_a", F.abs("_d"))
    c = cumulative(d, [], "_a").agg(F.sum(F.pow(F.col("n").cast("double"), F.lit(3.0)) - F.col("n")).alias("_t"))
    s = with_rank(d, "_a", out="_r").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("_d") > 0, F.col("_r"))).alias("_up"), F.sum(F.when(F.col("_d") < 0, F.col("_r"))).alias("_down")).crossJoin(F.broadcast(c))
    n, up, down = F.col("n"), F.coalesce("_up", F.lit(0.0)), F.coalesce("_down", F.lit(0.0))
    z = (up - n * (n + 1) / 4) / F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("_t") / 48)
    return s.select(F.least(up, down).alias("w"), z.alias("z"), two_sided(z).alias("p"), (z / F.sqrt(n)).alias("effect"), "n")


def chi_square(df: DataFrame, a: str, b: str) -> DataFrame:
    """(chi2, dof, p, n, cramers_v) of the contingency table of two columns, from its non-empty cells: chi2 = n (sum of o^2 / (r c) - 1)."""
    cells = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count(F.lit(1)).cast("double").alias("o"))
    rows, cols = cells.groupBy(a).agg(F.sum("o").alias("r")), cells.groupBy(b).agg(F.sum("o").alias("c"))
    full = cells.join(rows, a).join(cols, b)
    sums = full.agg(F.sum(F.col("o") * F.col("o") / F.col("r") / F.col("c")).alias("_q"), F.sum("o").alias("n"), F.count_distinct(a).alias("_r"), F.count_distinct(b).alias("_c"))
    out = sums.withColumn("chi2", F.col("n") * (F.col("_q") - 1)).withColumn("dof", (F.col("_r") - 1) * (F.col("_c") - 1))
    return out.select("chi2", "dof", chi_square_tail(F.col("chi2"), F.col("dof")).alias("p"), F.col("n").cast("bigint").alias("n"), F.sqrt(F.col("chi2") / F.col("n") / (F.least("_r", "_c") - 1)).alias("cramers_v"))


def two_sample_ks(df: DataFrame, value: str, first: Column) -> DataFrame:
    """(d, p, n1, n2): the largest distance between two samples' distribution functions and its asymptotic p-value."""
    d = df.where(F.col(value).isNotNull()).select(F.col(value).alias("_x"), first.cast("int").alias("_g")).where("_g is not null")
    mine = cumulative(d.where("_g = 1"), [], "_x").select("_x", F.col("n").alias("_n1"), "below")
    both = cumulative(d, [], "_x").select("_x", (F.col("below") + F.col("n")).alias("_upto"), "total")
    # Of the first sample, rows up to a value of the joint order: its share of the running count.
    share = with_share(both, mine)
    one = share.agg(F.max(F.abs(F.col("_c1") / F.col("n1") - (F.col("_upto") - F.col("_c1")) / (F.col("total") - F.col("n1")))).alias("d"), F.max("n1").alias("n1"), (F.max("total") - F.max("n1")).alias("n2"))
    return one.withColumn("p", kolmogorov_tail(F.col("d") * F.sqrt(F.col("n1") * F.col("n2") / (F.col("n1") + F.col("n2")))))


def kolmogorov_tail(x: Column, terms: int = 20) -> Column:
    """P(K >= x) of the Kolmogorov distribution, by its alternating series (1 below 0.2)."""
    series = sum((F.lit(2.0 * (-1) ** (k - 1)) * F.exp(-2.0 * k * k * x * x) for k in range(1, terms + 1)), F.lit(0.0))
    return F.when(x < 0.2, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), series)))


def with_share(both: DataFrame, mine: DataFrame) -> DataFrame:
    """both (_x, _upto, total) with _c1, the rows of the first sample at or below _x, and its size n1."""
    joined = both.join(mine, "_x", "left").withColumn("_k", F.coalesce("_n1", F.lit(0)))
    # Count up the first sample along the joint values: weight each value by its rows of the sample.
    weighted = joined.withColumn("_w", F.col("_k"))
    c = running_total(weighted, "_x", "_w")
    n1 = mine.agg(F.sum("_n1").alias("n1"))
    return c.withColumnRenamed("_run", "_c1").crossJoin(F.broadcast(n1))


def running_total(df: DataFrame, order: str, value: str) -> DataFrame:
    """df with ``_run``, the sum of value over rows up to this one by a unique order; ranges are summed apart and put together by offsets."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = settled(df.repartitionByRange(parts, order).withColumn("_range", F.spark_partition_id()), "ranges")
    inside = Window.partitionBy("_range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    sums = ranged.groupBy("_range").agg(F.sum(value).alias("_s"))
    before = Window.partitionBy(F.lit(1)).orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)
    offsets = sums.select("_range", (F.sum("_s").over(before) - F.col("_s")).alias("_o"))  # one row for each range
    return ranged.withColumn("_r", F.sum(value).over(inside)).join(F.broadcast(offsets), "_range").withColumn("_run", F.col("_r") + F.col("_o")).drop("_r", "_o", "_range")


def normality(long: DataFrame) -> DataFrame:
    """(indicator, n, jarque_bera, p, skew, kurtosis) from population moments."""
    s = long.groupBy("indicator").agg(F.count("value").alias("n"), F.skewness("value").alias("_g"), F.kurtosis("value").alias("_k"))
    n = F.col("n")
    return s.select("indicator", "n", (n / 6 * (F.col("_g") * F.col("_g") + F.col("_k") * F.col("_k") / 4)).alias("jarque_bera"), F.exp(-n / 12 * (F.col("_g") * F.col("_g") + F.col("_k") * F.col("_k") / 4)).alias("p"), adjusted_skewness(F.col("_g"), n).alias("skew"), adjusted_kurtosis(F.col("_k"), n).alias("kurtosis"))


def ks_normal(df: DataFrame, value: str) -> DataFrame:
    """(d, n): largest distance of a column's distribution from the normal one with its mean and deviation."""
    s = df.agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"))
    c = cumulative(df, [], value).crossJoin(F.broadcast(s))
    f = normal_cdf((F.col(value) - F.col("_m")) / F.col("_s"))
    return c.agg(F.max(F.greatest((F.col("below") + F.col("n")) / F.col("total") - f, f - F.col("below") / F.col("total"))).alias("d"), F.max("total").alias("n"))


def trend_of_bins(df: DataFrame, score: str, value: str, bins: int = 5) -> DataFrame:
    """(s, z, p): Mann-Kendall sign test on the means of quantile bins."""
    means = with_bin(df, score, bins).where("bin is not null").groupBy("bin").agg(F.avg(value).alias("m"))
    a, b = means.select(F.col("bin").alias("i"), F.col("m").alias("x")), means.select(F.col("bin").alias("j"), F.col("m").alias("y"))
    s = a.join(F.broadcast(b), F.col("i") < F.col("j")).agg(F.sum(F.signum(F.col("y") - F.col("x"))).alias("s"))  # bins squared rows
    var = bins * (bins - 1) * (2 * bins + 5) / 18
    z = (F.col("s") - F.signum("s")) / var**0.5
    return s.select("s", z.alias("z"), two_sided(z).alias("p"))


def jonckheere(df: DataFrame, value: str, group: str) -> DataFrame:
    """(j, z, p): ordered alternative over numbered groups.

    The statistic counts pairs of rows of which the one in the higher group has the larger value (half a pair for equal values), so it is the
    pairs in different groups come from ``pair_sign``."""
    d = df.where(F.col(value).isNotNull() & F.col(group).isNotNull()).select(F.col(group).cast("double").alias("x"), F.col(value).alias("y"))
    s = pair_sign(d)
    square = lambda by: d.groupBy(by).agg(F.count(F.lit(1)).cast("double").alias("n")).agg(F.sum("n").alias("N"), F.sum(F.col("n") * F.col("n")).alias("q"), F.sum(F.col("n") * F.col("n") * (2 * F.col("n") + 3)).alias("c"))
    one = s.crossJoin(F.broadcast(square("x")))
    # s = concordant - discordant over pairs of different groups; with half of ties, J = (all such pairs + s) / 2.
    across = (F.col("N") * F.col("N") - F.col("q")) / 2
    j = (across + F.col("s")) / 2
    z = (j - across / 2) / F.sqrt((F.col("N") * F.col("N") * (2 * F.col("N") + 3) - F.col("c")) / 72)
    return one.select(j.alias("j"), z.alias("z"), two_sided(z).alias("p"))


def adjusted_p(ps: DataFrame, p: str = "p") -> DataFrame:
    """ps (a small frame of tests) with Bonferroni and Benjamini-Hochberg adjusted p-values."""
    every = Window.partitionBy(F.lit(1))
    order = every.orderBy(p)
    m = F.count(p).over(every)
    raw = ps.withColumn("_q", F.col(p) * m / F.row_number().over(order)).withColumn("bonferroni", F.least(F.lit(1.0), F.col(p) * m))
    return raw.withColumn("bh", F.least(F.lit(1.0), F.min("_q").over(every.orderBy(F.desc(p)).rangeBetween(Window.unboundedPreceding, 0)))).drop("_q")


#: Least and most ranges of light values on a side of the grid of ``pair_sign``, and rows of a range between these; a value with more rows than a range would
#: have is a range of its own. One task counts the grid's cells, 4 times the ranges squared, so beyond RANGE_ROWS * MOST_RANGES rows ranges grow instead.
GRID_RANGES = 256
MOST_RANGES = 1024
RANGE_ROWS = 1_000_000


def _numbered(cells: DataFrame, c: str, ranges: int) -> DataFrame:
    """cells with ``r{c}``, the number of its value's range in order of the values: even for ranges of several light values, odd for one heavy value."""
    counts = cumulative(cells.select(F.col(c).alias("v")), [], "v")
    heavy = F.col("n") * ranges >= F.col("total")
    place = counts.select(F.col("v").alias(c), (2 * F.floor(F.col("below") * ranges / F.col("total")) + heavy.cast("int")).cast("int").alias(f"r{c}"))
    return cells.join(place, c)


def pair_sign(rows: DataFrame) -> DataFrame:
    """(s): sum over pairs of rows (x, y) of sign(x - x') sign(y - y'), by a grid of value ranges.

    Pairs of rows in different ranges of both values are counted from the grid's cell totals; pairs that share the range of one value
    are counted in that range alone, in order of the other value, so no step meets all pairs of rows."""
    cells = rows.groupBy("x", "y").agg(F.count(F.lit(1)).cast("double").alias("n"))
    cells = settled(cells, "cells")
    ranges = min(MOST_RANGES, max(GRID_RANGES, -(-cells.count() // RANGE_ROWS)))
    placed = settled(_numbered(_numbered(cells, "x", ranges), "y", ranges), "grid")
    grid = placed.groupBy("rx", "ry").agg(F.sum("n").alias("n"))

    def between(t):
        total = np.zeros((2 * ranges, 2 * ranges))
        np.add.at(total, (t.column("rx").to_numpy(), t.column("ry").to_numpy()), t.column("n").to_numpy())
        up = np.zeros((2 * ranges + 1, 2 * ranges + 1))
        up[1:, 1:] = total.cumsum(0).cumsum(1)
        left = up[:-1, -1:]  # all with a smaller range of x
        below, above = up[:-1, :-1], left - up[:-1, 1:]
        return pa.table({"s": [float((total * (below - above)).sum())]})

    def within(t):
        """Pairs in one range: those of rows (a, b, n) that differ in both."""
        a, b, n = (t.column(c).to_numpy() for c in ("a", "b", "n"))
        return pa.table({"s": [merge_sign(a, b, n, t.column("other").to_numpy() if "other" in t.column_names else None)]})

    # A heavy value's range holds no two different values.
    by_x = placed.where("rx % 2 = 0").select(F.col("rx").alias("range"), F.col("x").alias("a"), F.col("y").alias("b"), "n")
    # Pairs that share the range of y but not that of x; those that share both are in by_x.
    by_y = placed.where("ry % 2 = 0").select(F.col("ry").alias("range"), F.col("y").alias("a"), F.col("x").alias("b"), "n", F.col("rx").alias("other"))
    parts = [grid.withColumn("whole", F.lit(0)).groupBy("whole").applyInArrow(between, "s double"), by_x.groupBy("range").applyInArrow(within, "s double"), by_y.groupBy("range").applyInArrow(within, "s double")]
    return parts[0].union(parts[1]).union(parts[2]).agg(F.sum("s").alias("s"))


def merge_sign(a: np.ndarray, b: np.ndarray, n: np.ndarray, other: np.ndarray | None = None) -> float:
    """Sum over pairs of weighted points of sign(a - a') sign(b - b'); with ``other``, without pairs that are equal in it."""
    if other is not None:
        whole = merge_sign(a, b, n)
        order = np.argsort(other, kind="stable")
        cut = np.flatnonzero(np.diff(other[order])) + 1
        return whole - sum(merge_sign(a[k], b[k], n[k]) for k in np.split(order, cut) if len(k) > 1)
    if not len(a):
        return 0.0
    order = np.lexsort((b, a))
    a, rank, n = a[order], np.unique(b[order], return_inverse=True)[1], n[order].astype(float)
    first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
    cell = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (rank[1:] != rank[:-1])]))
    # Pairs that are equal in a come in order of b below, so they are taken off: all but those equal in both.
    s = -((np.add.reduceat(n, first) ** 2).sum() - (np.add.reduceat(n, cell) ** 2).sum()) / 2
    # From the highest bit of the ranks on: pairs that differ in this bit first, counted by running sums among those with the same higher bits.
    for bit in range(int(rank.max()).bit_length() - 1, -1, -1):
        above = rank >> (bit + 1)
        new = np.flatnonzero(np.concatenate([[True], above[1:] != above[:-1]]))
        size = np.diff(np.append(new, len(rank)))
        one = (rank >> bit & 1).astype(float)
        before = lambda w: (c := np.cumsum(w) - w) - np.repeat(c[new], size)
        s += (n * one * before(n * (1 - one))).sum() - (n * (1 - one) * before(n * one)).sum()
        order = np.argsort(rank >> bit, kind="stable")
        rank, n = rank[order], n[order]
    return float(s)


def kendall(df: DataFrame, x: str, y: str) -> DataFrame:
    """(tau_b, z, p, n) from concordant less discordant pairs (``pair_sign``) and the pairs tied in either; z with the variance for ties, null up to two rows."""
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    t = F.col("n")
    sums = lambda c: d.groupBy(c).agg(F.count(F.lit(1)).cast("double").alias("n")).agg(F.sum("n").alias(f"n{c}"), F.sum(t * (t - 1) / 2).alias(f"t{c}"), F.sum(t * (t - 1) * (t - 2)).alias(f"u{c}"), F.sum(t * (t - 1) * (2 * t + 5)).alias(f"w{c}"))
    one = pair_sign(d).crossJoin(F.broadcast(sums("x"))).crossJoin(F.broadcast(sums("y")))
    n, m = F.col("nx"), F.col("nx") * (F.col("nx") - 1)
    var = (m * (2 * n + 5) - F.col("wx") - F.col("wy")) / 18 + ratio(2 * F.col("tx") * F.col("ty"), m) + ratio(F.col("ux") * F.col("uy"), 9 * m * (n - 2))
    z = F.when(var > 0, F.col("s") / F.sqrt(F.when(var > 0, var)))
    return one.select(ratio(F.col("s"), F.sqrt((m / 2 - F.col("tx")) * (m / 2 - F.col("ty")))).alias("tau_b"), z.alias("z"), two_sided(z).alias("p"), n.cast("bigint").alias("n"))
