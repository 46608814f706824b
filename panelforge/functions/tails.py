"""Tail probabilities of the chi-square, F and t distributions as Columns, and the same for an ANSI engine by quadrature.

The Columns follow the textbook series and continued fractions, walked a fixed number of steps by a fold; they are meant for
tables of test results. The SQL integrates the densities by Simpson's rule, so either checks the other.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelforge.functions.expressions import normal_cdf

#: Lanczos coefficients of the gamma function (g = 7).
LANCZOS = (
    0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059,
    12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7,
)
STEPS = 400
#: From this many degrees of freedom on, F is brought to chi-square by Li and Martin's shrinking factor (error below 1e-8).
MANY = 10_000
#: From this shape on, the incomplete gamma function is taken from Temme's uniform expansion (error below 1e-7); below it STEPS terms are enough.
LARGE_SHAPE = 2_000
_TINY = 1e-300


def log_gamma(x: Column) -> Column:
    """Logarithm of the gamma function for x of 0.5 or more."""
    y = x - 1
    total = sum((F.lit(c) / (y + k) for k, c in enumerate(LANCZOS) if k), F.lit(LANCZOS[0]))
    return 0.9189385332046727 + (y + 0.5) * F.log(y + 7.5) - (y + 7.5) + F.log(total)


def _steps() -> Column:
    return F.sequence(F.lit(1), F.lit(STEPS))


def _away_from_zero(x: Column) -> Column:
    return F.when(F.abs(x) < _TINY, F.lit(_TINY)).otherwise(x)


def large_gamma_tail(a: Column, x: Column) -> Column:
    """Q(a, x) for a large a and x above 0: the normal tail of the place at which the density has fallen as far, and a correction of the order of 1 / sqrt(a)."""
    away = (x - a) / a
    depth = F.greatest(F.lit(0.0), away - F.log1p(away))
    eta = F.signum(away) * F.sqrt(2 * depth)
    first = F.when(F.abs(eta) < 1e-3, -1 / 3 + eta / 12).otherwise(1 / F.when(away != 0, away) - 1 / F.when(eta != 0, eta))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), normal_cdf(-eta * F.sqrt(a)) + F.exp(-a * depth) / F.sqrt(2 * 3.141592653589793 * a) * first))


def gamma_tail(a: Column, x: Column) -> Column:
    """Upper regularised incomplete gamma function Q(a, x)."""
    front = F.exp(-x + a * F.log(x) - log_gamma(a))
    start = F.struct((1 / a).alias("term"), (1 / a).alias("total"))

    def add(s: Column, k: Column) -> Column:
        term = s["term"] * x / (a + k)
        return F.struct(term.alias("term"), (s["total"] + term).alias("total"))

    series = 1 - front * F.aggregate(_steps(), start, add, lambda s: s["total"])
    b = x + 1 - a
    d0 = 1 / _away_from_zero(b)
    begin = F.struct(F.lit(1 / _TINY).alias("c"), d0.alias("d"), d0.alias("h"))

    def step(s: Column, k: Column) -> Column:
        an, bn = -k * (k - a), b + 2 * k
        d = 1 / _away_from_zero(an * s["d"] + bn)
        c = _away_from_zero(bn + an / s["c"])
        return F.struct(c.alias("c"), d.alias("d"), (s["h"] * d * c).alias("h"))

    fraction = front * F.aggregate(_steps(), begin, step, lambda s: s["h"])
    return F.when(x <= 0, 1.0).when(a > LARGE_SHAPE, large_gamma_tail(a, x)).when(x < a + 1, series).otherwise(fraction)


def _beta_fraction(a: Column, b: Column, x: Column) -> Column:
    d0 = 1 / _away_from_zero(1 - (a + b) * x / (a + 1))
    begin = F.struct(F.lit(1.0).alias("c"), d0.alias("d"), d0.alias("h"))

    def half(s: Column, an: Column) -> Column:
        d = 1 / _away_from_zero(1 + an * s["d"])
        c = _away_from_zero(1 + an / s["c"])
        return F.struct(c.alias("c"), d.alias("d"), (s["h"] * d * c).alias("h"))

    def step(s: Column, j: Column) -> Column:
        # Odd places of the walk take the even terms of the fraction, and the other way round.
        m = F.floor((j + 1) / 2).cast("double")
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return half(s, F.when(j % 2 == 1, even).otherwise(odd))

    return F.aggregate(F.sequence(F.lit(1), F.lit(2 * STEPS)), begin, step, lambda s: s["h"])


def beta_share(a: Column, b: Column, x: Column) -> Column:
    """Regularised incomplete beta function I_x(a, b)."""
    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.log(x) + b * F.log(1 - x))
    direct = front * _beta_fraction(a, b, x) / a
    mirrored = 1 - front * _beta_fraction(b, a, 1 - x) / b
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).when(x < (a + 1) / (a + b + 2), direct).otherwise(mirrored)


def chi_square_tail(x: Column, df: Column) -> Column:
    """P(X >= x) of the chi-square distribution; null for null or less than one degree of freedom."""
    return F.when(df >= 1, gamma_tail(df.cast("double") / 2, F.greatest(x.cast("double"), F.lit(0.0)) / 2))


def f_tail(f: Column, df1: Column, df2: Column) -> Column:
    """P(X >= f) of the F distribution; null without degrees of freedom."""
    a, b, f = df1.cast("double"), df2.cast("double"), F.when(f > 0, f.cast("double")).when(f.isNotNull(), 0.0)
    exact = beta_share(b / 2, a / 2, b / (b + a * f))
    shrunk = a * f * (2 * b + a * f / 3 + a - 2) / (2 * b + 4 * a * f / 3)
    return F.when((df1 >= 1) & (df2 > 0), F.when(b > MANY, chi_square_tail(shrunk, a)).otherwise(exact))


def t_two_sided(t: Column, df: Column) -> Column:
    """Two-sided p-value of Student's t."""
    return f_tail(t * t, F.lit(1), df)


def _simpson_sql(integrand: str, upper: str, cuts: int = 4000) -> str:
    """Integral from 0 to ``upper`` of an SQL expression of the place ``{u}``."""
    place = f"({upper} * i / {cuts}.0::DOUBLE)"
    weight = f"(CASE WHEN i = 0 OR i = {cuts} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)"
    return f"({upper} / {3 * cuts}.0::DOUBLE * list_sum(list_transform(range(0, {cuts + 1}), lambda i: {weight} * {integrand.format(u=place)})))"


def beta_share_sql(a: str, b: str, x: str) -> str:
    logs = lambda f, k: f"(2 * ({k}) - 1) * ln(greatest({f}({{u}}), 1e-300))"
    log_beta = f"(lgamma({a}) + lgamma({b}) - lgamma({a} + {b}))"
    return _simpson_sql(f"2 * exp({logs('sin', a)} + {logs('cos', b)} - {log_beta})", f"asin(sqrt({x}))")


def f_tail_sql(f: str, df1: str, df2: str) -> str:
    d1, d2 = f"(({df1})::DOUBLE)", f"(({df2})::DOUBLE)"
    return beta_share_sql(f"({d2} / 2)", f"({d1} / 2)", f"({d2} / ({d2} + {d1} * ({f})))")


def t_two_sided_sql(t: str, df: str) -> str:
    return f_tail_sql(f"({t}) * ({t})", "1", df)


def chi_square_tail_sql(x: str, df: str) -> str:
    k = f"(({df})::DOUBLE)"
    body = f"exp(ln(2::DOUBLE) + ({k} - 1) * ln(greatest({{u}}, 1e-300)) - {{u}} * {{u}} / 2 - {k} / 2 * ln(2::DOUBLE) - lgamma({k} / 2))"
    return f"(1 - {_simpson_sql(body, f'sqrt({x})')})"
