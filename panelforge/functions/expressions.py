"""Expressions used across operators, as text that Spark and ANSI engines read alike, and as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(x: Column, low: float, high: float) -> Column:
    """x kept within [low, high]; null stays null."""
    return F.when(x < low, F.lit(low)).when(x > high, F.lit(high)).otherwise(x)


def ratio(a: Column, b: Column) -> Column:
    """a / b; null where b is null or 0."""
    return F.when(b != 0, a / b)


def rounded_halves(x: Column, digits: int) -> Column:
    """x rounded as SQL's ROUND does: scaled, and halves of the scaled number away from zero (F.round looks at the decimal digits of x)."""
    return F.round(x * 10.0**digits) / 10.0**digits


def uniform(*parts: Column | str) -> Column:
    """A portable uniform number in [0, 1): the first 8 hexadecimal digits of the md5 of the parts joined by '|'."""
    digits = F.substring(F.md5(F.concat_ws("|", *[p if isinstance(p, Column) else F.lit(p) for p in parts]).cast("binary")), 1, 8)
    return F.conv(digits, 16, 10).cast("double") / 4294967296.0


#: Coefficients of the rational approximation to the normal quantile (Acklam, relative error below 1.2e-9).
_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)


def _horner(coefficients, x: Column) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + F.lit(c)
    return out


def probit(p: Column) -> Column:
    """Normal quantile of p in (0, 1)."""
    q, tail = p - 0.5, lambda x: F.sqrt(-2 * F.log(x))
    middle = _horner(_A, q * q) * q / _horner((*_B, 1.0), q * q)
    low = _horner(_C, tail(p)) / _horner((*_D, 1.0), tail(p))
    high = -_horner(_C, tail(1 - p)) / _horner((*_D, 1.0), tail(1 - p))
    return F.when(p < 0.02425, low).when(p > 1 - 0.02425, high).otherwise(middle)


#: Coefficients of the rational approximation to the complementary error function (Numerical Recipes erfcc, relative error below 1.2e-7).
_ERFC = (0.17087277, -0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223)


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution function (error below 1e-7)."""
    x = F.abs(z) / 1.4142135623730951
    t = 1 / (1 + 0.5 * x)
    upper = 0.5 * t * F.exp(-x * x + _horner(_ERFC, t))
    return F.when(z > 0, 1 - upper).otherwise(upper)


def two_sided(z: Column) -> Column:
    """Two-sided normal p-value of z."""
    return 2 * normal_cdf(-F.abs(z))


def adjusted_skewness(population: Column, n: Column) -> Column:
    """Bias-adjusted sample skewness from the population one; null below 3 rows."""
    return F.when(n > 2, population * F.sqrt(n * (n - 1)) / (n - 2))


def adjusted_kurtosis(population_excess: Column, n: Column) -> Column:
    """Bias-adjusted sample excess kurtosis from the population one; null below 4 rows."""
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * population_excess + 6))
