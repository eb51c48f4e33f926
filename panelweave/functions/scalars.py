"""Column functions shared by the operators. All stay inside the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Abramowitz & Stegun 7.1.26, the rational approximation of erf.
ERF_P = 0.3275911
ERF_COEFFICIENTS = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)

# Significance levels and their marks.
STAR_LEVELS = ((0.01, "***"), (0.05, "**"), (0.10, "*"))


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(num: Column, den: Column) -> Column:
    """Division that gives NULL for a zero denominator, also in ANSI mode."""
    return num / F.when(den != 0, den)


def percent_to_log(c: Column | str) -> Column:
    return F.log1p(col(c) / 100)


def log_to_simple(c: Column | str) -> Column:
    return F.expm1(col(c))


def simple_to_log(c: Column | str) -> Column:
    return F.log1p(col(c))


def clip(c: Column | str, low: Column | float, high: Column | float) -> Column:
    """Bound a value; NULL stays NULL (``least`` alone would skip it)."""
    c = col(c)
    low = low if isinstance(low, Column) else F.lit(float(low))
    high = high if isinstance(high, Column) else F.lit(float(high))
    return F.when(c.isNotNull(), F.least(F.greatest(c, low), high))


def negative_part(c: Column | str) -> Column:
    c = col(c)
    return F.when(c.isNotNull(), F.least(c, F.lit(0.0)))


def fisher_z(rho: Column | str, bound: float = 0.9999) -> Column:
    return F.atanh(clip(rho, -bound, bound))


def inverse_fisher_z(z: Column | str, bound: float = 3.0) -> Column:
    return F.tanh(clip(z, -bound, bound))


def two_sided_p(stat: Column | str) -> Column:
    """``2 * (1 - Phi(|stat|))`` from the fixed erf approximation."""
    x = F.abs(col(stat))
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(ERF_P) * x / math.sqrt(2.0))
    poly = F.lit(0.0)
    for a in reversed(ERF_COEFFICIENTS):
        poly = (poly + F.lit(a)) * t
    return poly * F.exp(-x * x / 2)


def normal_cdf(x: Column | str) -> Column:
    x = col(x)
    upper = two_sided_p(x) / 2
    return F.when(x >= 0, 1 - upper).otherwise(upper)


def normal_log_density(y: Column, mean: Column, variance: Column, floor: float = 1e-10) -> Column:
    v = F.greatest(variance, F.lit(floor))
    return -0.5 * (F.log(2 * math.pi * v) + (y - mean) * (y - mean) / v)


def hansen_constants(nu: float, lam: float) -> tuple[float, float, float]:
    """Constants (a, b, c) of the unit-variance skewed t of Hansen (1994)."""
    c = math.exp(math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2)) / math.sqrt(math.pi * (nu - 2))
    a = 4 * lam * c * (nu - 2) / (nu - 1)
    return a, math.sqrt(1 + 3 * lam * lam - a * a), c


def skewed_t_log_density(z: Column | str, nu: float, lam: float) -> Column:
    a, b, c = hansen_constants(nu, lam)
    s = F.lit(b) * col(z) + F.lit(a)
    side = F.when(s < 0, F.lit(1 - lam)).otherwise(F.lit(1 + lam))
    return math.log(b * c) - (nu + 1) / 2 * F.log1p((s / side) * (s / side) / (nu - 2))


def stars(p: Column | str) -> Column:
    p = col(p)
    out = F.lit("")
    for level, mark in reversed(STAR_LEVELS):
        out = F.when(p < level, F.lit(mark)).otherwise(out)
    return out


def number_text(c: Column | str, digits: int = 3, missing: str = "-") -> Column:
    x = F.round(col(c), digits)
    return F.when(x.isNull(), F.lit(missing)).otherwise(F.format_string(f"%.{digits}f", x))


def strategy_label(*parts: Column | str) -> Column:
    return F.concat_ws("-", *[col(p) for p in parts])
