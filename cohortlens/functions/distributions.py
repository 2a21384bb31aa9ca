"""Tail probabilities of the F, t, chi-squared and normal distributions.

Applied only to small statistic tables (one row per feature or test) as
Arrow-batched pandas UDFs.

Both regularised incomplete functions are written as a leading density term
times a continued fraction.  The term is built from deviances
(``a (log(1+d) - d)`` and ``a log(x/p)``) and Stirling corrections, never from
differences of large log-gammas, so it keeps its digits for any degrees of
freedom.  The fractions run until they settle: about the square root of the
parameter in steps, so there is no cap on them.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

_HALF_LOG_2PI = 0.5 * math.log(2 * math.pi)


def _log1p_less(d: float) -> float:
    """log(1 + d) - d without cancellation."""
    if abs(d) > 0.1:
        return math.log1p(d) - d
    total, power, k = 0.0, d, 2
    while True:
        power *= -d
        if total + power / k == total:
            return total
        total += power / k
        k += 1


def _stirling_rest(a: float) -> float:
    """lgamma(a) less Stirling's leading terms."""
    if a < 10:
        return math.lgamma(a) - ((a - 0.5) * math.log(a) - a + _HALF_LOG_2PI)
    r = 1 / (a * a)
    return (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r * (1 / 1680 - r / 1188)))) / a


def _fraction(terms) -> float:
    """Value of ``b0 + a1/(b1 + a2/(b2 + ...))`` from its ``(a, b)`` terms, evaluated forward until it settles."""
    tiny = 1e-300
    _, b = next(terms)
    value = ratio = b or tiny
    inverse = 0.0
    for a, b in terms:
        inverse = 1 / ((b + a * inverse) or tiny)
        ratio = (b + a / ratio) or tiny
        step = ratio * inverse
        value *= step
        if abs(step - 1) < 4e-16:
            return value
    return value


def _gamma_density(a: float, x: float) -> float:
    """x^a e^-x / Gamma(a)."""
    return math.exp(a * _log1p_less((x - a) / a) + 0.5 * math.log(a) - _HALF_LOG_2PI - _stirling_rest(a))


def gammaincc(a: float, x: float) -> float:
    """Regularised upper incomplete gamma Q(a, x)."""
    if x <= 0:
        return 1.0
    if x >= a + 1:
        def upper():
            yield 0.0, x + 1 - a
            k = 1
            while True:
                yield -k * (k - a), x + 2 * k + 1 - a
                k += 1
        return _gamma_density(a, x) / _fraction(upper())
    total = term = 1 / a
    k = a
    while term > total * 1e-17:
        k += 1
        term *= x / k
        total += term
    return 1 - total * _gamma_density(a, x)


def _beta_density(a: float, b: float, x: float, y: float) -> float:
    """x^a y^b / B(a, b) for y = 1 - x."""
    n = a + b
    # a log(x / (a/n)) + b log(y / (b/n)): deviations from the mode cancel to first order
    d = x * b - y * a
    dev = a * _log1p_less(d / a) + b * _log1p_less(-d / b)
    return math.exp(dev + 0.5 * (math.log(a) + math.log(b) - math.log(n)) - _HALF_LOG_2PI
                    + _stirling_rest(n) - _stirling_rest(a) - _stirling_rest(b))


def betainc(a: float, b: float, x: float, y: float | None = None) -> float:
    """Regularised incomplete beta I_x(a, b); ``y`` is 1 - x where it is known more exactly."""
    y = 1 - x if y is None else y
    if x <= 0 or y <= 0:
        return 0.0 if x <= 0 else 1.0
    if x * (a + b + 2) > a + 1:
        return 1 - betainc(b, a, y, x)

    def lower():
        yield 0.0, 1.0
        k = 0
        while True:
            yield -(a + k) * (a + b + k) * x / ((a + 2 * k) * (a + 2 * k + 1)), 1.0
            k += 1
            yield k * (b - k) * x / ((a + 2 * k - 1) * (a + 2 * k)), 1.0
    return _beta_density(a, b, x, y) / a / _fraction(lower())


def _missing(*v) -> bool:
    return any(x is None or math.isnan(x) for x in v)


def f_sf(f: float, d1: float, d2: float) -> float:
    if _missing(f, d1, d2) or d1 <= 0 or d2 <= 0:
        return float("nan")
    if f <= 0:
        return 1.0
    x = d1 * f
    if d2 > 1e8 * max(1.0, x * x / 4, d1 * d1):      # the limit; it differs by about x^2 / d2
        return chi2_sf(x, d1)
    return betainc(d2 / 2, d1 / 2, d2 / (d2 + x), x / (d2 + x))


def chi2_sf(x: float, k: float) -> float:
    if _missing(x, k) or k <= 0:
        return float("nan")
    return gammaincc(k / 2, x / 2)


def norm_sf(z: float) -> float:
    if _missing(z):
        return float("nan")
    return 0.5 * math.erfc(z / math.sqrt(2))


def t_two_sided(t: float, df: float) -> float:
    if _missing(t, df) or df <= 0:
        return float("nan")
    return f_sf(t * t, 1.0, df)


def _vec(fn):
    def run(*cols: pd.Series) -> pd.Series:
        arrs = [c.to_numpy(dtype="float64", na_value=np.nan) for c in cols]
        return pd.Series([fn(*vals) for vals in zip(*arrs)], dtype="float64")
    return run


def _udf(fn):
    # built lazily on the driver: creating a pandas UDF at import time would
    # also run inside Python workers, where no session exists
    return F.pandas_udf(_vec(fn), "double")


def f_pvalue(f: Column, d1: Column, d2: Column) -> Column:
    return _udf(f_sf)(f.cast("double"), d1.cast("double"), d2.cast("double"))


def chi2_pvalue(x: Column, k: Column) -> Column:
    return _udf(chi2_sf)(x.cast("double"), k.cast("double"))


def norm_two_sided_pvalue(z: Column) -> Column:
    return F.least(F.lit(1.0), F.lit(2.0) * _udf(norm_sf)(F.abs(z).cast("double")))


def t_pvalue(t: Column, df: Column) -> Column:
    return _udf(t_two_sided)(t.cast("double"), df.cast("double"))
