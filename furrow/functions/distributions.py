"""Tail probabilities for result rows (normal, t, chi-square).

Spark SQL has no erf or incomplete beta; these run as pandas UDFs on result
tables, never on inputs.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return h


def beta_inc(a: float, b: float, x: float) -> float:
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1 - x) / b


def t_sf2(t: float, df: float) -> float:
    """Two-sided tail of the t distribution."""
    return beta_inc(df / 2.0, 0.5, df / (df + t * t))


def t_ppf(p: float, df: float) -> float:
    if p == 0.5:
        return 0.0
    target = 2 * min(p, 1 - p)
    lo, hi = 0.0, 1.0
    while t_sf2(hi, df) > target:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if t_sf2(mid, df) > target else (lo, mid)
    return math.copysign((lo + hi) / 2, p - 0.5)


def chi2_sf(x: float, df: float) -> float:
    """Upper tail of chi-square by the series of the lower incomplete gamma."""
    if x <= 0:
        return 1.0
    a, z = df / 2.0, x / 2.0
    log_front = a * math.log(z) - z - math.lgamma(a)
    if z < a + 1:
        term = total = 1.0 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= z / n
            total += term
        return 1.0 - total * math.exp(log_front)
    b = z + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h * math.exp(log_front)


def _lift(fn, *series: pd.Series) -> pd.Series:
    out = [
        fn(*map(float, vals)) if all(v is not None and np.isfinite(v) for v in vals) else None
        for vals in zip(*series)
    ]
    return pd.Series(out, dtype="float64")


@F.pandas_udf(DoubleType())
def normal_p2(z: pd.Series) -> pd.Series:
    """Two-sided normal p-value."""
    return _lift(lambda v: math.erfc(abs(v) / math.sqrt(2)), z)


@F.pandas_udf(DoubleType())
def t_p2(t: pd.Series, df: pd.Series) -> pd.Series:
    return _lift(t_sf2, t, df)


@F.pandas_udf(DoubleType())
def t_quantile(p: pd.Series, df: pd.Series) -> pd.Series:
    return _lift(t_ppf, p, df)


@F.pandas_udf(DoubleType())
def chi2_p(x: pd.Series, df: pd.Series) -> pd.Series:
    return _lift(chi2_sf, x, df)
