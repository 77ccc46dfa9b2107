"""Tail probabilities, evaluated on already aggregated rows.

Survival functions throughout (never one minus a distribution function), so that
a p-value of 1e-250 is not rounded to zero.
"""

from __future__ import annotations

import math
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Ship these helpers with the tasks, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def chi2_tail(x: float) -> float:
    """P(X > x) for a chi-square with one degree of freedom."""
    return math.erfc(math.sqrt(max(x, 0.0) / 2.0))


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


# From this many degrees of freedom on, Student's tail goes through the normal one.
NORMAL_FROM = 1e5
STEPS = 20_000


def chi2_critical(p: float) -> float:
    """The value that a chi-square with one degree of freedom exceeds with probability p."""
    low, high = 0.0, 2000.0
    for _ in range(200):
        x = (low + high) / 2
        low, high = (x, high) if chi2_tail(x) > p else (low, x)
    return high


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    floor = 1e-300
    front, back = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    back = 1.0 / (back if abs(back) > floor else floor)
    value = back
    for m in range(1, STEPS):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        change = 1.0
        for term in (even, odd):
            back = 1.0 + term * back
            back = 1.0 / (back if abs(back) > floor else floor)
            front = 1.0 + term / front
            front = front if abs(front) > floor else floor
            change = back * front
            value *= change
        if abs(change - 1.0) < 1e-15:
            return value
    raise ArithmeticError(f"no convergence for a={a}, b={b}, x={x}")


def _half_step(a: float) -> float:
    """log of gamma(a + 1/2) / gamma(a), by its series where the difference would cancel."""
    if a < 50:
        return math.lgamma(a + 0.5) - math.lgamma(a)
    series = -1 / (8 * a) + 1 / (192 * a**3) - 1 / (640 * a**5) + 17 / (14336 * a**7)
    return 0.5 * math.log(a) + series


def student_two_sided(t: float, df: float) -> float:
    """P(|T| > |t|) for Student's t; zero for an infinite statistic."""
    if math.isinf(t):
        return 0.0
    if df >= NORMAL_FROM:
        # A normal deviate with the same tail (Hill's expansion), relative error below 1e-12.
        a = df - 0.5
        square = a * math.log1p(t * t / df)
        z, b = math.sqrt(square), 48 * a * a
        more = ((-0.4 * square - 3.3) * square - 24) * square - 85.5
        more = more / (0.8 * square * square + 100 + b) + square + 3
        return normal_two_sided((more / b + 1) * z)
    a, b = df / 2.0, 0.5
    ratio = t * t / df
    x, y = 1 / (1 + ratio), ratio / (1 + ratio)
    if y <= 0.0:
        return 1.0
    scale = math.exp(_half_step(a) - math.lgamma(b) - a * math.log1p(ratio) + b * math.log(y))
    if x < (a + 1.0) / (a + b + 2.0):
        return scale * _beta_fraction(a, b, x) / a
    return 1.0 - scale * _beta_fraction(b, a, y) / b


@F.pandas_udf(T.DoubleType())
def chi2_p(x: pd.Series) -> pd.Series:
    return x.map(lambda v: None if pd.isna(v) else chi2_tail(v)).astype("float64")


@F.pandas_udf(T.DoubleType())
def student_p(t: pd.Series, df: pd.Series) -> pd.Series:
    pairs = zip(t, df)
    out = [
        None if pd.isna(a) or pd.isna(b) or b <= 0 else student_two_sided(a, b) for a, b in pairs
    ]
    return pd.Series(out, dtype="float64")
