"""Tail probabilities of the chi-square, normal and t distributions, as column expressions.

Series and continued fractions are folded from their last term to their first, so a fold carries
one number. How many terms there are follows from the arguments.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The asymptotic series below are used from here on; smaller arguments are led there by recurrence.
_FAR = 10
#: exp of less is 0 as a double.
_LEAST_LOG = -745.0


def _down(terms: Column, first: Column, step: Callable[[Column, Column], Column]) -> Column:
    """``step(value, k)`` for k = terms, ..., 2, 1, from ``first``."""
    return F.aggregate(F.sequence(terms, F.lit(1), F.lit(-1)), first, step)


def log_gamma(a: Column) -> Column:
    """ln of the gamma function of a > 0, by Stirling's series at a + 10."""
    z = a + _FAR
    shifted = sum((F.log(a + k) for k in range(1, _FAR)), F.log(a))
    return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7) - shifted


def log_gamma_half_step(a: Column) -> Column:
    """ln of gamma(a + 1/2) / gamma(a), without the difference of two large logarithms."""
    z = a + _FAR
    shifted = sum((F.log1p(0.5 / (a + k)) for k in range(1, _FAR)), F.log1p(0.5 / a))
    return 0.5 * F.log(z) - 1 / (8 * z) + 1 / (192 * z**3) - 1 / (640 * z**5) + 17 / (14336 * z**7) - shifted


def _exp(x: Column) -> Column:
    return F.when(x < _LEAST_LOG, 0.0).otherwise(F.exp(x))


def gamma_tail(a: Column, x: Column) -> Column:
    """The regularized upper incomplete gamma function of a > 0 and x > 0."""
    terms = (60 + F.ceil(12 * F.sqrt(a))).cast("int")
    front = -x + a * F.log(x) - log_gamma(a)
    series = _down(terms, F.lit(1.0), lambda s, k: 1 + x / (a + k) * s) / a
    fraction = _down(terms, x + 2 * terms + 1 - a, lambda f, k: x + 2 * k - 1 - a - k * (k - a) / f)
    return F.when(x < a + 1, 1 - _exp(front) * series).otherwise(_exp(front) / fraction)


def chi2_tail(x: Column, df: Column) -> Column:
    """P(chi-square with df degrees of freedom > x); null if x is null or df is not over 0."""
    x, df = x.cast("double"), df.cast("double")
    return F.when(df > 0, F.when(x <= 0, 1.0).otherwise(gamma_tail(df / 2, x / 2)))


def normal_two_sided(z: Column) -> Column:
    """P(|Z| > |z|): the tail of a chi-square of one degree."""
    return chi2_tail(z * z, F.lit(1))


def _beta_fraction(a: Column, b: Column, x: Column, terms: int = 120) -> Column:
    """What the front factor of the incomplete beta function is divided by."""

    def step(f: Column, m: Column) -> Column:
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = (a + m - 1) * (a + b + m - 1) * x / ((a + 2 * m - 2) * (a + 2 * m - 1))
        return 1 - odd / (1 + even / f)

    return _down(F.lit(terms), F.lit(1.0), step)


def t_two_sided(t: Column, df: Column) -> Column:
    """P(|T| > |t|) with df degrees of freedom; null if t is null or df is not over 0."""
    t, df = t.cast("double"), df.cast("double")
    a, b, square = df / 2, F.lit(0.5), t * t
    x, y = df / (df + square), square / (df + square)
    front = _exp(log_gamma_half_step(a) - 0.5 * math.log(math.pi) - a * F.log1p(square / df) + 0.5 * F.log(y))
    near = 1 - front * 2 / _beta_fraction(b, a, y)
    far = front / (a * _beta_fraction(a, b, x))
    return F.when(df > 0, F.when(square == 0, 1.0).when(x < (a + 1) / (a + 2.5), far).otherwise(near))
