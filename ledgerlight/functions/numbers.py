"""Number helpers: finite values, safe ratios, display text and two quantile functions."""

from __future__ import annotations

import math
from functools import lru_cache
from statistics import NormalDist

from pyspark.sql import Column, functions as F


def finite(value: Column) -> Column:
    """NULL in place of NaN and the infinities."""
    number = value.cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) != float("inf")), number)


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division that gives NULL for a zero denominator, whatever the ANSI setting."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def percent_text(fraction: Column) -> Column:
    return F.concat(F.bround(fraction * 100, 0).cast("bigint").cast("string"), F.lit("%"))


def count_text(count: Column, singular: str, plural: str | None = None) -> Column:
    noun = F.when(count == 1, F.lit(singular)).otherwise(F.lit(plural or singular + "s"))
    return F.concat_ws(" ", count.cast("string"), noun)


def normal_quantile(probability: float) -> float:
    return NormalDist().inv_cdf(probability)


def _student_tail(t: float, degrees: int) -> float:
    """P(T > t) for t >= 0, by the finite series for whole degrees of freedom."""
    theta = math.atan2(t, math.sqrt(degrees))
    sine, cosine = math.sin(theta), math.cos(theta)
    if degrees % 2:
        term, total = cosine, (cosine if degrees > 1 else 0.0)
        for k in range(3, degrees - 1, 2):
            term *= cosine * cosine * (k - 1) / k
            total += term
        inside = (2 / math.pi) * (theta + sine * total)
    else:
        term = total = 1.0
        for k in range(2, degrees - 1, 2):
            term *= cosine * cosine * (k - 1) / k
            total += term
        inside = sine * total
    return 0.5 * (1 - inside)


@lru_cache(maxsize=None)
def student_quantile(probability: float, degrees: int) -> float:
    """Upper quantile of Student's t (probability >= 0.5), by bisection."""
    low, high = 0.0, 1.0
    while _student_tail(high, degrees) > 1 - probability:
        high *= 2
    for _ in range(200):
        middle = (low + high) / 2
        if _student_tail(middle, degrees) > 1 - probability:
            low = middle
        else:
            high = middle
    return (low + high) / 2
