"""Student-t tail probability for the small k x k correlation table.

Driver-side on one-row statistics only (SciPy is not available).  Uses the
regularised incomplete beta function by its continued fraction.
"""

from __future__ import annotations

import math


def _coefficient(k: int, a: float, b: float, x: float) -> float:
    """k-th partial numerator of 1 + d1/(1 + d2/(1 + ...)), the fraction of the incomplete beta function."""
    m = k // 2
    if k % 2:
        return -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
    return m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))


def _fraction(a: float, b: float, x: float) -> float:
    """The fraction from its end backwards, with twice the terms until the value stays."""
    terms, before = 32, None
    while True:
        value = 1.0
        for k in range(terms, 0, -1):
            value = 1.0 + _coefficient(k, a, b, x) / value
        if before is not None and (abs(value - before) <= 1e-15 * abs(value) or terms >= 1 << 16):
            return value
        before, terms = value, 2 * terms


def betainc_reg(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    ln_front = (math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
                + a * math.log(x) + b * math.log1p(-x))
    front = math.exp(ln_front)
    if x < (a + 1.0) / (a + b + 2.0):
        return front / (a * _fraction(a, b, x))
    return 1.0 - front / (b * _fraction(b, a, 1.0 - x))


def t_two_sided_p(t: float, df: float) -> float:
    """Two-sided p-value of Student's t with ``df`` degrees of freedom."""
    if df <= 0 or math.isnan(t):
        return float("nan")
    if math.isinf(t):
        return 0.0
    return betainc_reg(df / 2.0, 0.5, df / (df + t * t))


def pearson_p_value(r: float, n: int) -> float:
    """p-value of a Pearson r from n complete pairs (t = r sqrt((n-2)/(1-r^2)))."""
    if n is None or n < 3 or r is None or math.isnan(r):
        return float("nan")
    if abs(r) >= 1.0:
        return 0.0
    t = r * math.sqrt((n - 2) / (1.0 - r * r))
    return t_two_sided_p(t, n - 2)
