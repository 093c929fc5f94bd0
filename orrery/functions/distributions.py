"""Tail probabilities, from their series and continued fractions (no further library needed)."""

from __future__ import annotations

import math

_TINY = 1e-300


def gamma_upper(a: float, x: float) -> float:
    """Regularized upper incomplete gamma function Q(a, x)."""
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return 1 - total * front
    b = x + 1 - a
    c, d = 1 / _TINY, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or _TINY)
        c = b + an / c or _TINY
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return front * h


def chi_square_tail(x: float, df: float) -> float:
    return 1.0 if df == 0 else gamma_upper(df / 2, x / 2)


def _beta_fraction(a: float, b: float, x: float) -> float:
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or _TINY)
    h = d
    for m in range(1, 10_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d or _TINY)
            c = 1 + num / c or _TINY
            h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return h


def beta_lower(a: float, b: float, x: float) -> float:
    """Regularized incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_two_sided(t: float, df: float) -> float:
    return beta_lower(df / 2, 0.5, df / (df + t * t))


def normal_cdf(x: float, mean: float = 0.0, std: float = 1.0) -> float:
    return 0.5 * math.erfc((mean - x) / (std * math.sqrt(2)))


def kolmogorov_tail(statistic: float, n: int) -> float:
    """Asymptotic p-value of the one-sample test."""
    if n == 0 or statistic <= 0:
        return 1.0
    x = (math.sqrt(n) + 0.12 + 0.11 / math.sqrt(n)) * statistic
    total = 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101))
    return min(max(total, 0.0), 1.0)
