"""Student t, F and chi-square distributions from the regularised incomplete beta and gamma functions."""

from __future__ import annotations

import math
from statistics import NormalDist

EPS, TINY, STEPS = 1e-15, 1e-300, 500


def _continued(term, first: float) -> float:
    """A continued fraction by the modified Lentz method; term(k) gives (numerator, denominator)."""
    f = first or TINY
    c, d = f, 0.0
    for k in range(1, STEPS):
        a, b = term(k)
        d = b + a * d or TINY
        c = b + a / c or TINY
        d = 1 / d
        f *= c * d
        if abs(c * d - 1) < EPS:
            break
    return f


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)

    def term(k: int) -> tuple[float, float]:
        m = k // 2
        if k % 2 == 0:
            return m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), 1.0
        return -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)), 1.0

    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front / (a * _continued(term, 1.0))


def gamma_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        total = step = 1 / a
        k = a
        while abs(step) > abs(total) * EPS:
            k += 1
            step *= x / k
            total += step
        return 1 - front * total
    return front / _continued(lambda k: (k * (a - k), x + 2 * k + 1 - a), x + 1 - a)


def t_cdf(t: float, df: float) -> float:
    if math.isnan(t):
        return math.nan
    if math.isinf(t):
        return 1.0 if t > 0 else 0.0
    tail = beta_inc(df / 2, 0.5, df / (df + t * t)) / 2
    return 1 - tail if t > 0 else tail


def t_two_sided(t: float, df: float) -> float:
    """P(|T| > |t|), without cancellation in the tail."""
    if math.isnan(t):
        return math.nan
    return 0.0 if math.isinf(t) else min(1.0, max(0.0, beta_inc(df / 2, 0.5, df / (df + t * t))))


def t_quantile(p: float, df: float) -> float:
    """Bisection on a bracket that grows until it holds p."""
    if not 0 < p < 1:
        return -math.inf if p <= 0 else math.inf
    if p < 0.5:
        return -t_quantile(1 - p, df)
    low, high = 0.0, max(1.0, NormalDist().inv_cdf(p) * 2 if p < 1 else 2.0)
    while t_cdf(high, df) < p:
        low, high = high, high * 2
    for _ in range(200):
        mid = (low + high) / 2
        if mid in (low, high):
            break
        low, high = (mid, high) if t_cdf(mid, df) < p else (low, mid)
    return (low + high) / 2


def f_upper(f: float, d1: float, d2: float) -> float:
    if math.isnan(f):
        return math.nan
    if math.isinf(f):
        return 0.0
    return 1.0 if f <= 0 else beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def chi2_upper(x: float, df: float) -> float:
    return gamma_upper(df / 2, x / 2)
