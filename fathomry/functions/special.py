"""Special functions in numpy, for p-values and critical values."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np


def ln_gamma(x):
    x = np.asarray(x, float)
    z = x + 7
    shift = np.ones_like(x)
    for k in range(7):
        shift = shift * (x + k)
    return (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - np.log(shift)


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised, by Lentz's continued fraction."""
    if not 0 < x < 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    f = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            f *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * f


def t_two_sided(t: float, df: float) -> float:
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def normal_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


@lru_cache(4096)
def t_quantile(p: float, df: float) -> float:
    """The t with P(T <= t) = p, by bisection."""
    if p < 0.5:
        return -t_quantile(1 - p, df)
    lo, hi = 0.0, 1.0
    while 1 - t_two_sided(hi, df) / 2 < p:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 1 - t_two_sided(mid, df) / 2 < p else (lo, mid)
    return (lo + hi) / 2


def grubbs_critical(n: int, alpha: float = 0.05) -> float:
    """Two-sided critical value of the largest deviation in standard deviations."""
    t = t_quantile(1 - alpha / (2 * n), n - 2)
    return (n - 1) / math.sqrt(n) * math.sqrt(t * t / (n - 2 + t * t))


def mann_whitney_counts(n1: int, n2: int) -> np.ndarray:
    """How many orders of n1 and n2 values give each U: the coefficients of a Gaussian binomial."""
    size = n1 * n2 + 1
    c = np.zeros(size)
    c[0] = 1
    for k in range(1, min(n1, n2) + 1):
        top = max(n1, n2) + k
        for u in range(size - 1, top - 1, -1):
            c[u] -= c[u - top]
        for u in range(k, size):
            c[u] += c[u - k]
    return c


def mann_whitney_p(u1: float, n1: int, n2: int, ties: float) -> float:
    """Two-sided; ties: the sum of t^3 - t over groups of equal values. Exact for a small side without ties."""
    u = max(u1, n1 * n2 - u1)
    if (n1 <= 8 or n2 <= 8) and not ties:
        c = mann_whitney_counts(n1, n2)
        return float(min(1.0, 2 * c[math.ceil(u) :].sum() / c.sum()))
    n = n1 + n2
    var = n1 * n2 / 12 * ((n + 1) - ties / (n * (n - 1)))
    if var <= 0:
        return 1.0
    return min(1.0, 2 * normal_sf(max(0.0, (abs(u1 - n1 * n2 / 2) - 0.5) / math.sqrt(var))))
