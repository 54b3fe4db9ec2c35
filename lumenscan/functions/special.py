"""Distribution functions for tests on a few aggregated numbers, without SciPy."""

from __future__ import annotations

import math

import numpy as np


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Lentz's continued fraction of the incomplete beta function."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 1000):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + top * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + top / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def gamma_q(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return 1 - front * total
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10000):
        top = -i * (i - a)
        b += 2
        d = top * d + b
        d = 1 / (d if abs(d) > tiny else tiny)
        c = b + top / c
        c = c if abs(c) > tiny else tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def f_survival(f: float, d1: float, d2: float) -> float:
    return beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if f > 0 else 1.0


def t_two_sided(t: float, df: float) -> float:
    return beta_inc(df / 2, 0.5, df / (df + t * t))


def chi2_survival(x: float, df: float) -> float:
    return gamma_q(df / 2, x / 2)


def normality_p(n: int, g1: float, g2: float) -> float | None:
    """D'Agostino and Pearson's omnibus test from the population skewness and kurtosis (3 for a normal)."""
    if n < 20:
        return None
    y = g1 * math.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    b2 = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = -1 + math.sqrt(2 * (b2 - 1))
    delta, alpha = 1 / math.sqrt(0.5 * math.log(w2)), math.sqrt(2 / (w2 - 1))
    y = y if y else 1.0
    z1 = delta * math.log(y / alpha + math.sqrt((y / alpha) ** 2 + 1))
    mean = 3 * (n - 1) / (n + 1)
    var = 24 * n * (n - 2) * (n - 3) / ((n + 1) ** 2 * (n + 3) * (n + 5))
    x = (g2 - mean) / math.sqrt(var)
    beta1 = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * math.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / beta1 * (2 / beta1 + math.sqrt(1 + 4 / beta1**2))
    low = 1 + x * math.sqrt(2 / (a - 4))
    z2 = ((1 - 2 / (9 * a)) - math.copysign((1 - 2 / a) / abs(low), low) ** (1 / 3) if low > 0 else (1 - 2 / (9 * a)) + ((1 - 2 / a) / abs(low)) ** (1 / 3)) / math.sqrt(2 / (9 * a))
    return math.exp(-(z1 * z1 + z2 * z2) / 2)


def _golden(f, low: float, high: float, rounds: int = 80) -> float:
    ratio = (math.sqrt(5) - 1) / 2
    a, b = high - ratio * (high - low), low + ratio * (high - low)
    fa, fb = f(a), f(b)
    for _ in range(rounds):
        if fa > fb:
            high, b, fb = b, a, fa
            a = high - ratio * (high - low)
            fa = f(a)
        else:
            low, a, fa = a, b, fb
            b = low + ratio * (high - low)
            fb = f(b)
    return (low + high) / 2


def boxcox_lambda(x: np.ndarray) -> float:
    logs = np.log(x)

    def likelihood(lam: float) -> float:
        y = logs if abs(lam) < 1e-9 else np.expm1(lam * logs) / lam
        return (lam - 1) * logs.sum() - len(x) / 2 * math.log(max(y.var(), 1e-300))

    return _golden(likelihood, -5, 5)


def yeojohnson(x: np.ndarray, lam: float) -> np.ndarray:
    up, down = np.maximum(x, 0), np.maximum(-x, 0)
    high = np.log1p(up) if abs(lam) < 1e-9 else np.expm1(lam * np.log1p(up)) / lam
    low = np.log1p(down) if abs(lam - 2) < 1e-9 else np.expm1((2 - lam) * np.log1p(down)) / (2 - lam)
    return np.where(x >= 0, high, -low)


def yeojohnson_lambda(x: np.ndarray) -> float:
    logs = (np.sign(x) * np.log1p(np.abs(x))).sum()
    return _golden(lambda lam: (lam - 1) * logs - len(x) / 2 * math.log(max(yeojohnson(x, lam).var(), 1e-300)), -5, 5)
