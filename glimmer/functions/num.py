"""Small numeric helpers: sums of columns and driver-side distributions."""

from __future__ import annotations

import math
from collections.abc import Iterable
from functools import reduce
from operator import add

from pyspark.sql import Column


def total(columns: Iterable[Column]) -> Column:
    return reduce(add, columns)


def chi2_sf_even(t: float, dof: int) -> float:
    """Survival function of chi-square for an even number of degrees of freedom."""
    half, term, out = t / 2.0, 1.0, 1.0
    for k in range(1, dof // 2):
        term *= half / k
        out += term
    return math.exp(-half) * out


def gamma_sf(x: float, shape: float) -> float:
    """Upper regularised incomplete gamma function by its series."""
    if x <= 0:
        return 1.0
    if x > shape + 40 * math.sqrt(shape + 1) + 40:
        return 0.0
    term = out = 1.0 / shape
    n = shape
    while term > out * 1e-15:
        n += 1
        term *= x / n
        out += term
    return max(0.0, 1.0 - out * math.exp(-x + shape * math.log(x) - math.lgamma(shape)))


def _solve(f, low: float, high: float) -> float:
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) else (low, mid)
    return (low + high) / 2


def chi2_quantile(p: float, dof: float) -> float:
    return _solve(lambda t: gamma_sf(t / 2, dof / 2) > 1 - p, 0.0, dof + 40 * math.sqrt(2 * dof) + 40)


def detectable_diffusion(n: int, sigma_nm: float, interval_s: float, alpha: float = 0.05) -> float:
    """Diffusion coefficient (nm2/s) at which half of the moving molecules of ``n`` points fail
    the static test; infinite without a precision or for fewer than three points.

    The centred random walk adds variance to the modes of the statistic; its distribution is
    matched by a scaled chi-square (Satterthwaite), whose median is set to the threshold.
    """
    if n < 3 or not sigma_nm > 0 or not interval_s > 0:
        return math.inf
    threshold = chi2_quantile(1 - alpha, 2 * (n - 1))
    modes = [1.0 / (4.0 * math.sin(math.pi * k / (2 * n)) ** 2) for k in range(1, n)]

    def below(r: float) -> bool:
        lam = [1 + r * m for m in modes]
        s1, s2 = 2 * sum(lam), 2 * sum(v * v for v in lam)
        return s2 / s1 * chi2_quantile(0.5, s1 * s1 / s2) < threshold

    high = 1.0
    while below(high):
        high *= 4
    return _solve(below, 0.0, high) * sigma_nm**2 / (2 * interval_s)
