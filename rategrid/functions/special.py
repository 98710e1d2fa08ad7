"""Special functions as column expressions: log-gamma, incomplete gamma and beta, and Clopper-Pearson bounds."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Stirling's series: B(2k) / (2k (2k - 1)) for k from 1 on (fixed values).
_STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360, 1 / 156)
_SHIFT = 8


def log_gamma(x: Column) -> Column:
    """ln Gamma(x) for x > 0: Stirling's series ``_SHIFT`` places up, and back down by the recurrence."""
    z = x + float(_SHIFT)
    series = sum((c / F.pow(z, F.lit(2.0 * k + 1)) for k, c in enumerate(_STIRLING)), F.lit(0.0))
    product = x
    for i in range(1, _SHIFT):
        product = product * (x + float(i))
    return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + series - F.log(product)


def _down(n: int) -> Column:
    return F.sequence(F.lit(n), F.lit(1), F.lit(-1))


def upper_gamma(s: float, x: Column, terms: int = 160) -> Column:
    """The upper incomplete gamma function of x > 0 at a fixed ``s`` > -2, which may be negative: from x = 1 on Legendre's continued fraction, below
    the series of the lower function, and for s <= 0 the recurrence from s + 1."""
    if s <= -2:
        raise ValueError("s must be above -2")
    fraction = F.aggregate(_down(terms), x + (2 * terms + 1 - s), lambda f, n: x + 2.0 * (n - 1) + 1 - s - n * (n - s) / f)
    return F.when(x >= 1, F.exp(-x) * F.pow(x, F.lit(s)) / fraction).otherwise(_upper_gamma_small(s, x, 40))


def _upper_gamma_small(s: float, x: Column, terms: int) -> Column:
    if s == 0:  # the exponential integral
        state = F.struct(F.lit(1.0).alias("power"), F.lit(0.0).alias("total"))

        def add(a, n):
            power = a["power"] * (-x) / n
            return F.struct(power.alias("power"), (a["total"] + power / n).alias("total"))

        return -0.57721566490153286 - F.log(x) - F.aggregate(F.sequence(F.lit(1), F.lit(terms)), state, add, lambda a: a["total"])
    if s < 0:
        return (_upper_gamma_small(s + 1, x, terms) - F.pow(x, F.lit(s)) * F.exp(-x)) / s
    # gamma(s, x) = x^s e^-x (1 / s) (1 + x / (s + 1) (1 + x / (s + 2) (1 + ...)))
    nested = F.aggregate(_down(terms), F.lit(1.0), lambda f, n: 1 + x / (s + n) * f)
    return math.gamma(s) - F.pow(x, F.lit(s)) * F.exp(-x) / s * nested


def tapered_omori(t1: Column, t2: Column, c: float, omega: float, tau: float) -> Column:
    """The integral of e^(-t / tau) (t + c)^-(1 + omega) from ``t1`` to ``t2``."""
    at = lambda t: upper_gamma(-omega, (t + c) / tau)
    return math.exp(c / tau) * tau**-omega * (at(t1) - at(t2))


def regular_beta(x: Column, a: Column, b: Column, terms: int = 240) -> Column:
    """The regularised incomplete beta function for x in [0, 1] and a, b > 0, by its continued fraction on the side where that converges soon.

    ``terms`` must grow with the root of a and b: 240 are enough up to 10,000.
    """

    def side(x, a, b):
        front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.log(x) + b * F.log1p(-x)) / a

        def term(f, j):
            m = F.floor(j / 2).cast("double")
            even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
            odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
            return 1 + F.when(j % 2 == 0, even).otherwise(odd) / f

        return front / F.aggregate(_down(terms), F.lit(1.0), term)

    inner = F.when(x < (a + 1) / (a + b + 2), side(x, a, b)).otherwise(1 - side(1 - x, b, a))
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).otherwise(inner)


def beta_quantile(share: Column, a: Column, b: Column, steps: int = 44, terms: int = 240) -> Column:
    """Where the regularised incomplete beta function is ``share``, by bisection."""
    start = F.struct(F.lit(0.0).alias("low"), F.lit(1.0).alias("high"))

    def halve(s, _):
        middle = (s["low"] + s["high"]) / 2
        below = regular_beta(middle, a, b, terms) < share
        return F.struct(F.when(below, middle).otherwise(s["low"]).alias("low"), F.when(below, s["high"]).otherwise(middle).alias("high"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve, lambda s: (s["low"] + s["high"]) / 2)


def clopper_pearson(hits: Column, n: Column, level: float = 0.95) -> tuple[Column, Column]:
    """The exact interval of a share; null where n is 0."""
    k, n, tail = hits.cast("double"), F.nullif(n.cast("double"), F.lit(0.0)), (1 - level) / 2
    low = F.when(n.isNull(), None).when(k <= 0, 0.0).otherwise(beta_quantile(F.lit(tail), F.greatest(k, F.lit(0.5)), n - k + 1))
    high = F.when(n.isNull(), None).when(k >= n, 1.0).otherwise(beta_quantile(F.lit(1 - tail), k + 1, F.greatest(n - k, F.lit(0.5))))
    return low, high
