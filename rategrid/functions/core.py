"""Column expressions shared by operators and queries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

US_PER_DAY = 86_400_000_000


def fixed(x: Column, digits: int = 6) -> Column:
    """``x`` to a number of decimals; halves go up, as in ``floor(x * 10^d + 0.5) / 10^d``."""
    scale = float(10**digits)
    scaled = x.cast("double") * scale + F.lit(0.5)
    # floor gives a long: infinities, NaN and doubles without a fraction stay as they are
    return F.when(F.abs(scaled) < float(2**53), F.floor(scaled).cast("double")).otherwise(scaled) / F.lit(scale)


def ln(x: Column) -> Column:
    """The natural logarithm, minus infinity at 0, where Spark's has null."""
    return F.when(x == 0, F.lit(float("-inf"))).otherwise(F.log(x))


def ratio(a: Column, b: Column) -> Column:
    """``a / b`` as doubles divide: over 0 an infinity, or NaN for 0 over 0, where Spark's raises."""
    a, b = a.cast("double"), b.cast("double")
    over_0 = F.when(F.isnan(a) | (a == 0), F.lit(float("nan"))).when(a > 0, F.lit(float("inf"))).when(a < 0, F.lit(float("-inf")))
    return F.when(b == 0, over_0).otherwise(a / F.nullif(b, F.lit(0.0)))


def micros_since(ts: Column, start: str) -> Column:
    """Whole microseconds from ``start`` (a timestamp without zone) to ``ts``."""
    return F.timestamp_diff("MICROSECOND", F.lit(start).cast("timestamp_ntz"), ts)


def decimal_year(ts: Column) -> Column:
    year = F.trunc(ts, "year")
    return F.year(ts) + F.datediff(ts, year) / F.datediff(F.add_months(year, 12), year)


def moment_magnitude(kind: Column, mag: Column) -> Column:
    """Magnitudes on one scale, from the scale they were reported on.

    Surface-wave magnitudes strictly between 5.4 and 5.5 fall between the two regimes and give null.
    """
    k = F.lower(F.trim(kind))
    # fixed values: published linear relations
    return (
        F.when(k == "mw", mag)
        .when(k == "md", 0.7947 * mag + 1.3420)
        .when((k == "ms") & (mag <= 5.4), 0.5716 * mag + 2.4980)
        .when((k == "ms") & (mag >= 5.5), 0.8126 * mag + 1.1723)
        .when(k == "ms", F.lit(None).cast("double"))
        .when(k == "mb", 1.0319 * mag + 0.0223)
        .otherwise(0.8095 * mag + 1.3003)  # local magnitude, and anything unknown
    )


def productivity(mag: Column, k: float, alpha: float, mc: float) -> Column:
    return k * F.exp(alpha * (mag - mc))


def omori_density(t: Column, c: float, p: float) -> Column:
    """Density of waiting times, normalised over all t > 0."""
    return (p - 1) * c ** (p - 1) * F.pow(t + c, F.lit(-p))


def omori_cumulative(t: Column, c: float, p: float) -> Column:
    return 1 - F.pow(1 + t / c, F.lit(1 - p))


def spatial_density(r2: Column, d: float, q: float) -> Column:
    return (q - 1) / 3.141592653589793 * d ** (2 * (q - 1)) * F.pow(r2 + d * d, F.lit(-q))


def at_least_one(rate: Column) -> Column:
    """Probability of one or more events at a Poisson rate."""
    return -F.expm1(-rate)


def rate_of(p: Column) -> Column:
    """The Poisson rate of a probability below 1."""
    return -F.log1p(-F.least(F.greatest(p, F.lit(0.0)), F.lit(1 - 1e-9)))


def rescaled(rate: Column, b: float, dm: float) -> Column:
    """A rate above another threshold, by the Gutenberg-Richter slope."""
    return rate * 10 ** (-b * dm)


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of Wilson's interval; null where n is 0."""
    n = F.nullif(n.cast("double"), F.lit(0.0))
    p, z2 = hits / n, z * z
    middle = (p + z2 / (2 * n)) / (1 + z2 / n)
    half = z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n)
    return middle - half, middle + half


def bounds_below(bounds: Column, x: Column, most: int) -> Column:
    """How many of the sorted array ``bounds`` (of at most ``most``) are not above ``x``, by binary search."""
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(max(1, most.bit_length())))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(bounds, at + step - 1) <= x, at + step).otherwise(at))
