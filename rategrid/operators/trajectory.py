"""Trajectories of station series by least squares, as they stood at every cutoff.

A series is fitted by an offset, a trend, steps and yearly and half-yearly waves.  The normal equations are sums: they are added up by station and
block of time once, and running sums over a station's blocks give the equations of every cutoff.  So a cutoff costs one row, not another
pass over the series, and a fit sees nothing from its cutoff on.  The equations are solved as arrays by elimination, symmetric as in Cholesky's
method.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A pivot below this share of its column's sum of squares means that the column depends on those before; its coefficient is 0.
DEPENDENT = 1e-9
WAVES = ("sin1", "cos1", "sin2", "cos2")


def design(t: Column, year: float, steps: tuple[Column, ...] = ()) -> list[Column]:
    """The columns of the fit: 1, t, one for each step (0 before, 1 from it on), and the waves; ``year`` is its length in units of t."""
    turn = 2 * math.pi / year
    waves = [F.sin(turn * t), F.cos(turn * t), F.sin(2 * turn * t), F.cos(2 * turn * t)]
    return [F.lit(1.0), t.cast("double"), *[s.cast("double") for s in steps], *waves]


def names(steps: int = 1) -> list[str]:
    return ["offset", "trend", *[f"step{i}" for i in range(steps)], *WAVES]


def solve(matrix: Column, m: int) -> Column:
    """The solution of the m x m equations in an array of rows of m + 1 (the right-hand side last), by elimination on the diagonal."""
    w = m + 1
    at = lambda a, i, j: F.get(a, i * w + j)
    state = F.struct(matrix.alias("a"), F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda i: at(matrix, i, i)).alias("whole"))

    def eliminate(s, k):
        a = s["a"]
        pivot = at(a, k, k)
        fine = F.abs(pivot) > DEPENDENT * F.greatest(F.abs(F.get(s["whole"], k)), F.lit(1e-300))

        def cell(x, n):
            i, j = F.floor(n / w).cast("int"), n % w
            reduced = F.when(i == k, x / pivot).otherwise(x - at(a, i, k) * at(a, k, j) / pivot)
            dropped = F.when((i == k) | (j == k), 0.0).otherwise(x)
            return F.when(fine, reduced).otherwise(dropped)

        return F.struct(F.transform(a, cell).alias("a"), s["whole"].alias("whole"))

    done = F.aggregate(F.sequence(F.lit(0), F.lit(m - 1)), state, eliminate, lambda s: s["a"])
    return F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda i: at(done, i, m))


def fits(series: DataFrame, station: str, block: Column, columns: list[Column], value: Column, least: int) -> DataFrame:
    """station, cutoff, n, c: for each block that a station has, the coefficients (an array) of the fit to all rows in blocks before ``cutoff``, the
    block after it; null with fewer than ``least`` rows."""
    m = len(columns)
    rows = series.select(station, block.alias("_b"), *[c.alias(f"_x{i}") for i, c in enumerate(columns)], value.cast("double").alias(f"_x{m}"))
    pairs = [(i, j) for i in range(m) for j in range(i, m + 1)]
    sums = rows.groupBy(station, "_b").agg(F.count("*").alias("n"), *[F.sum(F.col(f"_x{i}") * F.col(f"_x{j}")).alias(f"_s{i}_{j}") for i, j in pairs])
    so_far = Window.partitionBy(station).orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a row for each block
    running = sums.select(station, (F.col("_b") + 1).alias("cutoff"), F.sum("n").over(so_far).alias("n"), *[F.sum(f"_s{i}_{j}").over(so_far).alias(f"_s{i}_{j}") for i, j in pairs])
    matrix = F.array(*[F.col(f"_s{min(i, j)}_{max(i, j)}") if j < m else F.col(f"_s{i}_{m}") for i in range(m) for j in range(m + 1)])
    return running.select(station, "cutoff", "n", F.when(F.col("n") >= least, solve(matrix, m)).alias("c"))


def residuals(series: DataFrame, found: DataFrame, station: str, block: Column, columns: list[Column], value: Column) -> DataFrame:
    """``series`` with residual: the value less what the fit that stood at the row's own block says, which has seen only earlier blocks."""
    joined = series.withColumn("_b", block).alias("s").join(found.select(F.col(station).alias("_st"), "cutoff", "c").alias("f"), (F.col(f"s.{station}") == F.col("_st")) & (F.col("s._b") == F.col("cutoff")), "left")
    said = sum((F.get("c", F.lit(i)) * x for i, x in enumerate(columns)), F.lit(0.0))
    return joined.withColumn("residual", value - said).drop("_b", "_st", "cutoff", "c")
