"""Magnitude slopes by positive steps, around every cell and over trailing windows.

The steps around a cell are those between successive events of all cells near it, so they can't be summed by cell before.  The lattice is
cut into square tiles, and time into blocks.  An event goes to the tiles that have a cell near it, at most four of them where a tile is at
least twice as wide as the reach.  What a block has around a cell is its first and last magnitude with the number and sum of its positive
steps; successive blocks add up with the step between them.  So a tile's block is the most that one group holds, whatever a cell's share of all
events, and windows are sums over days.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rategrid.operators.lattice import Lattice

PART = "first double, last double, k long, s double"


def _tiled(events: DataFrame, grid: Lattice, reach: int, tile: int) -> DataFrame:
    """Events with ``_tr``, ``_tc``: copies for each tile that has a cell within ``reach``."""
    both = lambda c, n: F.array_distinct(F.array(*[F.floor(F.greatest(F.lit(0), F.least(F.lit(n - 1), F.col(c) + d)) / tile).cast("int") for d in (-reach, reach)]))
    return events.withColumn("_tr", F.explode(both("ir", grid.rows))).withColumn("_tc", F.explode(both("ic", grid.cols)))


def around_cells(events: DataFrame, grid: Lattice, reach: int, block: int, least: float) -> DataFrame:
    """ir, ic, _b, first, last, k, s: of the events within ``reach`` rows and columns of a cell in a block of time, the first and last magnitude
    and the number and sum of the steps of at least ``least``.  ``events`` holds ir, ic, t_us, id and mag."""
    tile = 2 * reach + 1

    def kernel(key, table):
        tr, tc, b = (x.as_py() for x in key)
        table = table.sort_by([("t_us", "ascending"), ("id", "ascending")])
        r, c, mag = (table[n].to_numpy() for n in ("ir", "ic", "mag"))
        out = []
        for i in range(tr * tile, min((tr + 1) * tile, grid.rows)):
            near = np.abs(r - i) <= reach
            rows, columns = mag[near], c[near]
            for j in range(tc * tile, min((tc + 1) * tile, grid.cols)):
                own = rows[np.abs(columns - j) <= reach]
                if len(own):
                    up = np.diff(own)
                    up = up[up >= least]
                    out.append((i, j, b, own[0], own[-1], len(up), up.sum()))
        columns = list(zip(*out)) or [[]] * 7
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.float64()]
        return pa.Table.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds)], ["ir", "ic", "_b", "first", "last", "k", "s"])

    slim = events.select("ir", "ic", "t_us", "id", "mag", F.floor(F.col("t_us") / block).alias("_b"))
    return _tiled(slim, grid, reach, tile).groupBy("_tr", "_tc", "_b").applyInArrow(kernel, f"ir int, ic int, _b long, {PART}")


def over_all(events: DataFrame, block: int, least: float) -> DataFrame:
    """_b, first, last, k, s: the same of all events."""
    slim = events.select("t_us", "id", "mag", F.floor(F.col("t_us") / block).alias("_b"))
    step = F.col("mag") - F.lag("mag").over(Window.partitionBy("_b").orderBy("t_us", "id"))
    up = F.when(step >= least, step)
    at = F.struct("t_us", "id")
    return slim.withColumn("up", up).groupBy("_b").agg(F.min_by("mag", at).alias("first"), F.max_by("mag", at).alias("last"), F.count("up").alias("k"), F.coalesce(F.sum("up"), F.lit(0.0)).alias("s"))


def slope_of_all(events: DataFrame, block: int, least: float, enough: int = 30) -> DataFrame:
    """One row: b of all events, null with fewer than ``enough`` positive steps."""
    parts = over_all(events, block, least)
    jump = F.col("first") - F.lag("last").over(Window.orderBy("_b"))  # a row for each block
    sums = parts.withColumn("j", F.when(jump >= least, jump)).agg((F.coalesce(F.sum("k"), F.lit(0)) + F.count("j")).alias("k"), (F.coalesce(F.sum("s"), F.lit(0.0)) + F.coalesce(F.sum("j"), F.lit(0.0))).alias("s"))
    return sums.select(F.when(F.col("k") >= enough, 1 / (F.log(F.lit(10.0)) * (F.col("s") / F.col("k") - least))).alias("b"))


def trailing(parts: DataFrame, frame: DataFrame, by: list[str], days: int, blocks_a_day: int, least: float, enough: int = 30) -> DataFrame:
    """``by``, window, b for every row of ``frame`` (``by``, window: every day): the slope of the ``days`` days before the window, null with
    fewer than ``enough`` positive steps.  A step counts if both its events are in these days."""
    jump = F.col("first") - F.lag("last").over(Window.partitionBy(*by).orderBy("_b"))
    edge = F.when(jump >= least, F.struct(F.lit(1).cast("long").alias("k"), jump.alias("s"))).otherwise(F.struct(F.lit(0).cast("long").alias("k"), F.lit(0.0).alias("s")))
    day = parts.withColumn("edge", edge).groupBy(*by, F.floor(F.col("_b") / blocks_a_day).cast("int").alias("window"))
    day = day.agg(F.sum(F.col("k") + F.col("edge.k")).alias("k"), F.sum(F.col("s") + F.col("edge.s")).alias("s"), F.min_by("edge", "_b").alias("edge"))
    back = Window.partitionBy(*by).orderBy("window").rowsBetween(-days, -1)
    into = F.first("edge", ignorenulls=True).over(back)  # the step from before the first event of these days
    sums = frame.join(day, [*by, "window"], "left").select(*by, "window", (F.sum("k").over(back) - into["k"]).alias("k"), (F.sum("s").over(back) - into["s"]).alias("s"))
    return sums.select(*by, "window", F.when(F.col("k") >= enough, 1 / (F.log(F.lit(10.0)) * (F.col("s") / F.col("k") - least))).alias("b"))


def neighbourhood(events: DataFrame, grid: Lattice, frame: DataFrame, days: int, reach: int = 4, least: float = 0.1, block: int = 21_600_000_000) -> DataFrame:
    """window, ir, ic, b, fallback for every row of ``frame`` (window, ir, ic: every day): the slope around the cell; where there are too few steps
    that of all cells, else 1."""
    a_day = 86_400_000_000 // block
    own = trailing(around_cells(events, grid, reach, block, least), frame, ["ir", "ic"], days, a_day, least)
    every = trailing(over_all(events, block, least), frame.select("window").distinct(), [], days, a_day, least).select("window", F.col("b").alias("all"))
    return own.join(every, "window").select("window", "ir", "ic", F.coalesce("b", "all", F.lit(1.0)).alias("b"), F.col("b").isNull().alias("fallback"))
