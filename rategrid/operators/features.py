"""The causal cell-by-window feature cube."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rategrid.operators.lattice import Lattice, windows

KEYS = ["window", "ir", "ic"]


def daily(events: DataFrame, mc: float, levels: tuple) -> DataFrame:
    """Counts, sums and maxima per cell and day: all that windows of whole days need."""
    return events.groupBy("ir", "ic", F.col("win").alias("window")).agg(
        F.count_if(F.col("mag") >= mc).alias("n"),
        F.max("mag").alias("top"),
        F.sum(F.when(F.col("mag") >= mc, F.col("value"))).alias("value"),
        *[F.max(F.when(F.col("mag") >= m, F.col("t_us"))).alias(f"last{k}") for k, m in enumerate(levels)],
    )


def dense(spark: SparkSession, grid: Lattice, first: int, last: int) -> DataFrame:
    """Every cell in every window."""
    return windows(spark, first, last).crossJoin(F.broadcast(grid.cells(spark)))


def box(df: DataFrame, radius: int, **exprs) -> DataFrame:
    """Adds aggregates over the cells within ``radius`` rows and columns, of a frame that holds every cell of each window.

    They are separable: along rows, then along columns, by window frames.  With the rows of a window together neither step moves them.
    """
    along = Window.partitionBy("window", "ir").orderBy("ic").rowsBetween(-radius, radius)
    across = Window.partitionBy("window", "ic").orderBy("ir").rowsBetween(-radius, radius)
    for name, (f, column) in exprs.items():
        df = df.withColumn(name, f(column).over(along))
    for name, (f, _) in exprs.items():
        df = df.withColumn(name, f(name).over(across))
    return df


def cube(spark: SparkSession, events: DataFrame, grid: Lattice, first: int, last: int, mc: float, target: float = 2.5, levels: tuple = (2.5, 3.2), cap: float = 30.0) -> DataFrame:
    """window, ir, ic, cnt<D> for D of 1, 3 and 7 days before the window, nbr3 and nbr5 sums of the shortest and longest, rate_ratio, maxmag
    (5 x 5, 7 days; 0 if none), days_since0 and days_since1 (5 x 5; since the last event of each level at any time before, at most ``cap``),
    mean_value (3 days; of the cell, else of all cells, else of all days before, else 10) and the target y.

    Events are summed by day and cell once.  The sums fill a dense frame of cells and days, in which histories and neighbourhoods are
    window frames: events are never copied to the windows or cells they reach.
    """
    day = daily(events, mc, levels)
    grown = dense(spark, grid, 0, last).join(day, KEYS, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    cell = Window.partitionBy("ir", "ic").orderBy("window")
    back = lambda d: cell.rowsBetween(-d, -1)
    before = cell.rowsBetween(Window.unboundedPreceding, -1)
    own = grown.select(
        *KEYS,
        *[F.coalesce(F.sum("n").over(back(d)), F.lit(0)).alias(f"cnt{d}") for d in (1, 3, 7)],
        F.max("top").over(back(7)).alias("top"),
        F.sum("value").over(back(3)).alias("value"),
        *[F.max(f"last{k}").over(before).alias(f"last{k}") for k in (0, 1)],
    ).filter(F.col("window") >= first)
    # of all cells: one row a window
    whole = day.groupBy("window").agg(F.sum("n").alias("n"), F.sum("value").alias("value"))
    every = Window.orderBy("window")
    whole = windows(spark, 0, last).join(whole, "window", "left").select(
        "window",
        (F.sum("value").over(every.rowsBetween(-3, -1)) / F.nullif(F.sum("n").over(every.rowsBetween(-3, -1)), F.lit(0))).alias("recent"),
        (F.sum("value").over(every.rowsBetween(Window.unboundedPreceding, -1)) / F.nullif(F.sum("n").over(every.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("ever"),
    )
    hit = events.filter(F.col("mag") >= target).groupBy(F.col("win").alias("window"), "ir", "ic").agg(F.lit(1).alias("y"))
    out = box(own.repartition("window"), 1, nbr3_cnt1=(F.sum, "cnt1"), nbr3_cnt7=(F.sum, "cnt7"))
    out = box(out, 2, nbr5_cnt1=(F.sum, "cnt1"), nbr5_cnt7=(F.sum, "cnt7"), maxmag=(F.max, "top"), near0=(F.max, "last0"), near1=(F.max, "last1"))
    out = out.join(hit, KEYS, "left").join(F.broadcast(whole), "window")
    since = lambda c: F.least(F.lit(cap), F.coalesce(F.col("window") - F.col(c) / 86_400_000_000, F.lit(cap)))
    return out.select(
        *KEYS,
        *[F.col(c).cast("long").alias(c) for c in ("cnt1", "cnt3", "cnt7", "nbr3_cnt1", "nbr3_cnt7", "nbr5_cnt1", "nbr5_cnt7")],
        (F.col("cnt1") / (F.col("cnt7") / 7.0 + 0.1)).alias("rate_ratio"),
        F.coalesce("maxmag", F.lit(0.0)).alias("maxmag"),
        since("near0").alias("days_since0"),
        since("near1").alias("days_since1"),
        F.coalesce(F.col("value") / F.nullif(F.col("cnt3"), F.lit(0)), "recent", "ever", F.lit(10.0)).alias("mean_value"),
        F.coalesce("y", F.lit(0)).cast("int").alias("y"),
    )
