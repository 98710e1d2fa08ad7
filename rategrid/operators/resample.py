"""Stationary block bootstrap over windows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rategrid.operators.quantiles import bucketed
from rategrid.sources.shared import materialize


def digits(key: Column, first: int, n: int) -> Column:
    """``n`` hexadecimal digits of a key's md5, from the ``first`` on, as a number."""
    return F.conv(F.substring(F.md5(key.cast("binary")), first, n), 16, 10).cast("long")


def stationary(spark: SparkSession, units: int, draws: int, block: int = 3) -> DataFrame:
    """draw, place: which of ``units`` consecutive units a draw takes, with repeats.

    Blocks begin with a probability of 1 / block and run around the end.  The choice follows from hashes of draw and position, so reruns and
    lost executors give the same plan.  One plan serves all forecasts, which keeps their comparison paired.
    """
    grid = spark.range(draws * units).select(F.floor(F.col("id") / units).alias("draw"), (F.col("id") % units).alias("pos"))
    key = F.concat_ws("-", "draw", "pos")
    begins = (F.col("pos") == 0) | (digits(key, 1, 8) % block == 0)
    here = F.when(begins, F.struct("pos", (digits(key, 9, 8) % units).alias("start")))
    so_far = Window.partitionBy("draw").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.last(here, ignorenulls=True).over(so_far)
    return grid.withColumn("_s", last).select("draw", ((F.col("_s.start") + F.col("pos") - F.col("_s.pos")) % units).alias("place"))


def multiplicities(plan: DataFrame, units: int, first: int, draws: int) -> np.ndarray:
    """How often each draw takes each unit (draws, units), from the rows (draw, window) of a plan: a table of a bounded size."""
    out = np.zeros((draws, units))
    for draw, window, m in plan.groupBy("draw", "window").agg(F.count("*").alias("m")).collect():
        out[draw, window - first] = m
    return out


def ranked_draws(df: DataFrame, plan: np.ndarray, first: int) -> DataFrame:
    """model, draw, pr and roc: average precision and the area under the ROC curve of each model in each draw, ties together.  ``df`` holds
    model, window, p and y; ``plan`` is from ``multiplicities``.  A draw of one class has no row.

    Rows are never copied for the draws.  Positives and rows of a distinct score are kept by window, and so are their running sums; what a
    draw makes of them is a product with its multiplicities.  Scores come in buckets, each with the sums of all higher ones.
    """
    draws, units = plan.shape
    weights = plan.T.copy()
    tied = materialize(df.groupBy("model", "p", "window").agg(F.sum("y").cast("double").alias("pos"), F.count("*").cast("double").alias("n")), "tied")
    cut = bucketed(tied, ["model"], "p", "_k")
    sums = cut.groupBy("model", "_k", "window").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n"))
    keys = sums.select("model", "_k").distinct().withColumn("window", F.explode(F.sequence(F.lit(first), F.lit(first + units - 1))))
    above = Window.partitionBy("model", "window").orderBy(F.desc("_k")).rowsBetween(Window.unboundedPreceding, -1)  # a row for each bucket
    offsets = keys.join(sums, ["model", "_k", "window"], "left").select("model", "_k", "window", *[F.coalesce(F.sum(c).over(above), F.lit(0.0)).alias(c) for c in ("pos", "n")])
    offsets = materialize(offsets, "offsets")

    def dense(table, at, size):
        x = np.zeros((2, size, units))
        np.add.at(x, (0, at, table["window"].to_numpy() - first), table["pos"].to_numpy())
        np.add.at(x, (1, at, table["window"].to_numpy() - first), table["n"].to_numpy())
        return x

    def kernel(key, rows, higher):
        p = rows["p"].to_numpy()
        distinct, at = np.unique(-p, return_inverse=True)
        total = np.zeros((4, draws))
        before = dense(higher, np.zeros(len(higher), int), 1)[:, 0]
        order = np.argsort(at, kind="stable")
        rows, at = rows.take(order), at[order]
        for start in range(0, len(distinct), 512):
            lo, hi = np.searchsorted(at, [start, start + 512])
            own = dense(rows.slice(lo, hi - lo), at[lo:hi] - start, min(512, len(distinct) - start))
            so_far = before[:, None] + own.cumsum(axis=1)
            before = so_far[:, -1]
            pos, n, tp, seen = own[0] @ weights, own[1] @ weights, so_far[0] @ weights, so_far[1] @ weights
            total += [(pos * tp / np.maximum(seen, 1)).sum(axis=0), ((n - pos) * (tp - pos / 2)).sum(axis=0), pos.sum(axis=0), n.sum(axis=0)]
        model = pa.array([key[0].as_py()] * draws, rows.schema.field("model").type)
        return pa.Table.from_arrays([model, pa.array(np.arange(draws)), *map(pa.array, total)], ["model", "draw", "ap", "above", "pos", "n"])

    parts = cut.groupBy("model", "_k").cogroup(offsets.groupBy("model", "_k")).applyInArrow(kernel, f"model {dict(df.dtypes)['model']}, draw long, ap double, above double, pos double, n double")
    s = parts.groupBy("model", "draw").agg(*[F.sum(c).alias(c) for c in ("ap", "above", "pos", "n")]).filter((F.col("pos") > 0) & (F.col("pos") < F.col("n")))
    return s.select("model", "draw", (F.col("ap") / F.col("pos")).alias("pr"), (F.col("above") / (F.col("pos") * (F.col("n") - F.col("pos")))).alias("roc"))
