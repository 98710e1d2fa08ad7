"""Scores of probability forecasts.  Inputs hold y (0 or 1), p, and group columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rategrid.functions.core import ln, ratio
from rategrid.operators.quantiles import all_equal, bucketed
from rategrid.sources.shared import materialize

EPS = 1e-9


def information_gain(p: Column, base: Column, y: Column) -> Column:
    """Gain per positive of rates ``p`` over ``base``, Poisson likelihood of 0/1 outcomes."""
    a, b = F.greatest(p, F.lit(EPS)), F.greatest(base, F.lit(EPS))
    return F.sum(y * (F.log(a) - F.log(b)) - (a - b)) / F.greatest(F.sum(y), F.lit(1)).cast("double")


def bernoulli_gain(p: Column, base: Column, y: Column, eps: float = EPS) -> Column:
    """The same under the Bernoulli likelihood.  With ``eps`` of 0 probabilities of 0 and 1 count as they are, and the gain may be infinite or NaN."""
    a, b = (F.least(F.greatest(x, F.lit(eps)), F.lit(1 - eps)) for x in (p, base))
    return F.sum(y * (ln(a) - ln(b)) + (1 - y) * (ln(1 - a) - ln(1 - b))) / F.greatest(F.sum(y), F.lit(1)).cast("double")


def ranked(df: DataFrame, by: list[str]) -> DataFrame:
    """Positives and rows of each distinct score, with running sums from the highest score on.

    Rows with one score are first summed, so ties count together.  Each group's scores are cut into buckets at the boundaries that a sketch
    gives; sums of buckets are added up from the highest on, and within a bucket a window adds the rest.
    """
    tied = materialize(df.groupBy(*by, "p").agg(F.sum("y").cast("double").alias("pos"), F.count("*").cast("double").alias("n")), "scores")
    cut = bucketed(tied, by, "p", "_k")
    sums = cut.groupBy(*by, "_k").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n"))
    above = Window.partitionBy(*by).orderBy(F.desc("_k")).rowsBetween(Window.unboundedPreceding, -1)  # a row for each bucket
    so_far = sums.select(*by, "_k", *[F.coalesce(F.sum(c).over(above), F.lit(0.0)).alias(f"_{c}") for c in ("pos", "n")])
    down = Window.partitionBy(*by, "_k").orderBy(F.desc("p")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = cut.alias("c").join(so_far.alias("s"), all_equal("c", "s", [*by, "_k"])).select("c.*", "s._pos", "s._n")
    return joined.withColumn("tp", F.col("_pos") + F.sum("pos").over(down)).withColumn("seen", F.col("_n") + F.sum("n").over(down)).drop("_k", "_pos", "_n")


def ranking(df: DataFrame, by: list[str], plain: bool = False) -> DataFrame:
    """average_precision, roc_auc and molchan (1 - 2 * area) of each group; null without both classes, or, if ``plain``, what their quotients give."""
    r = ranked(df, by)
    neg = F.col("n") - F.col("pos")
    sums = r.groupBy(*by).agg(
        F.sum(F.col("pos") * F.col("tp") / F.col("seen")).alias("ap"),
        F.sum(neg * (F.col("tp") - F.col("pos") / 2)).alias("above"),
        F.sum(F.col("n") * (F.col("tp") - F.col("pos") / 2)).alias("caught"),
        F.sum("pos").alias("pos"),
        F.sum("n").alias("n"),
    )
    some = F.lit(plain) | ((F.col("pos") > 0) & (F.col("pos") < F.col("n")))
    return sums.select(
        *by,
        F.when(some, ratio(F.col("ap"), F.col("pos"))).alias("average_precision"),
        F.when(some, ratio(F.col("above"), F.col("pos") * (F.col("n") - F.col("pos")))).alias("roc_auc"),
        F.when(some, ratio(2 * F.col("caught"), F.col("pos") * F.col("n")) - 1).alias("molchan"),
    )


def alert_budget(df: DataFrame, by: list[str], ties: list[str], share: float, cells: int) -> DataFrame:
    """precision and recall when in each group the ``ceil(share * cells)`` rows with the highest p are alarmed."""
    k = -int(-share * cells // 1)
    top = Window.partitionBy(*by).orderBy(F.desc("p"), *ties)
    marked = df.withColumn("alarm", (F.row_number().over(top) <= k).cast("int"))
    hits = F.sum(F.col("alarm") * F.col("y")).cast("double")
    return marked.agg(
        F.sum("alarm").cast("long").alias("alarms"),
        (hits / F.nullif(F.sum("alarm").cast("double"), F.lit(0.0))).alias("precision"),
        (hits / F.nullif(F.sum("y").cast("double"), F.lit(0.0))).alias("recall"),
    )
