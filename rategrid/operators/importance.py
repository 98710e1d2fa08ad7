"""Permutation importance: what a forecast loses when some of its features are dealt anew among the rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rategrid.operators.quantiles import all_equal
from rategrid.operators.resample import digits
from rategrid.sources.shared import materialize


def _ranked(df: DataFrame, by: list[str], hashed: Column, ties: list[str], buckets: int) -> DataFrame:
    """``df`` with _rank, from 1, in order of ``hashed`` (below 2**32) within each group.  A group is cut into buckets of about equal size; a table
    with a row for each bucket has what comes before it."""
    cut = df.withColumn("_h", hashed).withColumn("_bucket", F.floor(F.col("_h") * buckets / float(2**32)).cast("int"))
    inside = F.row_number().over(Window.partitionBy(*by, "_bucket").orderBy("_h", *ties))
    if buckets == 1:
        return cut.withColumn("_rank", inside).drop("_h", "_bucket")
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = cut.groupBy(*by, "_bucket").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    joined = cut.alias("c").join(sizes.alias("s"), all_equal("c", "s", [*by, "_bucket"])).select("c.*", "s._before")
    return joined.withColumn("_rank", F.col("_before") + inside).drop("_h", "_bucket", "_before")


def permuted(df: DataFrame, by: list[str], key: list[str], columns: list[str], seed: str, buckets: int = 1) -> DataFrame:
    """``df`` with the values of ``columns``, together, of another row of its group ``by``.

    Rows are ranked by one hash of their ``key``, which is unique, and by another; a row gets the columns of that whose second rank is its
    first.  So it is a permutation, the same in every run, made by one join.  Groups larger than a task should hold take more ``buckets``.
    """
    hashed = lambda side: digits(F.concat_ws("-", F.lit(f"{seed}{side}"), *key), 1, 8)
    to = _ranked(df.drop(*columns), by, hashed("a"), key, buckets)
    source = _ranked(df.select(*by, *key, *columns), by, hashed("b"), key, buckets).drop(*[c for c in key if c not in by])
    joined = to.alias("t").join(source.alias("s"), all_equal("t", "s", [*by, "_rank"]))
    return joined.select(*[F.col(f"s.{c}" if c in columns else f"t.{c}").alias(c) for c in df.columns])


def importance(df: DataFrame, groups: dict[str, list[str]], predict: Callable[[], Column], score: Callable[[Column], Column], by: list[str], key: list[str], seed: str = "p", buckets: int = 1) -> DataFrame:
    """name, score, loss: the score of the forecast ``predict()`` as it is ('all'), and with each group of columns permuted within ``by``; the loss is
    what the score falls by.  Columns of a group move together, so what they share is not left in the others."""
    df = materialize(df, "importance")
    rows = df.agg(score(predict()).alias("score")).select(F.lit("all").alias("name"), "score")
    for name, columns in groups.items():
        rows = rows.unionByName(permuted(df, by, key, columns, f"{seed}-{name}", buckets).agg(score(predict()).alias("score")).select(F.lit(name).alias("name"), "score"))
    rows = materialize(rows, "losses")  # a row for each group of columns
    whole = rows.filter("name = 'all'").select(F.col("score").alias("_all"))
    return rows.crossJoin(F.broadcast(whole)).select("name", "score", (F.col("_all") - F.col("score")).alias("loss"))
