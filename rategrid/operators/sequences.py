"""Neighbours in time within groups that may hold a large share of all events.

Windows over a whole group would put it into one task.  Time is cut into days: a window sees one group's day, and what a day's first rows
need from before comes from a table with one row for each group and day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def before_day(events: DataFrame, by: list[str], value: str) -> DataFrame:
    """``by``, win, before: the last ``value`` of the days before each day that has events."""
    ends = events.groupBy(*by, "win").agg(F.max_by(value, F.struct("t_us", "id")).alias("end"))
    return ends.select(*by, "win", F.lag("end").over(Window.partitionBy(*by).orderBy("win")).alias("before"))


def steps(events: DataFrame, value: str, by: list[str]) -> DataFrame:
    """``events`` with step: ``value`` less that of the event before in its group, in order of time and id."""
    inside = Window.partitionBy(*by, "win").orderBy("t_us", "id")
    joined = events.join(before_day(events, by, value), [*by, "win"])
    return joined.withColumn("step", F.col(value) - F.coalesce(F.lag(value).over(inside), F.col("before"))).drop("before")


def trailing_count(events: DataFrame, by: list[str], reach: int, block: int) -> DataFrame:
    """``events`` with n: how many events of the group lie in the ``reach`` microseconds before, strictly.

    Blocks of ``block`` (at least ``reach``) microseconds are counted apart, each with the end of the block before.
    """
    own = events.withColumn("_b", F.floor(F.col("t_us") / block)).withColumn("_e", F.lit(1))
    edge = own.filter(F.col("t_us") >= (F.col("_b") + 1) * block - reach).withColumn("_b", F.col("_b") + 1).withColumn("_e", F.lit(0))
    w = Window.partitionBy(*by, "_b").orderBy("t_us").rangeBetween(-reach, -1)
    return own.unionByName(edge).withColumn("n", F.count("*").over(w)).filter("_e = 1").drop("_b", "_e")
