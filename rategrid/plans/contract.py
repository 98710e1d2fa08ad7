"""The contract by which other sources add features to the cube."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rategrid.operators import slopes
from rategrid.operators.features import dense
from rategrid.plans.base import DAYS, GRID, US_PER_DAY, events
from rategrid.sources import tables


class FeatureSource(ABC):
    """A named source of columns keyed by window and cell.

    ``add_columns`` keeps every row of the table it gets and adds ``columns``; where the source has nothing, 0.  It may look only at what
    lies before a window; ``truncated`` computes the same from events before a day, which must not change the windows up to then.
    """

    name: str
    columns: tuple[str, ...]
    needs: tuple[str, tuple[str, ...]]  # table and columns that must be there

    def available(self, spark: SparkSession, sf: str) -> tuple[bool, str]:
        return tables.available(spark, f"{sf}/{self.needs[0]}.parquet", self.needs[1])

    @abstractmethod
    def compute(self, e: DataFrame) -> DataFrame:
        """window, ir, ic and ``columns`` from events."""

    def add_columns(self, cells: DataFrame, spark: SparkSession, sf: str) -> DataFrame:
        return self._joined(cells, self.compute(events(spark, sf)))

    def truncated(self, cells: DataFrame, spark: SparkSession, sf: str, day: float) -> DataFrame:
        """``day`` may lie within one: the windows up to it must not change either."""
        return self._joined(cells, self.compute(events(spark, sf).filter(F.col("t_us") < int(day * US_PER_DAY))))

    def _joined(self, cells: DataFrame, found: DataFrame) -> DataFrame:
        out = cells.join(found, ["window", "ir", "ic"], "left")
        return out.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in self.columns})


class WeekBefore(FeatureSource):
    """An aggregate of a value over the week before, in a neighbourhood."""

    def __init__(self, name: str, value: Callable, needs=("events", ("event_id", "ts", "value")), radius: int = 1):
        self.name, self.columns, self.needs, self.value, self.radius = name, (name,), needs, value, radius

    def compute(self, e: DataFrame) -> DataFrame:
        ahead = e.withColumn("window", F.explode(F.sequence(F.col("win") + 1, F.col("win") + 7)))
        own = ahead.groupBy("window", "ir", "ic").agg(self.value().alias("s"))
        return GRID.neighbours(own, self.radius).groupBy("window", "ir", "ic").agg(F.sum("s").alias(self.name))


class DenseCatalog(FeatureSource):
    """Counts and slopes from a catalog that is complete to a lower magnitude: of the day and the week before, and of the 9 x 9 cells around."""

    name = "dense_catalog"
    columns = ("dense_cnt1", "dense_cnt7", "dense_b")
    needs = ("events", ("event_id", "ts", "user_id", "value"))

    def __init__(self, mc: float = 1.5):
        self.mc = mc

    def compute(self, e: DataFrame) -> DataFrame:
        own = e.filter(F.col("mag") >= self.mc)
        every = dense(e.sparkSession, GRID, 0, DAYS - 1)
        day = own.groupBy("ir", "ic", F.col("win").alias("window")).agg(F.count("*").alias("n"))
        back = lambda d: Window.partitionBy("ir", "ic").orderBy("window").rowsBetween(-d, -1)
        counts = every.join(day, ["window", "ir", "ic"], "left").select("window", "ir", "ic", *[F.coalesce(F.sum("n").over(back(d)), F.lit(0)).alias(f"dense_cnt{d}") for d in (1, 7)])
        b = slopes.neighbourhood(own, GRID, every, 7).select("window", "ir", "ic", F.col("b").alias("dense_b"))
        return counts.join(b, ["window", "ir", "ic"])


#: Sources that are there and one that isn't; more can be appended.
FEATURES: list[FeatureSource] = [
    WeekBefore("purchases", lambda: F.count_if(F.col("mag_type") == "purchase")),
    WeekBefore("total_value", lambda: F.sum("value"), radius=2),
    DenseCatalog(),
    WeekBefore("stations_of_nobody", lambda: F.count("*"), needs=("stations", ("station",))),
]
