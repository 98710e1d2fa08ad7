"""Cells, windows and neighbourhoods."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Lattice:
    rows: int
    cols: int
    low_row: float = 0.0
    low_col: float = 0.0
    step: float = 1.0

    def index(self, row_value: Column, col_value: Column) -> tuple[Column, Column]:
        """Row and column of a point; -1 outside."""
        def one(x, low, n):
            k = F.floor((x - low) / self.step)
            return F.when((k >= 0) & (k < n), k).otherwise(-1).cast("int")

        return one(row_value, self.low_row, self.rows), one(col_value, self.low_col, self.cols)

    def cells(self, spark: SparkSession) -> DataFrame:
        """ir, ic of every cell."""
        n = spark.range(self.rows * self.cols)
        return n.select(F.floor(F.col("id") / self.cols).cast("int").alias("ir"), (F.col("id") % self.cols).cast("int").alias("ic"))

    def neighbours(self, df: DataFrame, radius: int) -> DataFrame:
        """``df`` (ir, ic and more) copied to every cell within ``radius`` rows and columns, in place of its own."""
        offsets = F.explode(F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a in range(-radius, radius + 1) for b in range(-radius, radius + 1)]))
        moved = df.withColumn("_o", offsets).withColumn("ir", F.col("ir") + F.col("_o.dr")).withColumn("ic", F.col("ic") + F.col("_o.dc")).drop("_o")
        return moved.filter(F.col("ir").between(0, self.rows - 1) & F.col("ic").between(0, self.cols - 1))


def windows(spark: SparkSession, first: int, last: int) -> DataFrame:
    """window numbers from first to last."""
    return spark.range(first, last + 1).select(F.col("id").cast("int").alias("window"))
