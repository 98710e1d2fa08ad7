"""Isotonic regression."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pool(bins: DataFrame, at: str, total: str, weight: str) -> DataFrame:
    """``at``, q: the increasing function nearest in squares to ``total / weight``, by pooling adjacent violators.

    ``bins`` is a table of a bounded number of rows (a forecast is binned before), so one array holds it: each bin is put after the blocks so
    far, and the last two blocks are merged while their means fall.
    """
    rows = bins.agg(F.array_sort(F.collect_list(F.struct(F.col(at).alias("at"), F.col(total).cast("double").alias("s"), F.col(weight).cast("double").alias("w")))).alias("rows"))
    kind = "array<struct<first:bigint,last:bigint,s:double,w:double>>"
    block = lambda a, z, s, w: F.struct(a.alias("first"), z.alias("last"), s.alias("s"), w.alias("w"))

    def merged(blocks, _):
        last, before = F.element_at(blocks, -1), F.try_element_at(blocks, F.lit(-2))
        falls = (F.size(blocks) > 1) & (before["s"] / before["w"] >= last["s"] / last["w"])
        both = F.array(block(before["first"], last["last"], before["s"] + last["s"], before["w"] + last["w"]))
        return F.when(falls, F.concat(F.slice(blocks, 1, F.greatest(F.size(blocks) - 2, F.lit(0))), both)).otherwise(blocks)

    def put(blocks, row):
        grown = F.concat(blocks, F.array(block(row["at"], row["at"], row["s"], row["w"])))
        return F.aggregate(F.sequence(F.lit(1), F.size(grown)), grown, merged)

    pooled = rows.select(F.explode(F.aggregate("rows", F.array().cast(kind), put)).alias("b"), "rows")
    inside = F.filter("rows", lambda r: r["at"].between(F.col("b.first"), F.col("b.last")))
    return pooled.select(F.explode(F.transform(inside, lambda r: r["at"])).alias(at), (F.col("b.s") / F.col("b.w")).alias("q"))
