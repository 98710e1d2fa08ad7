"""Exact order statistics and quantiles of groups of any size.

A sketch of each group gives boundaries, and one count by bucket tells exactly in which bucket a rank falls.  Small buckets are sorted, large ones are
cut again, with boundaries of their own.  A value that is a boundary has a bucket for itself, so repeated values can't keep a bucket
large.  No buffer holds more than a sketch or ``SMALL`` values, and rows are not copied for the ranks wanted.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rategrid.functions.core import bounds_below
from rategrid.sources.shared import materialize

BUCKETS = 512
SMALL = 20_000


def all_equal(a: str, b: str, columns: list[str]) -> Column:
    """Join condition: the columns of the aliases ``a`` and ``b`` are equal, nulls too."""
    return reduce(lambda x, c: x & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")), columns, F.lit(True))


def bucketed(rows: DataFrame, by: list[str], x: str, bucket: str, buckets: int = BUCKETS) -> DataFrame:
    """``rows`` with ``bucket``, which grows with ``x`` within each group; equal values share one, and a boundary has one of its own."""
    cuts = F.percentile_approx(x, [k / buckets for k in range(1, buckets)], 4 * buckets)
    # written, as a sketch that is made again may give other boundaries
    bounds = materialize(rows.groupBy(*by).agg(cuts.alias("_cuts")), "bounds")
    joined = rows.alias("r").join(bounds.alias("b"), all_equal("r", "b", by)).select("r.*", "b._cuts") if by else rows.crossJoin(F.broadcast(bounds))  # one row
    below = bounds_below(F.col("_cuts"), F.col(x), buckets)
    beyond = F.when((below > 0) & (F.get("_cuts", below - 1) < F.col(x)), 1).otherwise(0)
    return joined.withColumn(bucket, 2 * below + beyond).drop("_cuts")


def order_statistics(rows: DataFrame, by: list[str], x: str, wanted: DataFrame) -> DataFrame:
    """``by``, rank, value for every row of ``wanted`` (``by``, rank: from 0, below the group's size).  ``rows`` holds ``by`` and ``x``, without nulls."""
    left, keys, found = wanted.withColumn("_r", F.col("rank")), list(by), []
    while True:
        bucket = f"_k{len(keys) - len(by)}"
        placed = bucketed(rows, keys, x, bucket)
        counts = placed.groupBy(*keys, bucket).agg(F.count("*").alias("n"), F.min(x).alias("lo"), F.max(x).alias("hi"))
        before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)  # a row for each bucket
        counts = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
        inside = (F.col("w._r") >= F.col("c.before")) & (F.col("w._r") < F.col("c.before") + F.col("c.n"))
        met = left.alias("w").join(counts.alias("c"), all_equal("w", "c", keys) & inside)
        met = materialize(met.select("w.*", F.col(f"c.{bucket}").alias(bucket), (F.col("w._r") - F.col("c.before")).alias("_in"), "c.n", "c.lo", "c.hi"), "ranks")
        keys.append(bucket)
        found.append(met.filter("lo = hi").select(*by, "rank", F.col("lo").alias("value")))
        small = met.filter(f"lo < hi AND n <= {SMALL}")
        chosen = small.select(*keys).distinct()
        values = placed.alias("p").join(chosen.alias("c"), all_equal("p", "c", keys), "left_semi").groupBy(*keys).agg(F.array_sort(F.collect_list(x)).alias("_values"))
        joined = small.alias("s").join(values.alias("v"), all_equal("s", "v", keys))
        found.append(joined.select(*[f"s.{c}" for c in by], "s.rank", F.get("v._values", F.col("s._in").cast("int")).alias("value")))
        large = met.filter(f"lo < hi AND n > {SMALL}")
        if large.isEmpty():
            return reduce(DataFrame.unionByName, found)
        left = large.select(*keys, "rank", F.col("_in").alias("_r"))
        rows = materialize(placed.alias("p").join(left.select(*keys).distinct().alias("c"), all_equal("p", "c", keys), "left_semi"), "ranked")


def _sorted_quantiles(rows: DataFrame, by: list[str], shares: list[float]) -> DataFrame:
    """For groups of at most ``SMALL`` rows: each is sorted as one array."""
    sorted_ = rows.groupBy(*by).agg(F.array_sort(F.collect_list("_x")).alias("v"))
    if not by:
        sorted_ = sorted_.filter("size(v) > 0")

    def one(q):
        at = q * (F.size("v") - 1)
        low, high = F.get("v", F.floor(at).cast("int")), F.get("v", F.ceil(at).cast("int"))
        return low + (high - low) * (at - F.floor(at))

    return sorted_.select(*by, F.transform(F.array(*[F.lit(float(q)) for q in shares]), one).alias("p"))


def _ranked_quantiles(rows: DataFrame, by: list[str], shares: list[float], sizes: DataFrame) -> DataFrame:
    at = sizes.withColumn("_q", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(q)).alias("q")) for i, q in enumerate(shares)])))
    at = at.select(*by, F.col("_q.i").alias("i"), (F.col("_q.q") * (F.col("n") - 1)).alias("at"))
    low, high = F.floor("at"), F.ceil("at")
    wanted = at.select(*by, F.explode(F.array_distinct(F.array(low, high))).alias("rank")).distinct()
    found = materialize(order_statistics(rows, by, "_x", wanted), "quantiles")
    ends = at.alias("a").join(found.alias("l"), all_equal("a", "l", by) & (low == F.col("l.rank")))
    ends = ends.select(*[F.col(f"a.{c}").alias(c) for c in by], "i", "at", F.col("value").alias("low")).alias("a")
    ends = ends.join(found.alias("h"), all_equal("a", "h", by) & (high == F.col("h.rank")))
    value = F.col("low") + (F.col("h.value") - F.col("low")) * (F.col("at") - F.floor("at"))
    values = ends.select(*[F.col(f"a.{c}").alias(c) for c in by], F.struct("i", value.alias("v")).alias("v"))
    return values.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list("v")), lambda v: v["v"]).alias("p"))  # ``shares`` values a group


def quantiles(df: DataFrame, by: list[str], x: str, shares: list[float]) -> DataFrame:
    """``by``, p: the quantiles of ``x`` at ``shares``, linear between neighbours, as an array of doubles.  Null values don't count, and a group
    without others has no row."""
    rows = materialize(df.select(*by, F.col(x).cast("double").alias("_x")).filter("_x IS NOT NULL"), "values")
    large = materialize(rows.groupBy(*by).agg(F.count("*").alias("n")).filter(f"n > {SMALL}"), "large-groups")
    if large.isEmpty():
        return _sorted_quantiles(rows, by, shares)
    of = lambda how: rows.alias("r").join(large.alias("l"), all_equal("r", "l", by), how)
    few = _sorted_quantiles(of("left_anti"), by, shares) if by else None
    many = _ranked_quantiles(of("left_semi") if by else rows, by, shares, large)
    return many if few is None else many.unionByName(few)
