"""Fields from scattered stations: local planes, strain, and interpolation on a coarse lattice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def gradients(near: DataFrame, by: list[str], x: str, y: str, values: list[str], least_det: float = 1e-3) -> DataFrame:
    """``by`` and, for each of ``values``, d<value>_dx and d<value>_dy: the slopes of the plane that fits a group's points best, from sums; null
    where the points lie (nearly) on a line."""
    n = F.count("*").cast("double")
    of = lambda a, b: (F.sum(F.col(a) * F.col(b)) - F.sum(a) * F.sum(b) / n)
    sums = near.groupBy(*by).agg(of(x, x).alias("_xx"), of(x, y).alias("_xy"), of(y, y).alias("_yy"), *[of(c, v).alias(f"_{a}_{v}") for a, c in (("x", x), ("y", y)) for v in values])
    det = F.col("_xx") * F.col("_yy") - F.col("_xy") * F.col("_xy")
    sums = sums.withColumn("_det", F.when(det > least_det, det))
    out = []
    for v in values:
        out.append(((F.col(f"_x_{v}") * F.col("_yy") - F.col(f"_y_{v}") * F.col("_xy")) / F.col("_det")).alias(f"d{v}_dx"))
        out.append(((F.col(f"_y_{v}") * F.col("_xx") - F.col(f"_x_{v}") * F.col("_xy")) / F.col("_det")).alias(f"d{v}_dy"))
    return sums.select(*by, *out)


def second_invariant(du_dx: Column, du_dy: Column, dv_dx: Column, dv_dy: Column) -> Column:
    """Of the strain tensor, the symmetric part of the gradient."""
    shear = (du_dy + dv_dx) / 2
    return F.sqrt(du_dx * du_dx + dv_dy * dv_dy + 2 * shear * shear)


def bilinear(cells: DataFrame, nodes: DataFrame, step_i: float, step_j: float, rows: int, cols: int, value: str = "v") -> DataFrame:
    """ir, ic, ``value`` of every cell (ir, ic) from a lattice of ``rows`` x ``cols`` nodes (i, j, value); beyond its ends by the last patch.

    A cell has four corners, so it meets the nodes in one join and is summed.
    """
    clip = lambda x, top: F.least(F.greatest(F.floor(x), F.lit(0)), F.lit(top)).cast("int")
    k = cells.withColumn("_i", clip(F.col("ir") / step_i, rows - 2)).withColumn("_j", clip(F.col("ic") / step_j, cols - 2))
    s, t = F.col("ir") / step_i - F.col("_i"), F.col("ic") / step_j - F.col("_j")
    corner = lambda di, dj: F.struct((F.col("_i") + di).alias("i"), (F.col("_j") + dj).alias("j"), ((s if di else 1 - s) * (t if dj else 1 - t)).alias("w"))
    asked = k.withColumn("_c", F.explode(F.array(*[corner(a, b) for a in (0, 1) for b in (0, 1)]))).select("ir", "ic", "_c.*")
    return asked.join(nodes.select("i", "j", F.col(value).alias("_v")), ["i", "j"]).groupBy("ir", "ic").agg(F.sum(F.col("w") * F.col("_v")).alias(value))
