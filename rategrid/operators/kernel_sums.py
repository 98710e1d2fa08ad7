"""Sums over the events before each event, weighted by a smooth kernel of the time between."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from numpy.polynomial.chebyshev import chebvander
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PARTS, NODES = 32, 12
_AT = (1 - np.cos((np.arange(NODES) + 0.5) * np.pi / NODES)) / 2
_BASIS = np.linalg.inv(chebvander(2 * _AT - 1, NODES - 1))


def _basis(u: np.ndarray) -> np.ndarray:
    """Values at ``u`` (0 to 1) of the polynomials that are 1 at one of the nodes and 0 at the others."""
    return chebvander(2 * u - 1, NODES - 1) @ _BASIS


def _sums(t: np.ndarray, w: np.ndarray, asked: np.ndarray, step: int, kernel: list[np.ndarray]) -> np.ndarray:
    """For each of the times ``asked`` (in steps PARTS to 2 * PARTS) the sum over earlier ``t`` (sorted, from step 0 on) up to PARTS steps back."""
    basis = _basis((t % step) / step) * w[:, None]
    so_far = np.concatenate([np.zeros((1, NODES)), np.cumsum(basis, axis=0)])
    begin = np.searchsorted(t, np.arange(2 * PARTS + 1) * step)
    whole = so_far[begin[1:]] - so_far[begin[:-1]]
    full = sum(whole[PARTS - k : 2 * PARTS - k] @ kernel[k].T for k in range(1, PARTS))
    m = asked // step
    newest = so_far[np.searchsorted(t, asked)] - so_far[begin[m]]
    oldest = so_far[begin[m - PARTS + 1]] - so_far[np.searchsorted(t, asked - PARTS * step)]
    return np.sum(_basis((asked % step) / step) * (full[m - PARTS] + newest @ kernel[0].T + oldest @ kernel[PARTS].T), axis=1)


def kernel_sums(events: DataFrame, weight: str, reach: int, kernel: Callable[[np.ndarray], np.ndarray], radius: int = 1, carry: tuple = ()) -> DataFrame:
    """id, ``carry``, total of each of ``events`` (id, ir, ic, t_us, weight, carry): the sum of ``weight * kernel(microseconds between)`` over the events
    strictly before it and up to ``reach`` microseconds back (a multiple of 32) in the cells within ``radius``.  Null weights count as 0, and an event
    without time or cell has a sum of 0.

    Pairs would grow with the square of the events' density.  Instead time is cut into 32 parts of the reach, and in a part the kernel is a polynomial
    of both times to about 14 digits, so what a part adds to an event are a dozen running sums.  The kernel must be smooth from one part before
    0 on.  A task sees a row of cells and a block of the reach: an event goes to its own and the next block of each row it reaches.
    """
    step = reach // PARTS
    if step * PARTS != reach:
        raise ValueError(f"a reach of {reach} isn't a multiple of {PARTS}")
    tables = [kernel(step * (k + _AT[:, None] - _AT[None, :])) for k in range(PARTS + 1)]
    moves = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(b).alias("b")) for r in range(-radius, radius + 1) for b in (0, 1)])
    placed = F.col("t_us").isNotNull() & F.col("ir").isNotNull() & F.col("ic").isNotNull()
    rows = events.filter(placed).select("id", *carry, F.col("ic").cast("int").alias("_c"), F.col("t_us").alias("_t"), F.coalesce(F.col(weight).cast("double"), F.lit(0.0)).alias("_w"), F.col("ir").alias("_ir"), F.explode(moves).alias("_o"))
    own = (F.col("_o.r") == 0) & (F.col("_o.b") == 0)
    block = F.floor(F.col("_t") / reach) + F.col("_o.b")
    names = ["id", *carry]
    rows = rows.select(*[F.when(own, F.col(c)).alias(c) for c in names], own.alias("_own"), "_c", "_w", (F.col("_t") - (block - 1) * reach).alias("_t"), (F.col("_ir") + F.col("_o.r")).alias("_ir"), block.alias("_b"))
    kinds = dict(rows.dtypes)

    def summed(table: pa.Table) -> pa.Table:
        c, t, w = (table.column(x).to_numpy() for x in ("_c", "_t", "_w"))
        mine = np.flatnonzero(table.column("_own").to_numpy(zero_copy_only=False))
        order = np.argsort(t, kind="stable")
        c_sorted, t_sorted, w_sorted = c[order], t[order], w[order]
        total = np.zeros(len(mine))
        for cell in np.unique(c[mine]):
            near, of = np.abs(c_sorted - cell) <= radius, c[mine] == cell
            total[of] = _sums(t_sorted[near], w_sorted[near], t[mine[of]], step, tables)
        return table.select(names).take(pa.array(mine)).append_column("total", pa.array(total, pa.float64()))

    found = rows.groupBy("_ir", "_b").applyInArrow(summed, ", ".join(f"{x} {kinds[x]}" for x in names) + ", total double")
    return found.unionByName(events.filter(~placed).select(*names, F.lit(0.0).alias("total")))
