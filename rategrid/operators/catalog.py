"""Preparing an event catalog."""

from __future__ import annotations

from bisect import bisect_left
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rategrid.operators.graph import components_by_size
from rategrid.sources.shared import materialize


def first_of_key(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row of each key, the first in order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


WARM = 8  # gaps of events before a block from which its incoming state is guessed


def drop_near_repeats(df: DataFrame, by: list[str], gap: int, dmag: float, block: int | None = None) -> DataFrame:
    """Drops rows (id, t_us, mag, ``by``) within ``gap`` and ``dmag`` of an earlier row that was kept.

    A row that was dropped drops no other, so this is no self anti join but a walk in time.  Blocks of time (24 gaps, if nothing else is
    said) are walked at once.  What was kept in the gap before a block decides its first rows: it is guessed by walking the last ``WARM`` gaps
    of the block before, and compared with what that block did keep.  Blocks that guessed wrong are walked again from there, until none is.
    """
    block = block or 24 * gap
    names = df.columns
    own = df.withColumn("_b", F.floor(F.col("t_us") / block))
    start = lambda c: F.col(c) * block

    def walked(rows: DataFrame) -> DataFrame:
        """Of the rows of blocks, ``_own`` (0: before the block; -1: no row, but the state ``_seed`` that is known): rows kept, with the state before and
        after.  A state stands on a row of its own, the first of its block."""
        kinds = dict(df.dtypes)
        state = "array<struct<t:long,m:double>>"
        schema = ", ".join(f"{c} {kinds[c]}" for c in by) + f", _b long, ids array<long>, before {state}, after {state}"
        first = [*by, "_b"]

        def walk(batches):
            key = None
            for batch in batches:
                out = []
                *of, ids_, times, mags_, kinds_, seeds = (c.to_pylist() for c in batch.columns)
                for k, i, t, m, inside, seed in zip(zip(*of), ids_, times, mags_, kinds_, seeds):
                    if k != key:
                        if key is not None:
                            out.append(closed(key, ids, before, kept))
                        # what was kept in the gap before, in order of time, and its magnitudes in their own order
                        key, ids, before, kept, mags = k, [], None, deque(), []
                    if inside < 0:
                        kept = deque((x["t"], x["m"]) for x in seed)
                        mags = sorted(x for _, x in kept)
                        continue
                    if inside and before is None:
                        before = [x for x in kept if k[-1] * block - x[0] <= gap]
                    while kept and t - kept[0][0] > gap:
                        del mags[bisect_left(mags, kept.popleft()[1])]
                    at = bisect_left(mags, m)
                    if (at == len(mags) or abs(m - mags[at]) > dmag) and (at == 0 or abs(m - mags[at - 1]) > dmag):
                        kept.append((t, m))
                        mags.insert(at, m)
                        if inside:
                            ids.append(i)
                if out:
                    yield table(out, batch.schema)
            if key is not None:
                yield table([closed(key, ids, before, kept)], batch.schema)

        def closed(key, ids, before, kept):
            start = key[-1] * block
            before = [x for x in kept if start - x[0] <= gap] if before is None else before
            after = [x for x in kept if start + block - x[0] <= gap]
            return (*key, ids, *([{"t": t, "m": m} for t, m in xs] for xs in (before, after)))

        def table(rows, schema):
            states = pa.list_(pa.struct([("t", pa.int64()), ("m", pa.float64())]))
            types = [*(schema.field(c).type for c in first), pa.list_(pa.int64()), states, states]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], [*first, "ids", "before", "after"])

        slim = rows.select(*first, "id", "t_us", "mag", "_own", "_seed")
        parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # by number, as few bytes may be many rows to walk
        return slim.repartition(parts, *first).sortWithinPartitions(*first, "t_us", "id").mapInArrow(walk, schema)

    warm = own.filter(F.col("t_us") >= start("_b") + block - WARM * gap).withColumn("_b", F.col("_b") + 1)
    there = own.select(*by, "_b").distinct()
    none = F.lit(None).cast("array<struct<t:bigint,m:double>>")
    rows = own.withColumn("_own", F.lit(1)).unionByName(warm.join(there, [*by, "_b"], "left_semi").withColumn("_own", F.lit(0)))
    done = materialize(walked(rows.withColumn("_seed", none)), "walked")
    while True:
        # a row for each group and block
        came = done.select(*by, (F.col("_b") + 1).alias("_b"), F.col("after").alias("_came"))
        empty = F.array().cast("array<struct<t:bigint,m:double>>")
        checked = done.join(came, [*by, "_b"], "left").withColumn("_came", F.coalesce("_came", empty))
        wrong = materialize(checked.filter(F.col("before") != F.col("_came")).select(*by, "_b", F.col("_came").alias("_seed")), "wrong")
        if wrong.isEmpty():
            break
        known = wrong.withColumn("_own", F.lit(-1))
        again = own.withColumn("_own", F.lit(1)).join(wrong.drop("_seed"), [*by, "_b"], "left_semi").unionByName(known, allowMissingColumns=True)
        again = walked(again)
        done = materialize(done.join(wrong, [*by, "_b"], "left_anti").unionByName(again), "walked")
    kept = done.select(*by, "_b", F.explode("ids").alias("id"))
    return own.join(kept, [*by, "_b", "id"], "left_semi").select(*names)


def clusters(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, cluster of every node (id): the smallest id reachable over ``edges`` (a, b)."""
    found = components_by_size(edges)
    return nodes.join(found, F.col("id") == F.col("node"), "left").select("id", F.coalesce("comp", "id").alias("cluster"))
