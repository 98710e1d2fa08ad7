"""Connected components."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rategrid.sources.shared import materialize

#: Edges that one task joins in memory; more are joined by spreading labels.
SMALL = 200_000


def components(edges: DataFrame) -> DataFrame:
    """node, comp (smallest node reachable) of every node in ``edges`` (a, b: long).

    Smallest labels spread along the edges and then jump to their own label, until nothing changes; every step is written to
    the shared folder.  The number of steps grows with the logarithm of a component's width.
    """
    both = materialize(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("comp")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        step = labels.join(near, "node").select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("mid"))
        up = step.select(F.col("node").alias("mid"), F.col("mid").alias("top"))
        step = materialize(step.join(up, "mid").select("node", "old", F.col("top").alias("comp")), "labels")
        labels = step.select("node", "comp")
        if step.filter("comp <> old").isEmpty():
            return labels


def _joined(batches):
    """node, comp of the edges of one task, by union-find."""
    parent: dict = {}

    def top(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            parent.setdefault(a, a)
            parent.setdefault(b, b)
            x, y = top(a), top(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
    nodes = list(parent)
    for at in range(0, len(nodes), 10_000):
        some = nodes[at : at + 10_000]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([top(x) for x in some], pa.int64())], ["node", "comp"])


def components_by_size(edges: DataFrame) -> DataFrame:
    """The same as ``components``.  The edges are written and counted; ``SMALL`` of them or fewer are joined by one task, in one step, as
    spreading labels would take longer to plan than to do."""
    written = materialize(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")), "edges")
    if written.count() > SMALL:
        return components(written)
    return written.coalesce(1).mapInArrow(_joined, "node long, comp long")
