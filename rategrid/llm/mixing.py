"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document gets the exponential key ``-ln(u) / weight``: ``u`` is a hash of its id, ``weight`` its quality weight.  Within a source,
documents in ascending key order form a weighted sample without replacement at every prefix.  A source whose target is ``e``
times its size and a rest takes ``e`` complete epochs, and of one more the prefix in key order whose words come nearest
to the rest.

The quality weight comes from the base statistics of the quality rules: ``k / LEVELS``, where ``k`` falls from ``LEVELS`` to 1 with the share
of a document's words that repeat (in 3-word windows), carry symbols or stand in repeated lines.

Scale.  Only (id, source, size, weight, u) of each document is shuffled.  The prefix sum does not gather a source in one task:
keys are cut into about sqrt(n) buckets of equal expected size, summed per (source, bucket), and the sums of the buckets are
prefix-summed per source; within a bucket a window adds the rest.  The table of sources has one row a source, and only that is
ordered as a whole.

Edge cases.  Null texts have size 0.  The null source is a source of its own, last in order.  A document without an id is hashed by its text.
Rows with one id have one key; ties go by id, then size.  Repeated rows count each.  Documents of size 0 take 0.  A very long text is one
row of sizes.  An empty table gives no rows.  Only the columns named in ``mix`` come out, so others can't clash.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rategrid.llm.common import materialize, small_batches
from rategrid.llm.quality import base

WEIGHTS = (5, 2, 1)
CAP = 3
#: Quality weights are k / LEVELS with k from 1 to LEVELS.
LEVELS = 8


def size_and_level(text: str | None) -> tuple[int, int]:
    """Number of words, and the quality level from 1 to ``LEVELS``."""
    text = text or ""
    words = text.encode("utf-8").split()
    _, symbols, dup_lines, repeated = base(text, words)
    return len(words), max(1, LEVELS - LEVELS * (symbols + repeated + 10 * dup_lines) // max(1, len(words)))


def _measure(frames):
    for batch in frames:
        sizes, levels = list(zip(*map(size_and_level, batch.column(3).to_pylist()))) or ((), ())
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sizes, pa.int64()), pa.array(levels, pa.int32())], ["doc_id", "source", "u", "size", "level"])


def uniform(doc_id: Column, text: Column) -> Column:
    """In (0, 1), from the first 13 hexadecimal digits of the md5 of the id's text, or of the text itself without an id."""
    h = F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), text, F.lit("")).cast("binary")), 1, 13), 16, 10)
    return (h.cast("long").cast("double") + 0.5) / F.lit(float(2**52))


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, cap: int = CAP) -> DataFrame:
    """source, source_size -> also target.

    Filling up: with the sources in order of cap / weight, ``level`` of a row is what one unit of weight gets when all rows
    before it are at their cap.  The largest level is the one that holds.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(w) for w in weights])
    ranked = sizes.withColumn("place", F.row_number().over(by_name)).withColumn(
        "w", F.element_at(cycle, ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    )
    order = [F.col("source_size") / F.col("w"), F.col("place")]
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy(*order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(whole) - cap * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    levels = ranked.withColumn("level", left.cast("double") / F.sum("w").over(after).cast("double"))
    top = levels.withColumn("level", F.max("level").over(whole))
    return top.select(
        "source",
        "source_size",
        F.least((cap * F.col("source_size")).cast("double"), F.col("w") * F.col("level")).alias("target"),
    )


def mix(docs: DataFrame, weights: tuple = WEIGHTS, cap: int = CAP) -> DataFrame:
    """doc_id, source, size, source_size, target, taken of every row of ``docs`` (doc_id, text, source)."""
    slim = docs.select("doc_id", "source", uniform(F.col("doc_id"), F.col("text")).alias("u"), F.col("text").cast("string").alias("text"))
    kinds = ", ".join(f"{c} {slim.schema[c].dataType.simpleString()}" for c in ("doc_id", "source"))
    slim = small_batches(slim).mapInArrow(_measure, f"{kinds}, u double, size long, level int")
    slim = materialize(slim.withColumn("weight", F.col("level") / F.lit(float(LEVELS))), "mix").withColumn("key", -F.log("u") / F.col("weight"))
    # the share of documents whose key is below a value, from the counts of the quality levels
    counts = {r["weight"]: r["n"] for r in slim.groupBy("weight").agg(F.count("*").alias("n")).collect()}  # 8 rows at most
    n = max(1, sum(counts.values()))
    below = sum(((1 - F.exp(-F.col("key") * w)) * (c / n) for w, c in counts.items()), F.lit(0.0))
    buckets = math.isqrt(n) + 1
    slim = slim.withColumn("bucket", F.least(F.floor(below * buckets), F.lit(buckets - 1)).cast("int"))

    sums = slim.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    in_source = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("offset", F.coalesce(F.sum("bucket_size").over(in_source), F.lit(0)))
    goals = targets(slim.groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap)
    offsets = offsets.alias("o").join(goals.alias("g"), F.col("o.source").eqNullSafe(F.col("g.source"))).select(
        F.col("o.source").alias("o_source"), F.col("o.bucket").alias("o_bucket"), "offset", "source_size", "target"
    )
    in_bucket = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = slim.withColumn("within", F.coalesce(F.sum("size").over(in_bucket), F.lit(0)))
    placed = placed.join(
        offsets, F.col("source").eqNullSafe(F.col("o_source")) & (F.col("bucket") == F.col("o_bucket"))
    )
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    rest = F.col("target") - epochs * F.col("source_size")
    more = (2 * (F.col("offset") + F.col("within")) + F.col("size")).cast("double") <= 2 * rest
    return placed.select(
        "doc_id",
        "source",
        "size",
        F.col("source_size").cast("long").alias("source_size"),
        "target",
        (F.col("size") * (epochs + more.cast("long"))).cast("long").alias("taken"),
    )
