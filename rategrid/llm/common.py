"""Helpers shared by the text operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rategrid.sources.shared import materialize  # noqa: F401  for the operators

#: White space that separates words everywhere in this subpackage: space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"

def words_of(text: str) -> list[bytes]:
    """The words of a text as UTF-8; bytes.split() cuts at exactly space and U+0009 to U+000D."""
    return text.encode("utf-8", "surrogatepass").split()


def n_words(text: Column) -> Column:
    """Number of words of a text column, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the decimal text of ``doc_id`` modulo ``folds``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of an Arrow batch: texts can be long, and Spark's default of 10,000 rows would hold that many at once.
BATCH_ROWS = 1000


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, after bounding the session's Arrow batches to ``BATCH_ROWS`` rows."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(df.sparkSession.conf.get(name, "10000"))
    if not 0 < now <= BATCH_ROWS:
        df.sparkSession.conf.set(name, str(BATCH_ROWS))
    return df


def labelled(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, per_class: int) -> tuple[DataFrame, dict]:
    """A bounded sample of labelled rows for fitting a classifier: (id, place, text, y), and how many labelled rows of its label a row
    stands for.

    Of each label value the ``per_class`` rows of ``labels`` with the lowest hash of their id are taken, from the folds other than
    ``held_out``, with their whole texts.  ``place`` is that hash.  Of rows with one id the first text and the lowest label count; null
    labels and ids are left out.
    """
    spark = docs.sparkSession
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & (fold(F.col("doc_id"), folds) != held_out))
    known = known.groupBy("doc_id").agg(F.min(label).cast("int").alias("y")).withColumn("place", F.xxhash64("doc_id"))
    totals = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    found = [r for value in (0, 1) for r in known.filter(F.col("y") == value).orderBy("place", "doc_id").limit(per_class).collect()]
    ids = spark.createDataFrame([(r["doc_id"], r["y"], r["place"]) for r in found], "id long, y int, place long")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = texts.join(F.broadcast(ids), F.col("doc_id") == F.col("id"))  # 2 * per_class rows at most
    rows = rows.groupBy("id", "place", "y").agg(F.coalesce(F.min("text"), F.lit("")).alias("text")).select("id", "place", "text", "y")
    weight = {v: totals.get(v, 0) / max(1, sum(r["y"] == v for r in found)) for v in (0, 1)}
    return rows, weight


def unused(columns: list[str], *names: str) -> list[str]:
    """``names``, with underscores before those that ``columns`` has, whatever the case."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def with_columns(schema, **types):
    """A copy of a schema with more columns."""
    from pyspark.sql.types import StructField, StructType

    return StructType([*schema.fields, *(StructField(name, kind) for name, kind in types.items())])


def appended(batch, **columns):
    """An Arrow batch with more columns."""
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([*batch.columns, *columns.values()], [*batch.schema.names, *columns])


#: Odd 64-bit multipliers.
MIX1, MIX2, MIX3 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def mix64(x):
    """A bijection of 64-bit words, over a numpy uint64 array."""
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX2)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX3)
    return x ^ (x >> np.uint64(31))


class WordHashes:
    """64-bit hashes of words, remembered for up to ``keep`` of them."""

    def __init__(self, keep: int = 150_000):
        self.known, self.keep = {}, keep

    def of(self, words: list[bytes]):
        import numpy as np
        import xxhash

        known = self.known
        if len(known) > self.keep:
            known.clear()
        get, digest = known.get, xxhash.xxh3_64_intdigest
        out = np.empty(len(words), np.uint64)
        for i, w in enumerate(words):
            h = get(w)
            if h is None:
                h = known[w] = digest(w)
            out[i] = h
        return out
