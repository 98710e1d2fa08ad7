"""Structured Streaming forms of the event counts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rategrid.sources.shared import release_later
from rategrid.streaming.ordered import closing_row


def window_counts(stream: DataFrame, at: str = "ts", key: str = "event_id", length: str = "1 day", late: str = "1 day", value: str = "value") -> DataFrame:
    """start, n, top per time window of a stream: repeated keys within the watermark count once, late rows are left out."""
    once = stream.withWatermark(at, late).dropDuplicatesWithinWatermark([key])
    return once.groupBy(F.window(at, length).alias("w")).agg(F.count("*").alias("n"), F.max(value).alias("top")).select(F.col("w.start").alias("start"), "n", "top")


def drained(spark: SparkSession, source: str, schema: StructType, build, folder: str, pattern: str | None = None, mode: str = "update", close: str | None = None, files: int | None = None) -> DataFrame:
    """Runs ``build`` over all files of a folder that are there now and returns the last update of each ``start``.

    Updates are written by batch number, and a batch that is run again replaces its own; state and output lie in the shared ``folder`` and go with
    the session's other tables.  ``close`` names the column of time of a stream that ends here: after the files one more row comes, later than
    all, so what waits for the watermark comes out.  ``files`` bounds the files of a batch.
    """
    base = f"{folder}/stream-{uuid.uuid4().hex}"
    reader = spark.readStream.schema(schema)
    reader = reader.option("maxFilesPerTrigger", files) if files else reader
    release_later(spark, base)

    def run() -> DataFrame:
        stream = (reader.option("pathGlobFilter", pattern) if pattern else reader).parquet(source)
        if close:
            stream = stream.unionByName(spark.readStream.schema(schema).parquet(f"{base}/close"))
        out = build(stream)

        def save(batch: DataFrame, number: int) -> None:
            batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{base}/out/number={number}")

        out.writeStream.outputMode(mode).foreachBatch(save).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
        return out

    if close:
        closing_row(schema, close, spark).limit(0).write.parquet(f"{base}/close")
    out = run()
    if close:
        closing_row(schema, close, spark).write.mode("append").parquet(f"{base}/close")
        out = run()
    written = spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in out.schema)}, batch int").parquet(f"{base}/out")
    last = F.max_by(F.struct(*out.columns), "batch")
    return written.groupBy(F.col("start").alias("_k")).agg(last.alias("r")).select("r.*")


def sliding_counts(stream: DataFrame, at: str = "ts", length: str = "3 days", slide: str = "1 day", late: str = "5 days") -> DataFrame:
    """start, n per sliding window."""
    counted = stream.withWatermark(at, late).groupBy(F.window(at, length, slide).alias("w")).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("start"), "n")


def sequences(stream: DataFrame, key: str, at: str = "ts", gap: str = "10 minutes", late: str = "5 days") -> DataFrame:
    """key, start, ends, n of the sequences of each key: events less than ``gap`` apart.  A sequence comes out once the watermark has passed it."""
    counted = stream.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return counted.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("ends"), "n")
