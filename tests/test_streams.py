"""Streams whose files come in reversed order and whose rows come late, against the batch results."""

import random

import pytest
from pyspark.sql import functions as F

from rategrid.operators.catalog import drop_near_repeats
from rategrid.sources.shared import shared_folder
from rategrid.streaming.counts import drained, sequences
from rategrid.streaming.ordered import keyed_timers, without_near_repeats

HOUR = 3_600_000_000
SCHEMA = "ic int, id long, t_us long, mag double, ts timestamp"


@pytest.fixture
def files(spark, tmp_path):
    """Two days of rows: the second day's file is older than the first day's, and one row, of the first hour, comes in a third."""
    r = random.Random(2)
    rows = [(r.randrange(3), i, r.randrange(48 * HOUR), round(2 + r.random(), 2)) for i in range(400)]
    late = (0, 9999, 60_000_000, 2.5)
    made = lambda some: spark.createDataFrame(some, "ic int, id long, t_us long, mag double").withColumn("ts", F.timestamp_micros("t_us")).coalesce(1)
    folder = str(tmp_path / "in")
    for some in ([x for x in rows if x[2] >= 24 * HOUR], [x for x in rows if x[2] < 24 * HOUR], [late]):
        made(some).write.mode("append").parquet(folder)
    return folder, made(rows), made([*rows, late])


def run(spark, folder, build, close="ts"):
    schema = spark.read.parquet(folder).schema
    return drained(spark, folder, schema, build, shared_folder(spark), mode="append", close=close, files=1)


def test_dedupe_out_of_order(spark, files):
    folder, rows, everything = files

    def build(late):
        return lambda s: without_near_repeats(s, "ic", HOUR, 0.1, late).withColumn("start", F.col("id"))

    ids = lambda df: sorted(x["id"] for x in df.collect())
    with keyed_timers(spark):
        patient, strict = run(spark, folder, build("60 hours")), run(spark, folder, build("25 hours"))
        unclosed = run(spark, folder, build("60 hours"), close=None)
    want = ids(drop_near_repeats(everything, ["ic"], HOUR, 0.1))
    assert ids(patient) == want and len(want) < 401
    # a watermark 25 hours behind the last row of the first file has passed the first hours of the others: those rows are late
    assert set(ids(strict)) < set(range(400)) | {9999} and 9999 not in ids(strict) and len(ids(strict)) > 150
    assert ids(unclosed) == []  # nothing has come that is 60 hours later


def test_sessions_in_append_mode(spark, files):
    folder, _, everything = files
    build = lambda s: sequences(s, "ic", gap="20 minutes", late="60 hours").withColumn("start", F.struct("ic", "start"))
    got = sorted((x["start"]["ic"], x["start"]["start"], x["n"]) for x in run(spark, folder, build).collect())
    batch = everything.groupBy(F.session_window("ts", "20 minutes").alias("w"), "ic").agg(F.count("*").alias("n"))
    assert got == sorted((x["ic"], x["w"]["start"], x["n"]) for x in batch.collect())
