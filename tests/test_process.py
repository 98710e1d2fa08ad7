import numpy as np
from pyspark.sql import functions as F

from rategrid.operators.resample import stationary
from rategrid.sources.logs import append_new, read_catalog
from rategrid.streaming.counts import drained, window_counts


def test_resampling_plan(spark):
    rows = stationary(spark, 20, 50).collect()
    assert len(rows) == 1000 and all(0 <= r["place"] < 20 for r in rows)
    assert rows == stationary(spark, 20, 50).collect()
    assert abs(np.mean([r["place"] for r in rows]) - 9.5) < 1.5


def test_log_takes_a_key_once(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = spark.createDataFrame([(1, 0.5), (1, 0.4), (2, 0.1)], "t0 int, p double")
    append_new(rows, path, "t0")
    append_new(rows.union(spark.createDataFrame([(3, 0.2)], rows.schema)), path, "t0")
    assert sorted((r["t0"], r["p"]) for r in spark.read.schema(rows.schema).json(path).collect()) == [(1, 0.4), (2, 0.1), (3, 0.2)]


def test_catalog_source(spark, tmp_path):
    (tmp_path / "c.csv").write_text("datetime_utc,latitude,longitude,depth_km,mag_pref,mag_type,md,ml,mw,ms,mb,location_name,catalog_source,source_file,event_code\n2020-01-02 03:04:05,40.1,28.2,x,3.1,ML,,3.1,,,,a,b,c,e1\n")
    r = read_catalog(spark, str(tmp_path / "c.csv")).first()
    assert (r["latitude"], r["depth_km"], r["ml"], r["mw"], r["event_code"]) == (40.1, None, 3.1, None, "e1")


def test_stream_counts_repeats_once(spark, tmp_path):
    rows = [(1, "2024-01-01 01:00:00", 1.0), (1, "2024-01-01 01:00:00", 1.0), (2, "2024-01-01 23:00:00", 4.0), (3, "2024-01-02 00:00:00", 2.0)]
    df = spark.createDataFrame(rows, "event_id long, ts string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    df.write.parquet(str(tmp_path / "in"))
    got = drained(spark, str(tmp_path / "in"), df.schema, window_counts, f"file://{tmp_path}").orderBy("start").collect()
    assert [(str(r["start"]), r["n"], r["top"]) for r in got] == [("2024-01-01 00:00:00", 2, 4.0), ("2024-01-02 00:00:00", 1, 2.0)]
