"""The event view that all queries share, on both engines, and the query registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rategrid.functions.core import US_PER_DAY, fixed, micros_since
from rategrid.operators.lattice import Lattice

GRID = Lattice(10, 15)
DAYS = 30
QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}

#: The same view in DuckDB's SQL.
EV = """
ev AS (SELECT event_id AS id, user_id, event_type AS mag_type, value, epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01') AS t_us,
  1 + ln(1 + value) / ln(10) AS mag, (user_id % 10)::INT AS ir, ((user_id // 10) % 15)::INT AS ic,
  ((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 86400000000)::INT AS win, ts FROM events)"""
CELLS = "cells AS (SELECT r.range::INT AS ir, c.range::INT AS ic FROM range(10) r, range(15) c)"
WINS = "wins AS (SELECT range::INT AS win FROM range(7, 30))"


def r6(sql: str) -> str:
    return f"(floor(({sql})::DOUBLE * 1000000 + 0.5) / 1000000)"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shaped(spark.read.parquet(f"{sf_dir}/events.parquet"))


def shaped(e: DataFrame) -> DataFrame:
    """The view of a table or stream of events."""
    t = micros_since(F.col("ts"), "2024-01-01")
    return e.select(
        F.col("event_id").alias("id"),
        "user_id",
        F.col("event_type").alias("mag_type"),
        "value",
        t.alias("t_us"),
        (1 + F.log(1 + F.col("value")) / F.log(F.lit(10.0))).alias("mag"),
        (F.col("user_id") % 10).cast("int").alias("ir"),
        (F.floor(F.col("user_id") / 10) % 15).cast("int").alias("ic"),
        F.floor(t / US_PER_DAY).cast("int").alias("win"),
        "ts",
    )


def query(sql: str | None):
    """Registers a query under its function's name, with its DuckDB SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


__all__ = ["CELLS", "DAYS", "EV", "GRID", "ORACLES", "QUERIES", "US_PER_DAY", "WINS", "events", "fixed", "query", "r6", "shaped"]
