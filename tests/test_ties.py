"""Ties must come out the same however rows are ordered and dealt out, on both engines."""

import random

import duckdb
from pyspark.sql import functions as F

from rategrid.plans import inference, process
from rategrid.plans.registry import ORACLES
from rategrid.plans.scores import PRED

SECOND = {("own", "near"): "near", ("own", "mix"): "mix", ("near", "mix"): "mix"}


def test_collate_sql_ties_exactly_where_forecasts_are_equal():
    rng = random.Random(1)
    cells = [(w, i // 15, i % 15, rng.randrange(2), rng.random()) for w in range(7, 30) for i in range(150)]
    con = duckdb.connect()
    con.sql("SET threads=1")
    con.sql('CREATE TABLE three (model VARCHAR, "window" INT, ir INT, ic INT, y INT, p DOUBLE)')
    for model in ("own", "near", "mix"):
        con.executemany("INSERT INTO three VALUES (?, ?, ?, ?, ?, ?)", [(model, *c) for c in rng.sample(cells, len(cells))])
    sums = "lls AS" + inference.THREE.split("\nlls AS")[1]
    relation = con.sql(ORACLES["q_collate"].replace(inference.THREE, sums))
    got = [dict(zip(relation.columns, r)) for r in relation.fetchall()]
    assert len(got) == 9
    assert all(r["leader"] == SECOND[r["a"], r["b"]] and r["gain"] == 0 and not r["anchored"] for r in got)  # led by chance, as each forecast was summed by itself


def test_pairs_tie_exactly_where_forecasts_are_equal(spark):
    rng = random.Random(2)
    rows = [(w, y, p, p, 0.5) for w in range(7, 30) for y, p in [(rng.randrange(2), rng.random()) for _ in range(150)]]
    df = spark.createDataFrame(rows, "window int, y int, own double, near double, mix double").repartition(7)
    got = inference.pairs(df).groupBy("a", "b").agg(F.count("*"), F.max(F.abs("d")), F.sum("y")).collect()
    assert {(r[0], r[1]) for r in got} == set(SECOND)
    assert all(r[2] == 23 and (r[3] == 0) == (r[1] == "near") and r[4] == sum(x[1] for x in rows) for r in got)


def test_top_share_names_the_first_of_tied_windows(spark, monkeypatch):
    """The windows come backwards, and all but one, which is smaller, gain the same."""
    rows = [(w * 10_000_019, i // 15, i % 15, 1, 0.25 if w == 7 else 0.5, 0.25) for w in range(29, 6, -1) for i in range(150)]  # far apart, so DuckDB has no array of them in order
    con = duckdb.connect()
    con.sql("SET threads=1")
    con.sql('CREATE TABLE pred ("window" INT, ir INT, ic INT, y INT, own DOUBLE, near DOUBLE)')
    con.executemany("INSERT INTO pred VALUES (?, ?, ?, ?, ?, ?)", rows)
    sql = ORACLES["q_top_share"]
    assert sql.count(PRED + ",") == 1
    df = spark.createDataFrame(rows, "window int, ir int, ic int, y int, own double, near double")
    monkeypatch.setattr(process, "predictions", lambda spark, sf: df)
    for got in (con.sql(sql.replace(PRED + ",", "")).fetchall(), [tuple(r) for r in process.q_top_share(spark, "").collect()]):
        assert got == [(22, 0, 0.045455, 80_000_152)]  # the SQL named the window that came first
