"""Trajectories, nearest stations and fields against plain computations."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rategrid.operators import field, joins, trajectory


def some_series(seed=1):
    r = np.random.default_rng(seed)
    rows = []
    for s in range(4):
        t = np.sort(r.uniform(0, 3.2, 150))
        v = 2 + 0.7 * t + 1.5 * (t >= 1.3 + s / 10) + 0.4 * np.sin(2 * np.pi * t) - 0.3 * np.cos(4 * np.pi * t) + r.normal(0, 0.05, len(t))
        rows += [(s, float(a), float(b)) for a, b in zip(t, v)]
    return rows


def fitted(spark, rows, least=12):
    series = spark.createDataFrame(rows, "station int, t double, v double").coalesce(1)  # sums in one order
    columns = trajectory.design(F.col("t"), 1.0, (F.col("t") >= 1.3 + F.col("station") / 10,))
    month = F.floor(F.col("t") * 12)
    return series, columns, month, trajectory.fits(series, "station", month, columns, F.col("v"), least)


def plain_design(t, s):
    return np.column_stack([np.ones_like(t), t, t >= 1.3 + s / 10, np.sin(2 * np.pi * t), np.cos(2 * np.pi * t), np.sin(4 * np.pi * t), np.cos(4 * np.pi * t)]).astype(float)


def test_trajectories_against_least_squares(spark):
    rows = some_series()
    got = {(x["station"], x["cutoff"]): (x["n"], x["c"]) for x in fitted(spark, rows)[3].collect()}
    late = 0
    for (s, cutoff), (n, c) in got.items():
        t, v = np.array([(a, b) for k, a, b in rows if k == s and a * 12 < cutoff]).T
        assert n == len(t)
        if n < 12:
            assert c is None
            continue
        d = plain_design(t, s)
        assert (d @ np.array(c)) == pytest.approx(d @ np.linalg.lstsq(d, v, rcond=None)[0], abs=1e-5)
        if cutoff > 24:
            late += 1
            assert c == pytest.approx(np.linalg.lstsq(d, v, rcond=None)[0].tolist(), abs=1e-6)
            assert c[2] == pytest.approx(1.5, abs=0.1) and c[1] == pytest.approx(0.7, abs=0.1)
    assert late > 30


def test_trajectories_do_not_see_the_future(spark):
    """Cutoffs at ends of months and within one: the fits up to a cutoff are those of a series that ends there."""
    rows = some_series(2)
    whole = {(x["station"], x["cutoff"]): x["c"] for x in fitted(spark, rows)[3].collect()}
    for cut in (10, 19, 30):
        short = {(x["station"], x["cutoff"]): x["c"] for x in fitted(spark, [x for x in rows if x[1] * 12 < cut])[3].collect()}
        assert short and all(short[k] == whole[k] for k in short if k[1] <= cut)
    series, columns, month, found = fitted(spark, rows)
    res = trajectory.residuals(series, found, "station", month, columns, F.col("v")).collect()
    late = [x for x in res if x["residual"] is not None and x["t"] > 2.2]
    assert len(late) > 50 and float(np.median([abs(x["residual"]) for x in late])) < 0.15


def test_steps_that_have_not_come_are_left_out(spark):
    """Before its step a column is all zeros; its coefficient is 0 and the others are the fit without it."""
    rows = [(0, t, v) for _, t, v in some_series(3) if t < 1.2][:90]
    c = fitted(spark, rows)[3].orderBy(F.desc("cutoff")).first()["c"]
    t, v = np.array([(a, b) for _, a, b in rows]).T
    assert c[2] == 0 and c == pytest.approx(np.linalg.lstsq(plain_design(t, 0), v, rcond=None)[0].tolist(), abs=1e-5)


def test_k_nearest_by_brute_force(spark):
    r = random.Random(6)
    places = [(i, r.gauss(0, 1) * 20, r.gauss(0, 1) * 20, r.random()) for i in range(120)] + [(500, 3.0, 3.0, 1.0), (501, 3.0, 3.0, 2.0), (502, 300.0, -250.0, 3.0)]
    points = [(i, r.uniform(-60, 60), r.uniform(-60, 60)) for i in range(80)] + [(900, 3.0, 3.0), (901, 1e4, 1e4), (902, -500.0, 0.0)]
    p, q = spark.createDataFrame(points, "key long, x double, y double"), spark.createDataFrame(places, "place long, x double, y double, u double")
    got = {}
    for x in joins.k_nearest(p, q, "key", "place", 3, 5.0, carry=("u",)).collect():
        got.setdefault(x["key"], {})[x["rank"]] = (x["place"], x["px"], x["py"], x["u"])
    for i, x, y in points:
        want = sorted(places, key=lambda s: (float(np.sqrt((x - s[1]) * (x - s[1]) + (y - s[2]) * (y - s[2]))), s[0]))[:3]
        assert [got[i][k] for k in (1, 2, 3)] == want, i
    few = joins.k_nearest(p, q.limit(2), "key", "place", 3, 5.0).groupBy("key").count().collect()
    assert len(few) == len(points) and {x["count"] for x in few} == {2}


def test_planes_and_strain(spark):
    r = np.random.default_rng(8)
    x, y = r.uniform(0, 9, (2, 40))
    rows = [("a", float(a), float(b), float(3 + 2 * a - b), float(0.5 * a + 4 * b)) for a, b in zip(x, y)] + [("line", float(k), 2.0 * k, 1.0, 2.0) for k in range(5)] + [("one", 1.0, 1.0, 1.0, 1.0)]
    g = field.gradients(spark.createDataFrame(rows, "g string, x double, y double, u double, v double"), ["g"], "x", "y", ["u", "v"])
    got = {k["g"]: k for k in g.withColumn("e", field.second_invariant(F.col("du_dx"), F.col("du_dy"), F.col("dv_dx"), F.col("dv_dy"))).collect()}
    assert [got["a"][c] for c in ("du_dx", "du_dy", "dv_dx", "dv_dy")] == pytest.approx([2, -1, 0.5, 4], abs=1e-9)
    e = np.array([[2, -0.25], [-0.25, 4]])
    assert got["a"]["e"] == pytest.approx(np.sqrt((e * e).sum())) and got["line"]["e"] is None and got["one"]["e"] is None
