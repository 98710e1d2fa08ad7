"""Operators that cut groups into bounded pieces, against plain computations."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rategrid.operators import metrics, quantiles, slopes
from rategrid.operators.lattice import Lattice

DAY = 86_400_000_000


def test_quantiles_against_sorting(spark, monkeypatch):
    """Large and small groups, ties, nulls, a null group, and buckets that are cut again."""
    monkeypatch.setattr(quantiles, "SMALL", 40)
    monkeypatch.setattr(quantiles, "BUCKETS", 4)
    r = random.Random(3)
    rows = [("a", r.gauss(0, 10.0 ** r.randint(-6, 6))) for _ in range(3000)] + [("b", float(r.randint(0, 3))) for _ in range(2500)]
    rows += [("c", 1.5), (None, 2.0), (None, 4.0), ("d", None)] + [("e", 7.0)] * 900 + [("e", 7.0 + k / 1000) for k in range(60)]
    shares = [0, 0.025, 0.1, 0.5, 0.77, 0.975, 1]
    got = {x["g"]: x["p"] for x in quantiles.quantiles(spark.createDataFrame(rows, "g string, x double"), ["g"], "x", shares).collect()}
    own = lambda g: [x for k, x in rows if k == g and x is not None]
    assert set(got) == {"a", "b", "c", "e", None}
    for g, p in got.items():
        assert p == pytest.approx(np.quantile(own(g), shares).tolist(), rel=1e-12, abs=0), g
    whole = quantiles.quantiles(spark.createDataFrame(rows, "g string, x double"), [], "x", shares).first()["p"]
    assert whole == pytest.approx(np.quantile([x for _, x in rows if x is not None], shares).tolist(), rel=1e-12)
    assert quantiles.quantiles(spark.createDataFrame([], "g string, x double"), [], "x", shares).collect() == []


def plain_scores(p, y):
    order = sorted(set(p), reverse=True)
    pos, n, tp, seen, ap, above, caught = sum(y), len(y), 0, 0, 0.0, 0.0, 0.0
    for s in order:
        t, m = sum(b for a, b in zip(p, y) if a == s), sum(a == s for a in p)
        ap += t * (tp + t) / (seen + m)
        above += (m - t) * (tp + t / 2)
        caught += m * (tp + t / 2)
        tp, seen = tp + t, seen + m
    return ap / pos, above / (pos * (n - pos)), 2 * caught / (pos * n) - 1


def test_rankings_against_one_pass(spark):
    r = random.Random(4)
    rows = [("m", round(r.random(), 2), int(r.random() < 0.2)) for _ in range(700)] + [("k", r.random() ** 9, int(r.random() < 0.5)) for _ in range(1500)] + [("one", 0.5, 1)] * 3
    df = spark.createDataFrame(rows, "model string, p double, y int")
    got = {x["model"]: x for x in metrics.ranking(df, ["model"]).collect()}
    for m in ("m", "k"):
        assert tuple(got[m])[1:] == pytest.approx(plain_scores(*zip(*[(p, y) for k, p, y in rows if k == m])), rel=1e-9)
    assert tuple(got["one"])[1:] == (None, None, None)


def test_no_window_sees_a_whole_model(spark):
    """Every window over scores is keyed by a bucket too; the one by model alone has a row for each bucket."""
    df = spark.createDataFrame([("m", k / 3000, k % 2) for k in range(3000)], "model string, p double, y int")
    out = metrics.ranked(df, ["model"])
    assert out.count() == 3000
    tree = out._jdf.queryExecution().optimizedPlan().toString()
    specs = [line for line in tree.splitlines() if "Window [" in line]
    assert len(specs) == 2 and sum("_k" in line.split("windowspecdefinition(")[1].split(" DESC")[0] for line in specs) == 2


def test_slopes_around_cells_by_brute_force(spark):
    r = random.Random(7)
    grid = Lattice(20, 23)
    hot = [(9, 9)] * 5
    rows = []
    for i in range(2500):
        ir, ic = r.choice(hot + [(r.randrange(20), r.randrange(23)) for _ in range(5)])
        rows.append((i, ir, ic, r.randrange(12 * DAY), 2 + r.expovariate(2.3)))
    df = spark.createDataFrame(rows, "id long, ir int, ic int, t_us long, mag double")
    frame = spark.range(12).select(F.col("id").cast("int").alias("window")).crossJoin(grid.cells(spark))
    tiled = slopes._tiled(df, grid, 4, 9).groupBy("id").count()
    assert tiled.agg(F.max("count")).first()[0] <= 4
    got = {(x["window"], x["ir"], x["ic"]): (x["b"], x["fallback"]) for x in slopes.neighbourhood(df, grid, frame, 3).collect()}
    rows.sort(key=lambda e: (e[3], e[0]))

    def slope(mags):
        d = np.diff(mags)
        d = d[d >= 0.1]
        return 1 / (np.log(10) * (d.mean() - 0.1)) if len(d) >= 30 else None

    seen = set()
    for w in range(12):
        now = [e for e in rows if (w - 3) * DAY <= e[3] < w * DAY]
        every = slope([e[4] for e in now])
        for i in range(20):
            for j in range(23):
                own = slope([e[4] for e in now if abs(e[1] - i) <= 4 and abs(e[2] - j) <= 4])
                b, fallback = got[w, i, j]
                assert fallback == (own is None) and b == pytest.approx(own or every or 1.0, rel=1e-9)
                seen.add((own is None, every is None))
    assert seen == {(True, True), (True, False), (False, False)}


def test_slopes_do_not_see_the_future(spark):
    """The slopes of a window are the same on a catalog cut at it, for every window."""
    r = random.Random(8)
    grid = Lattice(5, 5)
    rows = [(i, r.randrange(5), r.randrange(5), r.randrange(8 * DAY), 2 + r.expovariate(2.3)) for i in range(900)]
    frame = spark.range(8).select(F.col("id").cast("int").alias("window")).crossJoin(grid.cells(spark))
    of = lambda some: {(x["window"], x["ir"], x["ic"]): tuple(x)[3:] for x in slopes.neighbourhood(spark.createDataFrame(some, "id long, ir int, ic int, t_us long, mag double"), grid, frame, 7).collect()}
    whole = of(rows)
    for w in (1, 3, 6):
        cut = of([e for e in rows if e[3] < w * DAY])
        assert all(cut[k] == v for k, v in whole.items() if k[0] == w)


def test_components_by_either_way(spark, monkeypatch):
    from rategrid.operators import graph

    r = random.Random(9)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1100)] + [(5000, 5000)]
    df = spark.createDataFrame(edges, "a long, b long")
    small = {x["node"]: x["comp"] for x in graph.components_by_size(df).collect()}
    monkeypatch.setattr(graph, "SMALL", 10)
    assert small == {x["node"]: x["comp"] for x in graph.components_by_size(df).collect()} and small[1100] == 1000 and small[5000] == 5000
    assert graph.components_by_size(df.limit(0)).collect() == []
