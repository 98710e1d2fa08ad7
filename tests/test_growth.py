"""Steps whose work or memory must not grow faster than their input."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from rategrid.operators import catalog, joins, likelihood, snapshots
from rategrid.operators.kernel_sums import kernel_sums
from rategrid.plans import process
from rategrid.sources import encoded, text


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_copied_sides_of_range_joins_are_not_broadcast(spark):
    e = spark.range(1000).select("id", F.col("id").alias("t"))
    p = spark.range(1000).select(F.col("id").alias("p"), F.col("id").alias("low"), (F.col("id") + 50).alias("high"))
    for how in ("inner", "left_semi", "left_anti"):
        text = plan(joins.range_join(e, p, "t", "low", "high", 10, how=how))
        assert "SortMergeJoin" in text and "Broadcast" not in text
    assert joins.range_join(e, p, "t", "low", "high", 10).count() == sum(min(50, 1000 - i) for i in range(1000))


def test_nearest_other_copies_no_row(spark):
    rng = random.Random(5)
    rows = [(k, rng.randrange(2), rng.randrange(60) - 20) for k in range(90)]  # many at one time, some before the origin
    df = spark.createDataFrame(rows, "id long, g int, t long")
    got = joins.nearest_other(df, "id", "t", ["g"], 4, 3)
    want = set()
    for i, g, t in rows:
        near = [(abs(u - t), j, u - t) for j, h, u in rows if h == g and j != i and t - 4 <= u < t + 3]
        if near:
            want.add((i, *min(near)[1:]))
    assert {tuple(r) for r in got.collect()} == want
    assert "Generate" not in plan(got)  # was a range join with all rows around


def test_nearest_other_carries_columns(spark):
    df = spark.createDataFrame([(k, 0, 10 * (k // 2), k % 3) for k in range(12)], "id long, g int, t long, season int")
    got = joins.nearest_other(df, "id", "t", ["g"], 4, 4, ("season",))
    assert {tuple(r) for r in got.collect()} == {(k, k % 3, k ^ 1, 0) for k in range(12)}  # were joined to the events by id afterwards


def test_followed_copies_no_event_to_triggers(spark):
    rng = random.Random(6)
    day, hour = snapshots.US_PER_DAY, snapshots.US_PER_DAY // 24
    rows = [(k, rng.randrange(2), rng.choice([rng.randrange(12 * day), rng.randrange(12 * 24) * hour, 3 * day]), round(rng.uniform(1.5, 3.6), 2)) for k in range(500)]
    df = spark.createDataFrame(rows, "id long, g int, t_us long, mag double").withColumn("win", F.floor(F.col("t_us") / day))
    out = snapshots.followed(df, df.filter("mag >= 3.3"), ["g"], (1, 3), 2, 1.0, enough=5)
    got = {(r["id"], r["days"]): (r["n"], r["top"], round(r["b_drop"], 9), r["later_top"]) for r in out.collect()}
    want = {}
    for i, g, t, m in rows:
        if m >= 3.3:
            same = sorted((u, j, x) for j, h, u, x in rows if h == g and u > t)
            heavy = [(u, x) for u, _, x in same if x >= 2.0]
            for d in (1, 3):
                inside = [x for u, _, x in same if u <= t + d * day]
                steps = [y - x for (_, x), (u, y) in zip(heavy, heavy[1:]) if u <= t + d * day and y - x >= 0.1]
                b = 1 / (math.log(10) * (sum(steps) / len(steps) - 0.1)) if len(steps) >= 5 else 1.0
                late = [x for u, _, x in same if t + d * day < u <= t + (d + 2) * day]
                want[i, d] = (len(inside), max(inside, default=None), round(1 - b, 9), max(late, default=None))
    assert got == want


def test_kernel_sums_meet_no_pairs(spark):
    rng = random.Random(7)
    reach = 32 * 1000
    rows = [(k, rng.randrange(3), rng.randrange(4), rng.choice([rng.randrange(-reach, 3 * reach), 500 * rng.randrange(150)]), rng.random()) for k in range(600)]
    df = spark.createDataFrame([*rows, (600, 0, 0, None, 1.0), (601, 0, 0, 40_000, None)], "id long, ir int, ic int, t_us long, w double")
    kernel = lambda us: (us / reach + 0.16) ** -1.2
    out = kernel_sums(df, "w", reach, kernel)
    got = {r["id"]: r["total"] for r in out.collect()}
    assert len(got) == 602 and got.pop(600) == 0.0 and got.pop(601) > 0
    for i, ir, ic, t, _ in rows:
        want = sum(w * kernel(t - u) for _, a, b, u, w in rows if abs(a - ir) <= 1 and abs(b - ic) <= 1 and t - reach <= u < t)
        assert abs(got[i] - want) <= 1e-11 * max(1.0, want)
    assert "Join" not in plan(out)  # was a range join


def test_dedupe_passes_a_known_state_once_a_block(spark, monkeypatch):
    # steps of 0.04 within a gap: whether a row is kept depends on all rows before it, so guesses fail and blocks are walked again from known states
    rows = [(k, 7 * k, 2.0 + 0.04 * (k % 2), 0) for k in range(120)]
    df = spark.createDataFrame(rows, "id long, t_us long, mag double, g int")
    kept, want = [], set()
    for i, t, m, _ in rows:
        kept = [x for x in kept if t - x[0] <= 10]
        if all(abs(m - a) > 0.05 for _, a in kept):
            kept.append((t, m))
            want.add(i)
    walked = []
    write = catalog.materialize
    monkeypatch.setattr(catalog, "materialize", lambda rows, label: walked.append((label, plan(rows))) or write(rows, label))
    got = catalog.drop_near_repeats(df, ["g"], 10, 0.05, block=130)
    assert {r["id"] for r in got.collect()} == want
    again = [text for label, text in walked if label == "walked"][1:]
    # a state is an array: joined to the rows of its block it would be passed to Python with each of them
    assert again and all("LeftSemi" in text and "Union" in text for text in again)


def test_nearest_meets_few_places_however_dense(spark, monkeypatch):
    rng = random.Random(8)
    spot = lambda: (round(rng.gauss(0, 0.01), 4), round(rng.gauss(0, 0.01), 4))
    places = [(k, *spot()) for k in range(800)] + [(k, 0.01, 0.01) for k in range(800, 1000)] + [(1000, 3.0, -2.0)]
    points = [(k, *spot()) for k in range(60)] + [(60, -2.0, 1.0), (61, 0.01, 0.01), (62, None, 0.0)]
    grids = []
    floor = joins.math.floor
    monkeypatch.setattr(joins.math, "floor", lambda x: grids.append(x) or floor(x))
    got = joins.nearest(spark.createDataFrame(points, "p long, x double, y double"), spark.createDataFrame(places, "s long, x double, y double"), "p", "s", 0.5)
    got = {r["p"]: r["s"] for r in got.collect()}
    want = {p: None if x is None else min((math.sqrt((x - u) * (x - u) + (y - v) * (y - v)), s) for s, u, v in places)[1] for p, x, y in points}
    assert got == want
    assert max(grids) > 100  # 3.0 over the first width: finer than the 0.5 that holds all places in one cell


def test_likelihood_meets_no_pairs_of_many_events(spark, monkeypatch):
    rng = np.random.default_rng(9)
    n, tau, radius, beta = 1500, 0.125, 1.0, 2.3
    t = rng.uniform(-0.05, 0.3, n)
    t[:60] = rng.integers(0, 3, 60) * tau  # some at one time, and just tau apart
    x, y, dm = rng.integers(0, 2, n) / 2.0, rng.integers(-1, 2, n) / 1.0, rng.exponential(0.4, n)
    rows = [(i, *map(float, r), 0.01) for i, r in enumerate(zip(t, x, y, dm))] + [(n, 0.1, None, 0.5, 1.0, 0.01), (n + 1, 0.1, 0.5, None, 1.0, 0.01), (n + 2, None, 0.5, 0.5, 1.0, 0.01)]
    monkeypatch.setattr(likelihood, "pairs", None)  # were written for all events
    theta = likelihood.pack(beta, 900.0, 0.3, 0.9, 0.02, 1.2, 0.4, 1.6, 0.2)
    problem = likelihood.Problem.of(spark.createDataFrame(rows, "id long, t double, x double, y double, dm double, u double"), 0.3, tau, radius, beta)
    assert problem.blocks.count() <= 6 * len(rows)
    nll, grad = problem.value(theta)
    v = likelihood.unpack(theta, beta)
    dt, r2 = t[:, None] - t, (x[:, None] - x) ** 2 + (y[:, None] - y) ** 2
    s = v["d"] * 10 ** (v["gamma"] * dm)
    met = (dt > 0) & (dt <= tau) & (r2 <= radius**2)
    place = v["k"] * np.exp(v["alpha"] * dm) * (v["p"] - 1) / v["c"] * (v["q"] - 1) / (math.pi * s) * (1 + r2 / s) ** -v["q"]
    w = np.where(met, place * (1 + np.where(met, dt, 0) / v["c"]) ** -v["p"], 0).sum(axis=1)[t >= 0]
    lam = np.append(v["mu"] * 0.01 + w, [v["mu"] * 0.01] * 2)
    b1, b2 = (1 + z / v["c"] for z in (np.clip(-t, 0, tau), np.minimum(0.3 - t, tau)))
    of = v["k"] * np.exp(v["alpha"] * dm) * (b1 ** (1 - v["p"]) - b2 ** (1 - v["p"])) * (1 - (1 + radius**2 / s) ** (1 - v["q"]))
    s1 = v["d"] * 10 ** v["gamma"]  # the two without a place trigger all the same
    lone = v["k"] * math.exp(v["alpha"]) * (1 - (1 + tau / v["c"]) ** (1 - v["p"])) * (1 - (1 + radius**2 / s1) ** (1 - v["q"]))
    assert abs(nll - (v["mu"] * 0.3 + of.sum() + 2 * lone - np.log(lam).sum())) < 1e-10 * abs(nll)
    assert abs(-grad[0] - ((v["mu"] * 0.01 / lam).sum() - v["mu"] * 0.3)) < 1e-9 * n
    grid = likelihood._Grid(likelihood._Kernels(*(v[k] for k in ("k", "alpha", "c", "p", "d", "q", "gamma"))), tau, 32, -tau, np.sort(t))
    order, asked = np.argsort(t), np.flatnonzero((t >= 0) & (t < tau))
    sums = grid.sums(t[asked], np.arange(n), np.ones((n, 5)))
    for a, i in enumerate(asked):
        d = t[i] - t[order]
        for got, want in zip(sums[a, [0, 5, 6]], grid_kernel(v, d[(d > 0) & (d <= tau)])):
            assert abs(got - want) < 1e-10 * max(1.0, abs(want))


def grid_kernel(v: dict, dt):
    a = 1 + dt / v["c"]
    f = a ** -v["p"]
    return f.sum(), (f * (v["p"] * (dt / v["c"]) / a - 1)).sum(), (f * (1 - (v["p"] - 1) * np.log(a))).sum()


def test_points_far_from_all_places_meet_few(spark):
    rng = random.Random(11)
    places = [(k, round(rng.random(), 4), round(rng.random(), 4)) for k in range(4000)]
    points = [(k, round(-2 * rng.random(), 4), round(3 * rng.random() - 1, 4)) for k in range(40)] + [(40, -0.5, 0.5), (41, 5.0, -30.0)]
    p, q = spark.createDataFrame(points, "p long, x double, y double"), spark.createDataFrame(places, "s long, x double, y double")
    want = {k: min((math.sqrt((x - u) * (x - u) + (y - v) * (y - v)), s) for s, u, v in places) for k, x, y in points}
    got = {r["p"]: (r["distance"], r["s"]) for r in joins.nearest(p, q, "p", "s", 0.02).collect()}
    assert got == want
    spots = q.select("s", F.col("x").alias("px"), F.col("y").alias("py"), F.floor(F.col("x") / 0.02).alias("_i"), F.floor(F.col("y") / 0.02).alias("_j"))
    for bits in (1, 4):
        asked = joins._descend(p, spots, "p", 6, bits).groupBy("p").count().agg(F.count("*"), F.sum("count")).first()
        assert asked[0] == len(points) and asked[1] < 8 * len(points)  # of 2,500 cells; met all of them


def test_pages_in_lines_read_as_whole_ones(spark, tmp_path):
    row = "\t".join(["1", "c", "2020.01.01", "00:00:00", "40", "27", "5", "3.1", "-.-", "3.1", "", "", "0.0", "Ke", "ŞİLE ğ�"])
    rng = random.Random(12)
    pages = {
        "1": f"<b>2 rows</b>\n<pre>head\n{row}\n{row}\n</pre>\n{row}\n<pre>\n{row}\n</pre>", "2": f"9 rows\n{row}\n<pre>\n{row}\n", "3": f"</pre><pre>{row}\n{row}</pre> 3 rows 4 rows\n5 rows", "4": f"{row}\n4 rows",
        "5": f"<pre>{row}</pre>\n{row}\r\n</pre>", "6": "99999999999999999999 rows\n7 rows<pre>\n</pre>", "7": "no\n\n", "8": "<b>3000 rows</b><pre>\n" + "".join(f"{row}\n" for _ in range(3000)) + f"</pre>\n{row}",
    }
    for k, page in pages.items():
        (tmp_path / f"page_id={k}").mkdir()
        (tmp_path / f"page_id={k}" / f"{rng.random()}.csv").write_bytes(page.encode("cp1254", "replace"))
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        lines = encoded.read_lines(spark, str(tmp_path), "cp1254", "*.csv")
        assert lines.select("path", "at.split").distinct().groupBy("path").count().agg(F.max("count")).first()[0] > 5  # a page was one value
        got, said = text.bulletin_of_lines(lines.select("page_id", "at", "line"))
        whole = encoded.read_pages(spark, str(tmp_path), "cp1254", "*.csv")
        want = text.bulletin(whole)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() > 3000
        assert sorted(map(tuple, encoded.judged(said, got).collect())) == sorted(map(tuple, encoded.judged(whole, want).collect()))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def test_pairs_after_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(joins, "RUN", 3)
    monkeypatch.setattr(joins, "PART", 2)
    rng = random.Random(19)
    rows = [(k, rng.randrange(-2, 4), rng.randrange(4), rng.choice([rng.randrange(-90, 150), 10 * rng.randrange(-9, 15)])) for k in range(150)]
    rows += [(k, 1, 1, 40 + k % 7) for k in range(150, 200)]  # a crowd of several parts, with equal times
    rows += [(None, 1, 2, 45), (200, 1, 1, None), (201, None, 1, 45), (7, 1, 1, 46)]
    got = joins.pairs_after(spark.createDataFrame(rows, "id long, ir int, ic int, t long"), "id", "t", 10)
    there = [r for r in rows if None not in r[1:]]
    want = [(i, j, u - t) for i, a, b, t in there for j, c, d, u in there if abs(a - c) <= 1 and abs(b - d) <= 1 and 0 < u - t <= 10]
    order = lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or 0, r[2])
    assert got.columns == ["earlier", "later", "dt"] and sorted((tuple(r) for r in got.collect()), key=order) == sorted(want, key=order)
    assert any(i is None for i, _, _ in want) and any(d == 10 for _, _, d in want)


def test_pairs_meet_runs_of_rows(spark, tmp_path, monkeypatch):
    met, join, n = [], joins.range_join, 3000

    def spy(events, probes, *a, **b):
        met.extend([events.count(), probes.count()])
        return join(events, probes, *a, **b)

    monkeypatch.setattr(joins, "range_join", spy)
    at = F.timestamp_micros(F.lit(1_704_067_200_000_000) + 1_000_000 * F.when(F.col("id") < n // 2, F.col("id")).otherwise(5000))  # half of them at one time
    e = spark.range(n).select(F.col("id").alias("event_id"), at.alias("ts"), F.lit(55).cast("long").alias("user_id"), F.lit("view").alias("event_type"), F.lit(1.0).alias("value"))
    e.write.parquet(f"{tmp_path}/events.parquet")
    pairs = process.q_pairs(spark, str(tmp_path)).count()
    assert pairs == (n // 2) * (n // 2 - 1) // 2 + (n // 2) * sum(5000 - i <= 3600 for i in range(n // 2))
    assert n <= sum(met) <= 1.1 * n  # were 10 * n: each row, and its copies to nine cells
