import random

from pyspark.sql import functions as F

from rategrid.functions.core import moment_magnitude
from rategrid.operators import catalog, joins, metrics, sequences
from rategrid.operators.features import cube
from rategrid.operators.lattice import Lattice

GRID = Lattice(3, 4)
DAY = 86_400_000_000


def some_events(spark, n=300, seed=1):
    r = random.Random(seed)
    rows = [(i, r.randrange(10 * DAY), 1 + 2 * r.random(), r.randrange(3), r.randrange(4)) for i in range(n)]
    return spark.createDataFrame([(*x, x[1] // DAY, float(x[0] % 7)) for x in rows], "id long, t_us long, mag double, ir int, ic int, win int, value double")


def test_features_do_not_see_the_future(spark):
    e = some_events(spark)
    whole = cube(spark, e, GRID, 5, 9, 2.0).drop("y").collect()
    for k in range(5, 10):
        cut = cube(spark, e.filter(F.col("t_us") < k * DAY), GRID, 5, 9, 2.0).drop("y").filter(F.col("window") == k).collect()
        assert sorted(r for r in whole if r["window"] == k) == sorted(cut)


def test_cube_of_no_events_is_all_zero(spark):
    rows = cube(spark, some_events(spark).limit(0), GRID, 7, 7, 2.0).collect()
    assert len(rows) == 12 and all(r["cnt7"] == 0 and r["days_since0"] == 30 and r["mean_value"] == 10 and r["y"] == 0 for r in rows)


def test_a_dropped_repeat_drops_no_other(spark):
    rows = [(1, 0, 2.0, 0), (2, 8, 2.0, 0), (3, 16, 2.0, 0), (4, 16, 2.9, 0), (5, 16, 2.0, 1)]
    df = spark.createDataFrame(rows, "id long, t_us long, mag double, ic int")
    assert sorted(r["id"] for r in catalog.drop_near_repeats(df, ["ic"], 10, 0.5).collect()) == [1, 3, 4, 5]


def test_greedy_walk_by_blocks_is_that_of_whole_groups(spark):
    """Dense events, where every kept row depends on those before, over many blocks and from wrong guesses."""
    r = random.Random(12)
    rows = [(i, r.randrange(60_000), 2 + 0.3 * r.random(), i % 2) for i in range(3000)]
    want, kept = [], {0: [], 1: []}
    for i, t, m, g in sorted(rows, key=lambda x: (x[1], x[0])):
        if all(t - a > 100 or abs(m - b) > 0.05 for a, b in kept[g][-40:]):
            kept[g].append((t, m))
            want.append(i)
    df = spark.createDataFrame(rows, "id long, t_us long, mag double, ic int")
    assert sorted(x["id"] for x in catalog.drop_near_repeats(df, ["ic"], 100, 0.05, 300).collect()) == sorted(want)


def test_surface_wave_gap_gives_null(spark):
    df = spark.createDataFrame([("Ms", 5.45), (" MS ", 5.4), (None, 3.0)], "k string, m double")
    got = [r[0] for r in df.select(moment_magnitude(F.col("k"), F.col("m"))).collect()]
    assert got[0] is None and abs(got[1] - (0.5716 * 5.4 + 2.498)) < 1e-12 and abs(got[2] - (0.8095 * 3 + 1.3003)) < 1e-12


def test_range_join_is_half_open(spark):
    e = spark.createDataFrame([(0,), (5,), (10,)], "t long")
    p = spark.createDataFrame([(5, 10)], "low long, high long")
    assert [r["t"] for r in joins.range_join(e, p, "t", "low", "high", 4).collect()] == [5]


def test_as_of_does_not_see_its_own_time(spark):
    e = spark.createDataFrame([("a", 1, 1.0), ("a", 5, 2.0)], "k string, t long, v double")
    p = spark.createDataFrame([("a", 1), ("a", 5), ("a", 6), ("b", 9)], "k string, t long")
    assert {(r["k"], r["t"]): r["last_value"] for r in joins.as_of(e, p, "t", "v", ["k"], 4).collect()} == {("a", 1): None, ("a", 5): 1.0, ("a", 6): 2.0, ("b", 9): None}


def test_sequences_by_blocks_see_what_whole_groups_do(spark):
    e = some_events(spark, 400, 3)
    rows = sorted(e.collect(), key=lambda r: (r["ic"], r["t_us"], r["id"]))
    want = {b["id"]: b["mag"] - a["mag"] if a["ic"] == b["ic"] else None for a, b in zip([rows[0], *rows], rows)} | {rows[0]["id"]: None}
    assert {r["id"]: r["step"] for r in sequences.steps(e, "mag", ["ic"]).collect()} == want
    reach = DAY // 3
    counts = {r["id"]: sum(q["ic"] == r["ic"] and r["t_us"] - reach <= q["t_us"] < r["t_us"] for q in rows) for r in rows}
    assert {r["id"]: r["n"] for r in sequences.trailing_count(e, ["ic"], reach, DAY // 2).collect()} == counts


def test_nearest_widens_its_ring(spark):
    r = random.Random(4)
    points = [(i, r.uniform(-5, 5), r.uniform(-5, 5)) for i in range(60)] + [(60, 400.0, -300.0)]
    spots = [(i, r.uniform(-5, 5), r.uniform(-5, 5)) for i in range(9)] + [(9, 0.5, 0.5), (8, 0.5, 0.5)]
    got = joins.nearest(spark.createDataFrame(points, "p long, x double, y double"), spark.createDataFrame(spots, "s long, x double, y double"), "p", "s", 0.4).collect()
    want = {p: min(((x - a) ** 2 + (y - b) ** 2, s) for s, a, b in spots)[1] for p, x, y in points}
    assert {q["p"]: q["s"] for q in got} == want


def test_components(spark):
    nodes = spark.createDataFrame([(i,) for i in range(6)], "id long")
    edges = spark.createDataFrame([(0, 1), (1, 2), (4, 5)], "a long, b long")
    assert {r["id"]: r["cluster"] for r in catalog.clusters(nodes, edges).collect()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4, 5: 4}


def test_tied_scores_count_together(spark):
    df = spark.createDataFrame([(1, 0.5), (0, 0.5), (1, 0.9), (0, 0.1)], "y int, p double")
    r = metrics.ranking(df.withColumn("g", F.lit(1)), ["g"]).first()
    assert abs(r["roc_auc"] - 0.875) < 1e-12 and abs(r["average_precision"] - (0.5 + 0.5 * 2 / 3)) < 1e-12
    one = metrics.ranking(df.filter("y = 1").withColumn("g", F.lit(1)), ["g"]).first()
    assert one["roc_auc"] is None
