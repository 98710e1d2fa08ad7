"""Further preparation, joins and neighbourhoods, and quantities of point processes."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from rategrid.functions.core import ln, rate_of, ratio
from rategrid.operators import joins
from rategrid.operators.quantiles import quantiles
from rategrid.operators.resample import stationary
from rategrid.plans.base import CELLS, EV, GRID, WINS, events, fixed, query, r6
from rategrid.plans.features import CUBE, feature_cube
from rategrid.plans.scores import PRED, RATE, long, predictions
from rategrid.sources.shared import materialize

HOUR = 3_600_000_000


@query(f"""WITH {EV}, v AS (SELECT id, mag, mag + (id % 7) * 0.02::DOUBLE AS mw, mag + (id % 3) * 0.03::DOUBLE AS ml FROM ev)
SELECT id, CASE WHEN abs(mw - mag) <= 0.05 THEN 'Mw' WHEN abs(ml - mag) <= 0.05 THEN 'ML' ELSE 'xM-unknown' END AS kind FROM v""")
def q_type_infer(spark, sf):
    v = events(spark, sf).select("id", "mag", (F.col("mag") + F.col("id") % 7 * 0.02).alias("mw"), (F.col("mag") + F.col("id") % 3 * 0.03).alias("ml"))
    near = lambda c, name: F.when(F.abs(F.col(c) - F.col("mag")) <= 0.05, name)
    return v.select("id", F.coalesce(near("mw", "Mw"), near("ml", "ML"), F.lit("xM-unknown")).alias("kind"))


@query(f"""WITH {EV} SELECT id, {r6("mag")} AS mag FROM ev WHERE win BETWEEN 9 AND 10 AND ir BETWEEN 2 AND 6 ORDER BY ev.mag DESC, id LIMIT 1""")
def q_anchor(spark, sf):
    near = events(spark, sf).filter(F.col("win").between(9, 10) & F.col("ir").between(2, 6))
    top = near.agg(F.max(F.struct("mag", (-F.col("id")).alias("n"))).alias("m")).filter("m IS NOT NULL")
    return top.select((-F.col("m.n")).alias("id"), fixed(F.col("m.mag")).alias("mag"))


@query(f"""WITH {EV} SELECT a.id FROM ev a WHERE a.id % 10 = 0 AND NOT EXISTS (SELECT 1 FROM ev b WHERE b.id % 10 <> 0 AND b.ir = a.ir AND b.ic = a.ic
AND a.t_us BETWEEN b.t_us - {HOUR} AND b.t_us + {HOUR})""")
def q_novelty_anti(spark, sf):
    e = events(spark, sf).select("id", "ir", "ic", "t_us")
    known = e.filter("id % 10 <> 0").select("ir", "ic", (F.col("t_us") - HOUR).alias("low"), (F.col("t_us") + HOUR + 1).alias("high"))
    return joins.range_join(e.filter("id % 10 = 0"), known, "t_us", "low", "high", 4 * HOUR, ("ir", "ic"), "left_anti").select("id")


@query(f"""WITH {EV}, p AS (SELECT a.id, b.id AS other, b.t_us - a.t_us AS residual FROM ev a JOIN ev b ON a.ir = b.ir AND a.ic = b.ic AND a.id <> b.id
AND b.t_us >= a.t_us - {4 * HOUR} AND b.t_us < a.t_us + {4 * HOUR})
SELECT id, other, residual FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY abs(residual), other) AS n FROM p) WHERE n = 1""")
def q_nearest_time(spark, sf):
    return nearest_times(spark, sf)


def nearest_times(spark, sf, carry=()):
    """id, ``carry``, other, residual: for every event the one nearest in time in its cell, within four hours."""
    return joins.nearest_other(events(spark, sf), "id", "t_us", ["ir", "ic"], 4 * HOUR, 4 * HOUR, carry)


@query(f"""WITH {EV}, p AS (SELECT a.id, a.win, b.id AS other, b.t_us - a.t_us AS residual FROM ev a JOIN ev b ON a.ir = b.ir AND a.ic = b.ic AND a.id <> b.id
AND b.t_us >= a.t_us - {4 * HOUR} AND b.t_us < a.t_us + {4 * HOUR}), n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY abs(residual), other) AS n FROM p)
SELECT (win >= 15)::INT AS late, count(*)::BIGINT AS n, {r6("quantile_cont(residual, 0.5)")} AS median_us, max(abs(residual))::BIGINT AS max_us FROM n WHERE n = 1 GROUP BY 1""")
def q_residual_seasons(spark, sf):
    """The residuals of the nearest matches by season: count, median and largest."""
    r = materialize(nearest_times(spark, sf, ("win",)).select((F.col("win") >= 15).cast("int").alias("late"), "residual"), "residuals")
    middle = quantiles(r, ["late"], "residual", [0.5]).select("late", fixed(F.col("p")[0]).alias("median_us"))
    return r.groupBy("late").agg(F.count("*").alias("n"), F.max(F.abs("residual")).alias("max_us")).join(middle, "late").select("late", "n", "median_us", "max_us")


@query(f"WITH {EV} SELECT id, {r6('t_us::DOUBLE / 86400000000')} AS days FROM ev")
def q_days(spark, sf):
    return events(spark, sf).select("id", fixed(F.col("t_us") / 86_400_000_000.0).alias("days"))


@query("""WITH b AS (SELECT min(o_orderdate)::DATE AS a, max(o_orderdate)::DATE AS z FROM orders), w AS (SELECT unnest(range((z - a) // 30)) AS k, a FROM b), n AS (SELECT (o_orderdate::DATE - a) // 30 AS k, count(*) AS n FROM orders, b GROUP BY 1)
SELECT w.k::INT AS k, (a + (30 * w.k)::INT)::DATE AS t0, coalesce(n, 0)::BIGINT AS n FROM w LEFT JOIN n USING (k)""")
def q_windows(spark, sf):
    """Windows of 30 days from the first day of a table on, as far as whole ones go, and the rows in each."""
    o = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderdate").cast("date").alias("d"))
    b = o.agg(F.min("d").alias("a"), F.max("d").alias("z"))  # one row
    n = o.crossJoin(F.broadcast(b)).groupBy(F.floor(F.datediff("d", "a") / 30).cast("int").alias("k")).agg(F.count("*").alias("n"))
    whole = F.floor(F.datediff("z", "a") / 30).cast("int")
    w = b.filter(whole > 0).select("a", F.explode(F.sequence(F.lit(0), whole - 1)).alias("k"))
    return w.join(n, "k", "left").select("k", F.date_add("a", F.col("k") * 30).alias("t0"), F.coalesce("n", F.lit(0)).alias("n"))


@query(f"WITH {EV} SELECT id, {r6('(ic + (user_id % 5) / 10.0::DOUBLE - 7) * 111.19::DOUBLE * cos(radians(40.75::DOUBLE))')} AS x, {r6('(ir + (user_id % 7) / 10.0::DOUBLE - 5) * 111.19::DOUBLE')} AS y FROM ev")
def q_project(spark, sf):
    """Events' places in km from the region's centre, on a flat earth."""
    col, row = F.col("ic") + F.col("user_id") % 5 / 10.0, F.col("ir") + F.col("user_id") % 7 / 10.0
    return events(spark, sf).select("id", fixed((col - 7) * 111.19 * F.cos(F.radians(F.lit(40.75)))).alias("x"), fixed((row - 5) * 111.19).alias("y"))


@query(f"""WITH {EV}, {CELLS}, n AS (SELECT win // 3 AS k, ir, ic, count(*)::BIGINT AS n FROM ev WHERE mag >= 2.5 GROUP BY ALL)
SELECT w.range::INT AS k, c.ir, c.ic, coalesce(n, 0)::BIGINT AS n, (n IS NOT NULL)::INT AS y FROM range(10) w CROSS JOIN cells c LEFT JOIN n ON n.k = w.range AND n.ir = c.ir AND n.ic = c.ic""")
def q_targets(spark, sf):
    hit = events(spark, sf).filter("mag >= 2.5").groupBy(F.floor(F.col("win") / 3).cast("int").alias("k"), "ir", "ic").agg(F.count("*").alias("n"))
    every = spark.range(10).select(F.col("id").cast("int").alias("k")).crossJoin(F.broadcast(GRID.cells(spark)))
    return every.join(hit, ["k", "ir", "ic"], "left").select("k", "ir", "ic", F.coalesce("n", F.lit(0)).alias("n"), F.col("n").isNotNull().cast("int").alias("y"))


@query(f"""WITH {EV}, {CELLS}, {WINS}, d AS (SELECT ir, ic, win, max(mag) AS top FROM ev GROUP BY ALL)
SELECT w.win AS "window", c.ir, c.ic, {r6("coalesce((SELECT max(top) FROM d WHERE d.ir = c.ir AND d.ic = c.ic AND d.win < w.win), 0)")} AS top FROM wins w CROSS JOIN cells c""")
def q_prefix_max(spark, sf):
    d = events(spark, sf).groupBy("ir", "ic", F.col("win").alias("window")).agg(F.max("mag").alias("top"))
    every = spark.range(30).select(F.col("id").cast("int").alias("window")).crossJoin(F.broadcast(GRID.cells(spark)))
    before = Window.partitionBy("ir", "ic").orderBy("window").rowsBetween(Window.unboundedPreceding, -1)
    return every.join(d, ["window", "ir", "ic"], "left").withColumn("top", fixed(F.coalesce(F.max("top").over(before), F.lit(0.0)))).filter("window >= 7")


@query(f"WITH {EV} SELECT id, {r6('mag - lag(mag) OVER (PARTITION BY user_id ORDER BY t_us, id)')} AS step FROM ev")
def q_lag_diff(spark, sf):
    w = Window.partitionBy("user_id").orderBy("t_us", "id")
    return events(spark, sf).select("id", fixed(F.col("mag") - F.lag("mag").over(w)).alias("step"))


@query(f"""WITH {EV}, {CELLS}, n AS (SELECT ir, ic, count(*) AS n FROM ev GROUP BY ALL)
SELECT c.ir, c.ic, {r6("sum(n * exp(-((n.ir - c.ir) ** 2 + (n.ic - c.ic) ** 2)::DOUBLE / 2) / (2 * pi()))")} AS density FROM cells c JOIN n ON abs(n.ir - c.ir) <= 4 AND abs(n.ic - c.ic) <= 4 GROUP BY ALL""")
def q_smoothed(spark, sf):
    n = events(spark, sf).groupBy("ir", "ic").agg(F.count("*").alias("n")).withColumn("r0", F.col("ir")).withColumn("c0", F.col("ic"))
    d2 = F.pow(F.col("ir") - F.col("r0"), F.lit(2)) + F.pow(F.col("ic") - F.col("c0"), F.lit(2))
    return GRID.neighbours(n, 4).groupBy("ir", "ic").agg(fixed(F.sum(F.col("n") * F.exp(-d2 / 2) / (2 * F.pi()))).alias("density"))


@query(f"""WITH {EV} SELECT a.id AS earlier, b.id AS later, b.t_us - a.t_us AS dt FROM ev a JOIN ev b ON abs(a.ir - b.ir) <= 1 AND abs(a.ic - b.ic) <= 1
AND b.t_us > a.t_us AND b.t_us <= a.t_us + {HOUR}""")
def q_pairs(spark, sf):
    return joins.pairs_after(events(spark, sf), "id", "t_us", HOUR)


@query(f"""WITH {EV}, p AS (SELECT id AS place, ir AS r, ic AS c FROM ev WHERE mag >= 3.4), d AS (SELECT e.id, p.place, sqrt(((e.ic - p.c) * 85.0::DOUBLE) ** 2 + ((e.ir - p.r) * 111.0::DOUBLE) ** 2) AS km FROM ev e, p WHERE e.id <> p.place AND e.mag >= 3.2)
SELECT id, count(*)::BIGINT AS near, {r6("min(km)")} AS nearest FROM d WHERE km <= 250 GROUP BY id""")
def q_within_km(spark, sf):
    """Large events within 250 km of a larger one: how many, and the nearest.  Places are counted by cell, and a cell meets those within reach."""
    e = events(spark, sf)
    places = e.filter("mag >= 3.4").groupBy(F.col("ir").alias("r"), F.col("ic").alias("c")).agg(F.count("*").alias("n"))
    near = GRID.neighbours(places.withColumn("ir", F.col("r")).withColumn("ic", F.col("c")), 2)
    km = F.sqrt(F.pow((F.col("ic") - F.col("c")) * 85.0, F.lit(2)) + F.pow((F.col("ir") - F.col("r")) * 111.0, F.lit(2)))
    own = F.when((F.col("ir") == F.col("r")) & (F.col("ic") == F.col("c")) & (F.col("mag") >= 3.4), 1).otherwise(0)  # an event is no neighbour of itself
    met = e.filter("mag >= 3.2").join(near, ["ir", "ic"]).withColumn("km", km).filter("km <= 250").withColumn("m", F.col("n") - own).filter("m > 0")
    return met.groupBy("id").agg(F.sum("m").alias("near"), fixed(F.min("km")).alias("nearest"))


@query(f"""WITH {EV}, b AS (SELECT 1 / (avg(mag) - 2.0) AS beta, count(*) AS whole FROM ev WHERE mag >= 2.0), n AS (SELECT floor((mag - 2.0) / 0.1)::INT AS k, count(*) AS n FROM ev WHERE mag >= 2.0 GROUP BY 1)
SELECT r.range::INT AS k, {r6('exp(-beta * r.range / 10) - exp(-beta * (r.range + 1) / 10)')} AS p, {r6('coalesce(n, 0)::DOUBLE / whole')} AS seen FROM range(41) r CROSS JOIN b LEFT JOIN n ON n.k = r.range""")
def q_mag_pmf(spark, sf):
    """Probabilities of magnitude bins at the events' own slope, beside their shares."""
    big = events(spark, sf).filter("mag >= 2.0")
    n = big.groupBy(F.floor((F.col("mag") - 2.0) / 0.1).cast("int").alias("k")).agg(F.count("*").alias("n"), F.sum("mag").alias("s"))
    b = F.broadcast(n.agg((1 / (F.sum("s") / F.sum("n") - 2.0)).alias("beta"), F.sum("n").alias("whole")))  # one row
    bins = spark.range(41).select(F.col("id").cast("int").alias("k")).crossJoin(b).join(n, "k", "left")
    share = lambda k: F.exp(-F.col("beta") * k / 10)
    return bins.select("k", fixed(share(F.col("k")) - share(F.col("k") + 1)).alias("p"), fixed(F.coalesce("n", F.lit(0)) / F.col("whole")).alias("seen"))


@query(f"""WITH {EV}, {WINS}, r AS (SELECT id, t_us::DOUBLE / 86400000000 AS t, mag FROM ev WHERE mag >= 3.2)
SELECT w.win AS "window", {r6("coalesce((SELECT sum(mag * pow(2, -(w.win - t) / 25)) FROM r WHERE t < w.win), 0)")} AS weight FROM wins w""")
def q_halflife_weight(spark, sf):
    """Sums with an exponential memory: each day's sum is brought to one origin, prefix-summed and brought to its window."""
    t = F.col("t_us") / 86_400_000_000.0
    day = events(spark, sf).filter("mag >= 3.2").groupBy(F.col("win").alias("window")).agg(F.sum(F.col("mag") * F.pow(F.lit(2.0), t / 25)).alias("s"))
    every = spark.range(30).select(F.col("id").cast("int").alias("window")).join(day, "window", "left")
    before = Window.orderBy("window").rowsBetween(Window.unboundedPreceding, -1)  # one row a window
    return every.withColumn("weight", fixed(F.coalesce(F.sum("s").over(before), F.lit(0.0)) * F.pow(F.lit(2.0), -F.col("window") / 25))).filter("window >= 7").select("window", "weight")


@query(f"""WITH {EV}, d AS (SELECT mag - lag(mag) OVER (ORDER BY t_us, id) AS step, win >= 15 AS late FROM ev), x AS (SELECT (range + 1) / 10.0::DOUBLE AS delta FROM range(5))
SELECT delta, CASE WHEN grouping(late) = 1 THEN 'all' WHEN late THEN 'late' ELSE 'early' END AS era, count(*)::BIGINT AS n, {r6("0.4342944819032518::DOUBLE / (avg(step) - delta + 0.05::DOUBLE)")} AS b
FROM d, x WHERE step >= delta - 0.000000001 GROUP BY GROUPING SETS ((delta), (delta, late))""")
def q_b_sweep(spark, sf):
    """Slopes from positive steps between successive magnitudes, by least step and era.

    Successive over the whole catalog: events are ordered within days, and a day's first row takes the last magnitude of the day before."""
    e = events(spark, sf).select("win", "t_us", "id", "mag")
    ends = e.groupBy("win").agg(F.max_by("mag", F.struct("t_us", "id")).alias("end"))
    ends = ends.select("win", F.lag("end").over(Window.orderBy("win")).alias("before"))  # one row a day
    step = F.col("mag") - F.coalesce(F.lag("mag").over(Window.partitionBy("win").orderBy("t_us", "id")), F.col("before"))
    d = e.join(F.broadcast(ends), "win").select(step.alias("step"), (F.col("win") >= 15).alias("late"))
    d = d.withColumn("delta", F.explode(F.array(*[F.lit(k / 10) for k in range(1, 6)]))).filter(F.col("step") >= F.col("delta") - 1e-9)
    s = d.groupBy("delta", "late").agg(F.count("*").alias("n"), F.sum("step").alias("s"))  # ten rows, then their totals
    s = s.rollup("delta", "late").agg(F.grouping("late").alias("g"), F.sum("n").alias("n"), F.sum("s").alias("s")).filter("delta IS NOT NULL")
    era = F.when(F.col("g") == 1, "all").when(F.col("late"), "late").otherwise("early")
    return s.select("delta", era.alias("era"), "n", fixed(0.4342944819032518 / (F.col("s") / F.col("n") - F.col("delta") + 0.05)).alias("b"))


_SIMS = f"{EV}, s AS (SELECT id % 20 AS sim, ir, ic, mag FROM ev)"


def _sims(spark, sf):
    return events(spark, sf).select((F.col("id") % 20).alias("sim"), "ir", "ic", "mag")


@query(f"""WITH {_SIMS} SELECT ir, ic, l.level, {r6("count(*)::DOUBLE / 20")} AS lam, {r6("count(DISTINCT sim)::DOUBLE / 20")} AS p FROM s JOIN (VALUES (2.0::DOUBLE), (2.5::DOUBLE), (3.0::DOUBLE)) l(level) ON mag >= level GROUP BY ALL""")
def q_cascade_summary(spark, sf):
    """Rates and occupancies by cell and level: summed per simulation first, so distinct counts shuffle no events."""
    levels = F.filter(F.array(*[F.lit(x) for x in (2.0, 2.5, 3.0)]), lambda x: x <= F.col("mag"))
    per = _sims(spark, sf).withColumn("level", F.explode(levels)).groupBy("ir", "ic", "level", "sim").agg(F.count("*").alias("n"))
    return per.groupBy("ir", "ic", "level").agg(fixed(F.sum("n") / 20.0).alias("lam"), fixed(F.count("*") / 20.0).alias("p"))


@query(f"""WITH {_SIMS}, k(k) AS (VALUES (5), (10), (20)) SELECT k.k::INT AS k, ir, ic, {r6("count(DISTINCT sim)::DOUBLE / k")} AS p, {r6("(count(DISTINCT sim)::DOUBLE + 1) / (k + 2)")} AS shrunk
FROM s JOIN k ON sim < k.k WHERE mag >= 2.5 GROUP BY k.k, ir, ic""")
def q_occupancy_by_k(spark, sf):
    per = _sims(spark, sf).filter("mag >= 2.5").select("ir", "ic", "sim").distinct()
    per = per.withColumn("k", F.explode(F.filter(F.array(*[F.lit(x) for x in (5, 10, 20)]), lambda k: F.col("sim") < k)))
    return per.groupBy("k", "ir", "ic").agg(F.count("*").alias("n")).select("k", "ir", "ic", fixed(F.col("n") / F.col("k")).alias("p"), fixed((F.col("n") + 1) / (F.col("k") + 2)).alias("shrunk"))


@query(f"WITH {_SIMS}, c AS (SELECT ir, ic, sim, count(*) AS n FROM s WHERE mag >= 2.0 GROUP BY ALL) SELECT ir, ic, {r6('sum(1 - pow(1::DOUBLE / 3, n)) / 20')} AS p FROM c GROUP BY ALL")
def q_thinning(spark, sf):
    c = _sims(spark, sf).filter("mag >= 2.0").groupBy("ir", "ic", "sim").agg(F.count("*").alias("n"))
    return c.groupBy("ir", "ic").agg(fixed(F.sum(1 - F.pow(F.lit(1 / 3), F.col("n"))) / 20).alias("p"))


@query(f"WITH {_SIMS} SELECT l.level, {r6('count(DISTINCT sim)::DOUBLE / 20')} AS p FROM s JOIN (VALUES (3.0::DOUBLE), (3.2::DOUBLE)) l(level) ON mag >= level GROUP BY ALL")
def q_regional_exceed(spark, sf):
    top = _sims(spark, sf).groupBy("sim").agg(F.max("mag").alias("top"))
    levels = F.filter(F.array(F.lit(3.0), F.lit(3.2)), lambda x: x <= F.col("top"))
    return top.select(F.explode(levels).alias("level")).groupBy("level").agg(fixed(F.count("*") / 20.0).alias("p"))


@query(f"""WITH {CUBE} SELECT {r6("corr(cnt7, nbr3_cnt7)")} AS near, {r6("sum(cnt7::DOUBLE * nbr3_cnt7) / sum(cnt7::DOUBLE * cnt7)")} AS slope0, {r6("regr_slope(nbr3_cnt7, cnt7)")} AS slope FROM cube""")
def q_leak_corr(spark, sf):
    x, y = F.col("cnt7").cast("double"), F.col("nbr3_cnt7").cast("double")
    varied = (F.stddev_pop(x) > 0) & (F.stddev_pop(y) > 0)
    sums = feature_cube(spark, sf).agg(F.covar_pop(x, y).alias("xy"), F.var_pop(x).alias("xx"), F.var_pop(y).alias("yy"), (F.sum(x * y) / F.sum(x * x)).alias("slope0"), varied.alias("varied"))
    return sums.select(fixed(F.when(F.col("varied"), F.col("xy") / F.sqrt(F.col("xx") * F.col("yy")))).alias("near"), fixed(F.col("slope0")).alias("slope0"), fixed(F.col("xy") / F.col("xx")).alias("slope"))


@query(f"""WITH {PRED} SELECT k."window", k.ir, k.ic, max(y2.y)::INT AS y FROM pred k JOIN pred y2 ON y2."window" = k."window" AND abs(y2.ir - k.ir) <= 1 AND abs(y2.ic - k.ic) <= 1 GROUP BY ALL""")
def q_block_target(spark, sf):
    return GRID.neighbours(predictions(spark, sf).select("window", "ir", "ic", "y"), 1).groupBy("window", "ir", "ic").agg(F.max("y").alias("y"))


@query(f"""WITH {PRED}, l AS (SELECT *, -ln(1 - p) AS lam FROM long), s AS (SELECT model, sum(y)::DOUBLE / sum(lam) AS s FROM l WHERE "window" < 20 GROUP BY model)
SELECT model, "window", {r6("sum(lam) * any_value(s)")} AS expected, sum(y)::BIGINT AS seen FROM l JOIN s USING (model) WHERE "window" >= 20 GROUP BY ALL""")
def q_occ_scalar(spark, sf):
    lam = -ln(1 - F.col("p"))
    per = long(spark, sf).groupBy("model", "window").agg(F.sum(lam).alias("lam"), F.sum("y").alias("seen"))
    scale = per.filter("window < 20").groupBy("model").agg(ratio(F.sum("seen"), F.sum("lam")).alias("s"))
    return per.filter("window >= 20").join(F.broadcast(scale), "model").select("model", "window", fixed(F.col("lam") * F.col("s")).alias("expected"), "seen")


@query(f"""WITH {PRED}, h AS (SELECT model, sum(-ln(1 - p)) / sum(y) AS h FROM long GROUP BY model) SELECT model, {r6("h")} AS h, {r6("h - 1 - ln(h)")} AS a, {r6("1 / h")} AS best FROM h""")
def q_identity(spark, sf):
    h = long(spark, sf).groupBy("model").agg(ratio(F.sum(-ln(1 - F.col("p"))), F.sum("y")).alias("h"))
    return h.select("model", fixed(F.col("h")).alias("h"), fixed(F.col("h") - 1 - ln(F.col("h"))).alias("a"), fixed(ratio(F.lit(1.0), F.col("h"))).alias("best"))


@query(f"""WITH {PRED}, b AS (SELECT *, (range * 0.25::DOUBLE) AS w, pow(-ln(1 - own), 1 - range * 0.25::DOUBLE) * pow(-ln(1 - near), range * 0.25::DOUBLE) AS lam FROM pred, range(5))
SELECT w, {r6("sum(y * ln(lam) - lam)")} AS ll FROM b GROUP BY w""")
def q_blend(spark, sf):
    rate = lambda c: -ln(1 - F.col(c))
    p = predictions(spark, sf).withColumn("w", F.explode(F.array(*[F.lit(k / 4) for k in range(5)])))
    lam = F.pow(rate("own"), 1 - F.col("w")) * F.pow(rate("near"), F.col("w"))
    return p.groupBy("w").agg(fixed(F.sum(F.col("y") * ln(lam) - lam)).alias("ll"))


@query(f"""WITH {PRED}, d AS (SELECT "window", sum(y * (ln({RATE('own')}) - ln({RATE('near')})) - ({RATE('own')} - {RATE('near')})) AS d FROM pred GROUP BY ALL)
SELECT count(*) FILTER (d > 0)::BIGINT AS plus, count(*) FILTER (d < 0)::BIGINT AS minus, {r6("max(abs(d)) / sum(abs(d))")} AS top_share, arg_max("window", (abs(d), -"window"))::INT AS top_window FROM d""")
def q_top_share(spark, sf):
    """Signs of the windows' gains, and the share and the first of the windows with the largest one."""
    per = predictions(spark, sf).groupBy("window").agg(F.sum(_gain()).alias("d"))
    size = F.abs("d")
    return per.agg(F.count_if(F.col("d") > 0).alias("plus"), F.count_if(F.col("d") < 0).alias("minus"), fixed(ratio(F.max(size), F.sum(size))).alias("top_share"), F.max_by("window", F.struct(size, -F.col("window"))).alias("top_window"))


def _gain():
    a, b = rate_of(F.col("own")), rate_of(F.col("near"))
    return F.col("y") * (F.log(a) - F.log(b)) - (a - b)


_HEX = "('0x' || substr(md5(draw || '-' || pos), {}, 8))::BIGINT"
_PLAN = f"""g AS (SELECT d.range AS draw, p.range AS pos FROM range(2000) d, range(23) p), f AS (SELECT *, CASE WHEN pos = 0 OR {_HEX.format(1)} % 3 = 0 THEN pos END AS begun, {_HEX.format(9)} % 23 AS s FROM g),
l AS (SELECT draw, pos, max(begun) OVER (PARTITION BY draw ORDER BY pos ROWS UNBOUNDED PRECEDING) AS begun FROM f), plan AS (SELECT l.draw, (f.s + l.pos - l.begun) % 23 AS place FROM l JOIN f ON f.draw = l.draw AND f.pos = l.begun)"""


@query(f"""WITH {PRED}, d AS (SELECT "window", sum(y * (ln({RATE('own')}) - ln({RATE('near')})) - ({RATE('own')} - {RATE('near')})) AS d, sum(y) AS y FROM pred GROUP BY ALL), {_PLAN},
b AS (SELECT draw, sum(d) / greatest(sum(y), 1)::DOUBLE AS gain FROM plan JOIN d ON d."window" = place + 7 GROUP BY draw)
SELECT {r6("quantile_cont(gain, 0.025)")} AS low, {r6("quantile_cont(gain, 0.975)")} AS high, {r6("avg((gain > 0)::INT)")} AS wins, (quantile_cont(gain, 0.025) > 0 OR quantile_cont(gain, 0.975) < 0) AS excludes_0 FROM b""")
def q_bootstrap_ig(spark, sf):
    """Interval of the gain: windows are summed once and drawn in blocks, the same for both forecasts."""
    per = predictions(spark, sf).groupBy("window").agg(F.sum(_gain()).alias("d"), F.sum("y").alias("y"))
    plan = stationary(spark, 23, 2000)
    draws = plan.join(F.broadcast(per), F.col("window") == F.col("place") + 7).groupBy("draw").agg((F.sum("d") / F.greatest(F.sum("y"), F.lit(1))).alias("gain"))
    low, high = (F.percentile("gain", F.lit(q)) for q in (0.025, 0.975))
    return draws.agg(fixed(low).alias("low"), fixed(high).alias("high"), fixed(F.avg((F.col("gain") > 0).cast("int"))).alias("wins"), ((low > 0) | (high < 0)).alias("excludes_0"))
