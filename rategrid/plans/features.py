"""The feature cube, aggregations and magnitude slopes."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from rategrid.operators.features import cube
from rategrid.operators.quantiles import quantiles
from rategrid.operators.sequences import steps
from rategrid.plans.base import CELLS, EV, GRID, WINS, events, fixed, query, r6

MC = 2.0
CUBE = f"""{EV}, {CELLS}, {WINS},
day AS (SELECT ir, ic, win, count(*) FILTER (mag >= 2.0) AS n, max(mag) AS top, sum(value) FILTER (mag >= 2.0) AS value, max(t_us) FILTER (mag >= 2.5) AS last0, max(t_us) FILTER (mag >= 3.2) AS last1 FROM ev GROUP BY ALL),
own AS (SELECT w.win AS "window", ir, ic, sum(n) FILTER (w.win - d.win <= 1) AS cnt1, sum(n) FILTER (w.win - d.win <= 3) AS cnt3, sum(value) FILTER (w.win - d.win <= 3) AS value,
  sum(n) FILTER (w.win - d.win <= 7) AS cnt7, max(top) FILTER (w.win - d.win <= 7) AS top, max(last0) AS last0, max(last1) AS last1
  FROM wins w JOIN day d ON d.win < w.win GROUP BY ALL),
n3 AS (SELECT o."window", c.ir, c.ic, sum(cnt1) AS nbr3_cnt1, sum(cnt7) AS nbr3_cnt7 FROM cells c JOIN own o ON abs(o.ir - c.ir) <= 1 AND abs(o.ic - c.ic) <= 1 GROUP BY ALL),
n5 AS (SELECT o."window", c.ir, c.ic, sum(cnt1) AS nbr5_cnt1, sum(cnt7) AS nbr5_cnt7, max(top) AS maxmag, max(last0) AS last0, max(last1) AS last1 FROM cells c JOIN own o ON abs(o.ir - c.ir) <= 2 AND abs(o.ic - c.ic) <= 2 GROUP BY ALL),
hit AS (SELECT DISTINCT win AS "window", ir, ic FROM ev WHERE mag >= 2.5),
whole AS (SELECT w.win AS "window", sum(value) FILTER (w.win - d.win <= 3) / nullif(sum(n) FILTER (w.win - d.win <= 3), 0) AS recent, sum(value) / nullif(sum(n), 0) AS ever FROM wins w LEFT JOIN day d ON d.win < w.win GROUP BY ALL),
cube AS (SELECT w.win AS "window", c.ir, c.ic, coalesce(cnt1, 0)::BIGINT AS cnt1, coalesce(cnt3, 0)::BIGINT AS cnt3, coalesce(cnt7, 0)::BIGINT AS cnt7, coalesce(nbr3_cnt1, 0)::BIGINT AS nbr3_cnt1,
  coalesce(nbr3_cnt7, 0)::BIGINT AS nbr3_cnt7, coalesce(nbr5_cnt1, 0)::BIGINT AS nbr5_cnt1, coalesce(nbr5_cnt7, 0)::BIGINT AS nbr5_cnt7, coalesce(n5.maxmag, 0) AS maxmag,
  least(30.0::DOUBLE, coalesce(w.win - n5.last0::DOUBLE / 86400000000, 30.0::DOUBLE)) AS days_since0, least(30.0::DOUBLE, coalesce(w.win - n5.last1::DOUBLE / 86400000000, 30.0::DOUBLE)) AS days_since1,
  coalesce(o.value / nullif(cnt3, 0), recent, ever, 10.0::DOUBLE) AS mean_value, (h.ir IS NOT NULL)::INT AS y,
  coalesce(cnt1, 0)::DOUBLE / (coalesce(cnt7, 0)::DOUBLE / 7.0::DOUBLE + 0.1::DOUBLE) AS rate_ratio
  FROM wins w CROSS JOIN cells c JOIN whole ON whole."window" = w.win LEFT JOIN own o ON o."window" = w.win AND o.ir = c.ir AND o.ic = c.ic
  LEFT JOIN n3 ON n3."window" = w.win AND n3.ir = c.ir AND n3.ic = c.ic LEFT JOIN n5 ON n5."window" = w.win AND n5.ir = c.ir AND n5.ic = c.ic
  LEFT JOIN hit h ON h."window" = w.win AND h.ir = c.ir AND h.ic = c.ic)"""
REAL = ("maxmag", "days_since0", "days_since1", "mean_value", "rate_ratio")


def feature_cube(spark, sf):
    return cube(spark, events(spark, sf), GRID, 7, 29, MC)


@query(f"WITH {EV}, {CELLS} SELECT c.ir, c.ic, count(e.id)::BIGINT AS n FROM cells c LEFT JOIN ev e ON e.ir = c.ir AND e.ic = c.ic AND e.mag >= 2.5 GROUP BY ALL")
def q_count_grid(spark, sf):
    n = events(spark, sf).filter("mag >= 2.5").groupBy("ir", "ic").agg(F.count("*").alias("n"))
    return GRID.cells(spark).join(n, ["ir", "ic"], "left").select("ir", "ic", F.coalesce("n", F.lit(0)).alias("n"))


@query(f"""WITH {EV}, {CELLS}, own AS (SELECT ir, ic, avg(value) AS v FROM ev WHERE win >= 27 GROUP BY ALL), reg AS (SELECT avg(value) AS v FROM ev WHERE win >= 27)
SELECT c.ir, c.ic, {r6("coalesce(own.v, reg.v, 10.0)")} AS mean_value FROM cells c LEFT JOIN own ON own.ir = c.ir AND own.ic = c.ic, reg""")
def q_mean_depth(spark, sf):
    late = events(spark, sf).filter("win >= 27")
    own, whole = late.groupBy("ir", "ic").agg(F.avg("value").alias("v")), late.agg(F.avg("value").alias("reg"))
    return GRID.cells(spark).join(own, ["ir", "ic"], "left").crossJoin(F.broadcast(whole)).select("ir", "ic", fixed(F.coalesce("v", "reg", F.lit(10.0))).alias("mean_value"))


@query(f"WITH {EV} SELECT win, count(*) FILTER (mag >= 2.0)::BIGINT AS n20, count(*) FILTER (mag >= 2.5)::BIGINT AS n25, count(*) FILTER (mag >= 3.0)::BIGINT AS n30 FROM ev GROUP BY win")
def q_threshold_counts(spark, sf):
    return events(spark, sf).groupBy("win").agg(*[F.count_if(F.col("mag") >= m).alias(f"n{int(m * 10)}") for m in (2.0, 2.5, 3.0)])


@query(f"WITH {EV} SELECT ir, ic, {r6('count(DISTINCT win)::DOUBLE / 30')} AS p FROM ev WHERE mag >= 2.5 GROUP BY ALL")
def q_occupancy(spark, sf):
    return events(spark, sf).filter("mag >= 2.5").groupBy("ir", "ic").agg(fixed(F.countDistinct("win") / 30).alias("p"))


@query(f"""WITH {EV}, h AS (SELECT floor(mag / 0.1)::BIGINT AS bin, count(*)::BIGINT AS n FROM ev GROUP BY 1) SELECT {r6("(arg_max(bin, (n, -bin)))::DOUBLE * 0.1 + 0.05 + 0.2")} AS mc FROM h""")
def q_mc(spark, sf):
    h = events(spark, sf).groupBy(F.floor(F.col("mag") / 0.1).alias("bin")).agg(F.count("*").alias("n"))
    return h.agg(F.max_by("bin", F.struct(F.col("n"), -F.col("bin"))).alias("b")).select(fixed(F.col("b").cast("double") * 0.1 + 0.05 + 0.2).alias("mc"))


@query(f"""WITH {EV}, h AS (SELECT mag_type, floor(mag / 0.1)::BIGINT AS bin, count(*)::BIGINT AS n FROM ev GROUP BY ALL) SELECT mag_type, bin, n, (sum(n) OVER (PARTITION BY mag_type ORDER BY bin DESC))::BIGINT AS above FROM h""")
def q_fmd(spark, sf):
    h = events(spark, sf).groupBy("mag_type", F.floor(F.col("mag") / 0.1).alias("bin")).agg(F.count("*").alias("n"))
    return h.withColumn("above", F.sum("n").over(Window.partitionBy("mag_type").orderBy(F.desc("bin"))))


@query(f"""WITH {EV}, v AS (SELECT mag_type, CASE WHEN id % 2 = 0 THEN mag ELSE round(mag, 1) END AS mag FROM ev WHERE mag_type <> 'error' UNION ALL SELECT mag_type, round(mag * 10) / 10 FROM ev WHERE mag_type = 'error'),
s AS (SELECT mag_type, count(*) AS n, avg(mag) AS m, bool_and(abs(mag * 10 - round(mag * 10)) < 0.001) AS binned FROM v WHERE mag >= 2.0 GROUP BY mag_type)
SELECT mag_type, CASE WHEN n < 10 THEN 1.0::DOUBLE ELSE {r6("1 / (ln(10) * greatest(m - 2.0 + CASE WHEN binned THEN 0.05 ELSE 0 END, 0.001))")} END AS b FROM s""")
def q_aki_b(spark, sf):
    """Maximum-likelihood slope; where every magnitude lies on a grid of 0.1, half a bin is added."""
    tenths = F.rint(F.col("mag") * 10) / 10
    v = events(spark, sf).withColumn("mag", F.when(F.col("mag_type") == "error", tenths).when(F.col("id") % 2 == 0, F.col("mag")).otherwise(F.round("mag", 1)))
    s = v.filter("mag >= 2.0").groupBy("mag_type").agg(F.count("*").alias("n"), F.avg("mag").alias("m"), F.bool_and(F.abs(F.col("mag") * 10 - F.rint(F.col("mag") * 10)) < 0.001).alias("binned"))
    b = fixed(1 / (F.log(F.lit(10.0)) * F.greatest(F.col("m") - 2.0 + F.when(F.col("binned"), 0.05).otherwise(0.0), F.lit(0.001))))
    return s.select("mag_type", F.when(F.col("n") < 10, F.lit(1.0)).otherwise(b).alias("b"))


@query(f"""WITH {EV}, d AS (SELECT ic, mag - lag(mag) OVER (PARTITION BY ic ORDER BY t_us, id) AS d FROM ev) SELECT ic, count(*)::BIGINT AS n, CASE WHEN count(*) >= 30 THEN {r6("1 / (ln(10) * (avg(d) - 0.1))")} END AS b FROM d WHERE d >= 0.2 GROUP BY ic""")
def q_b_positive(spark, sf):
    d = steps(events(spark, sf), "mag", ["ic"]).select("ic", F.col("step").alias("d"))
    return d.filter("d >= 0.2").groupBy("ic").agg(F.count("*").alias("n"), F.when(F.count("*") >= 30, fixed(1 / (F.log(F.lit(10.0)) * (F.avg("d") - 0.1)))).alias("b"))


@query(f"WITH {EV}, n AS (SELECT win // 10 AS era, count(*) FILTER (mag >= 2.0) AS a, count(*) FILTER (mag >= 2.5) AS b FROM ev GROUP BY 1) SELECT era, {r6('log10(a::DOUBLE / b::DOUBLE) / 0.5')} AS slope FROM n WHERE b > 0")
def q_b_two_count(spark, sf):
    n = events(spark, sf).groupBy(F.floor(F.col("win") / 10).cast("int").alias("era")).agg(F.count_if(F.col("mag") >= 2.0).alias("a"), F.count_if(F.col("mag") >= 2.5).alias("b"))
    return n.filter("b > 0").select("era", fixed(F.log10(F.col("a") / F.col("b")) / 0.5).alias("slope"))


@query(f"""WITH {EV} SELECT coalesce((win < 15)::INT, -1)::INT AS early, coalesce((ir < 5)::INT, -1)::INT AS south, count(*)::BIGINT AS n, {r6("avg(mag)")} AS mean_mag FROM ev GROUP BY CUBE (win < 15, ir < 5)""")
def q_quadrants(spark, sf):
    e = events(spark, sf).withColumn("early", F.col("win") < 15).withColumn("south", F.col("ir") < 5)
    sets = e.cube("early", "south").agg(F.count("*").alias("n"), fixed(F.avg("mag")).alias("mean_mag"))
    flag = lambda c: F.coalesce(F.col(c).cast("int"), F.lit(-1)).alias(c)  # noqa: E731  -1: all
    return sets.select(flag("early"), flag("south"), "n", "mean_mag")


@query(f"WITH {EV} SELECT mag_type, {r6('quantile_cont(mag, 0.05)')} AS p05, {r6('quantile_cont(mag, 0.5)')} AS p50, {r6('quantile_cont(mag, 0.95)')} AS p95 FROM ev GROUP BY mag_type")
def q_percentiles(spark, sf):
    p = quantiles(events(spark, sf), ["mag_type"], "mag", [0.05, 0.5, 0.95])
    return p.select("mag_type", *[fixed(F.col("p")[i]).alias(n) for i, n in enumerate(("p05", "p50", "p95"))])


@query(f"WITH {EV}, n AS (SELECT ic, count(*)::DOUBLE AS n FROM ev GROUP BY ic), t AS (SELECT sum(n) AS s, count(*)::DOUBLE AS k FROM n) SELECT ic, {r6('(s - n) / (k - 1)')} AS left_out FROM n, t WHERE k > 1")
def q_jackknife(spark, sf):
    n = events(spark, sf).groupBy("ic").agg(F.count("*").cast("double").alias("n"))
    t = n.agg(F.sum("n").alias("s"), F.count("*").cast("double").alias("k"))
    return n.crossJoin(F.broadcast(t)).filter("k > 1").select("ic", fixed((F.col("s") - F.col("n")) / (F.col("k") - 1)).alias("left_out"))


@query(f'WITH {CUBE} SELECT ic, {r6("regr_slope(cnt7::DOUBLE, cnt3::DOUBLE)")} AS slope, {r6("sum(cnt3 * cnt7)::DOUBLE / nullif(sum(cnt3 * cnt3), 0)::DOUBLE")} AS slope0 FROM cube GROUP BY ic HAVING stddev_pop(cnt3) > 0')
def q_ols_slope(spark, sf):
    x, y = F.col("cnt3").cast("double"), F.col("cnt7").cast("double")
    c = feature_cube(spark, sf).groupBy("ic").agg(F.stddev_pop("cnt3").alias("sd"), F.regr_slope(y, x).alias("slope"), (F.sum(x * y) / F.nullif(F.sum(x * x), F.lit(0.0))).alias("slope0"))
    return c.filter("sd > 0").select("ic", fixed(F.col("slope")).alias("slope"), fixed(F.col("slope0")).alias("slope0"))


@query(f"""WITH {EV} SELECT "ic", id, t_us FROM (SELECT ic, id, t_us, row_number() OVER (PARTITION BY ic ORDER BY t_us DESC, id DESC) AS k FROM ev) WHERE k <= 5""")
def q_tail_n(spark, sf):
    """The last five of each group: first of each day in a group, then of those."""
    last = lambda *by: Window.partitionBy(*by).orderBy(F.desc("t_us"), F.desc("id"))
    few = events(spark, sf).select("ic", "id", "t_us", "win").withColumn("k", F.row_number().over(last("ic", "win"))).filter("k <= 5")
    return few.withColumn("k", F.row_number().over(last("ic"))).filter("k <= 5").select("ic", "id", "t_us")


@query(f"WITH {EV}, {CELLS}, n AS (SELECT ir, ic, count(*) AS n FROM ev GROUP BY ALL) SELECT a.ir, a.ic, {r6('sum(b.n * exp(-0.5 * ((a.ir-b.ir)*(a.ir-b.ir) + (a.ic-b.ic)*(a.ic-b.ic))::DOUBLE / 4.0::DOUBLE))')} AS rate FROM cells a, n b GROUP BY ALL")
def q_kernel_rate(spark, sf):
    n = events(spark, sf).groupBy(F.col("ir").alias("jr"), F.col("ic").alias("jc")).agg(F.count("*").alias("n"))  # a row for each of 150 cells
    r2 = (F.col("ir") - F.col("jr")) ** 2 + (F.col("ic") - F.col("jc")) ** 2
    return GRID.cells(spark).crossJoin(F.broadcast(n)).groupBy("ir", "ic").agg(fixed(F.sum(F.col("n") * F.exp(-0.5 * r2 / 4.0))).alias("rate"))
