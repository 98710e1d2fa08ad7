"""Smaller studies over forecasts and counts."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from rategrid.functions.core import rate_of
from rategrid.plans.base import CELLS, EV, GRID, events, fixed, query, r6
from rategrid.plans.features import CUBE, feature_cube
from rategrid.plans.model import EXPECTED, expected_counts
from rategrid.plans.scores import PRED, RATE, predictions


@query(f"""WITH {EV}, {CELLS}, f AS (SELECT k.ir, k.ic, count(e.id) FILTER (e.win < 15)::DOUBLE AS a, count(e.id) FILTER (e.win >= 15)::DOUBLE AS b FROM cells k LEFT JOIN ev e USING (ir, ic) GROUP BY ALL), r AS (SELECT a, b, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS rb FROM f)
SELECT {r6('corr(ra, rb)')} AS spearman, {r6('corr(a, b)')} AS pearson, {r6('sum(b) / sum(a)')} AS ratio FROM r""")
def q_spearman(spark, sf):
    """Rank and linear correlation of two fields over the lattice, ties at their mean rank, and the ratio of their totals."""
    n = events(spark, sf).groupBy("ir", "ic").agg(F.count_if(F.col("win") < 15).cast("double").alias("a"), F.count_if(F.col("win") >= 15).cast("double").alias("b"))
    f = GRID.cells(spark).join(n, ["ir", "ic"], "left").select(*[F.coalesce(c, F.lit(0.0)).alias(c) for c in "ab"])
    # ranks of distinct values, from how many cells lie below
    ranks = lambda c: f.groupBy(c).agg(F.count("*").alias("n")).select(c, (F.coalesce(F.sum("n").over(Window.orderBy(c).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + (F.col("n") + 1) / 2.0).alias(f"r{c}"))
    r = f.join(F.broadcast(ranks("a")), "a").join(F.broadcast(ranks("b")), "b")  # a row for each value of a lattice of fixed size
    guarded = lambda x, y: F.when((F.stddev_pop(x) > 0) & (F.stddev_pop(y) > 0), F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0)))
    return r.agg(fixed(guarded("ra", "rb")).alias("spearman"), fixed(guarded("a", "b")).alias("pearson"), fixed(F.sum("b") / F.sum("a")).alias("ratio"))


@query(f"""WITH {EXPECTED}, f AS (SELECT "window", stddev_pop(lam) / avg(lam) AS cov FROM expected GROUP BY "window") SELECT "window", {r6('cov')} AS cov, cov > 0.1 AS varies FROM f""")
def q_field_cov(spark, sf):
    """Coefficient of variation of each window's field, and whether it is more than uniform."""
    c = F.stddev_pop("lam") / F.avg("lam")
    return expected_counts(spark, sf).groupBy("window").agg(fixed(c).alias("cov"), (c > 0.1).alias("varies"))


_SPLITS = {"early": ("x.\"window\" < 18", lambda: F.col("window") < 18), "late": ("x.\"window\" >= 18", lambda: F.col("window") >= 18), "south": ("x.ir < 5", lambda: F.col("ir") < 5), "north": ("x.ir >= 5", lambda: F.col("ir") >= 5)}
_OBS = 'o AS (SELECT win AS "window", ir, ic, count(*) AS k FROM ev WHERE mag >= 2.5 GROUP BY ALL)'


def _fcst(spark, sf):
    o = events(spark, sf).filter("mag >= 2.5").groupBy(F.col("win").alias("window"), "ir", "ic").agg(F.count("*").alias("k"))
    return expected_counts(spark, sf).join(o, ["window", "ir", "ic"], "left").withColumn("k", F.coalesce("k", F.lit(0)))


@query(f"WITH {EXPECTED}, {_OBS}, s AS (SELECT " + ", ".join(f"sum(lam) FILTER ({c}) / sum(coalesce(k, 0)) FILTER ({c}) AS {n}" for n, (c, _) in _SPLITS.items()) + f""" FROM expected x LEFT JOIN o USING ("window", ir, ic)), m AS (SELECT *, ({' + '.join(f'abs({n} - 1)' for n in _SPLITS)}) / 4 AS off FROM s)
SELECT {', '.join(f'{r6(n)} AS {n}' for n in _SPLITS)}, {r6('off')} AS off, CASE WHEN off > 0.25 THEN 'biased' WHEN off > 0.1 THEN 'uneven' ELSE 'even' END AS verdict FROM m""")
def q_split_ratio(spark, sf):
    """Forecast over observation on four splits, their mean distance from 1, and a verdict in three steps."""
    s = _fcst(spark, sf).agg(*[(F.sum(F.when(c(), F.col("lam"))) / F.sum(F.when(c(), F.col("k")))).alias(n) for n, (_, c) in _SPLITS.items()])
    s = s.withColumn("off", sum((F.abs(F.col(n) - 1) for n in _SPLITS), F.lit(0.0)) / 4)
    return s.select(*[fixed(F.col(n)).alias(n) for n in (*_SPLITS, "off")], F.when(F.col("off") > 0.25, "biased").when(F.col("off") > 0.1, "uneven").otherwise("even").alias("verdict"))


@query(f"""WITH {EXPECTED}, {_OBS} SELECT coalesce(period, -1) AS period, coalesce(zone, -1) AS zone, {r6('sum(lam)')} AS forecast, sum(k)::BIGINT AS seen FROM (SELECT (x."window" >= 18)::INT AS period, (x.ir < 5)::INT AS zone, lam, coalesce(k, 0) AS k FROM expected x LEFT JOIN o USING ("window", ir, ic)) GROUP BY GROUPING SETS ((period), (zone))""")
def q_split_sets(spark, sf):
    """The same by time and by space apart."""
    f = _fcst(spark, sf).select((F.col("window") >= 18).cast("int").alias("period"), (F.col("ir") < 5).cast("int").alias("zone"), "lam", "k")
    s = f.groupBy("period", "zone").agg(F.sum("lam").alias("lam"), F.sum("k").alias("k"))  # four rows
    both = s.groupingSets([[F.col("period")], [F.col("zone")]], F.col("period"), F.col("zone")).agg(fixed(F.sum("lam")).alias("forecast"), F.sum("k").alias("seen"))
    return both.select(F.coalesce("period", F.lit(-1)).alias("period"), F.coalesce("zone", F.lit(-1)).alias("zone"), "forecast", "seen")


_PROF = f"""{EXPECTED}, {_OBS}, g AS (SELECT n.range AS i, 0.5::DOUBLE + n.range * 0.25::DOUBLE AS n, sum(coalesce(k, 0) * ln(lam * (0.5::DOUBLE + n.range * 0.25::DOUBLE)) - lam * (0.5::DOUBLE + n.range * 0.25::DOUBLE)) AS ll FROM expected x LEFT JOIN o USING ("window", ir, ic), range(16) n GROUP BY n.range),
prof AS (SELECT i, n, 2 * (max(ll) OVER () - ll) AS lr, n >= arg_max(n, ll) OVER () AS above FROM g)"""


@query(f"WITH {_PROF}, p AS (SELECT *, lead(lr) OVER (ORDER BY i) AS after FROM prof) SELECT i, {r6('lr')} AS lr, coalesce(above AND lr <= 2.706 AND after > 2.706, false) AS brackets, coalesce(NOT above OR after >= lr, true) AS monotone FROM p")
def q_lr_profile(spark, sf):
    """Likelihood-ratio profile of a factor: where the one-sided bound lies between two values, and whether it rises beyond the best."""
    n = 0.5 + F.col("i") * 0.25
    # ln(lam n) = ln lam + ln n: three sums give every factor's likelihood
    sums = _fcst(spark, sf).agg(F.sum(F.col("k") * F.log("lam")).alias("a"), F.sum("k").alias("k"), F.sum("lam").alias("lam"))
    g = sums.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(15)))).select(F.col("i").cast("long").alias("i"), (F.col("a") + F.col("k") * F.log(n) - F.col("lam") * n).alias("ll"))
    whole = Window.partitionBy()  # sixteen rows
    best = F.max(F.struct("ll", "i")).over(whole)
    g = g.select("i", (2 * (best["ll"] - F.col("ll"))).alias("lr"), (F.col("i") >= best["i"]).alias("above")).withColumn("after", F.lead("lr").over(Window.orderBy("i")))
    cross = F.col("above") & (F.col("lr") <= 2.706) & (F.col("after") > 2.706)
    return g.select("i", fixed(F.col("lr")).alias("lr"), F.coalesce(cross, F.lit(False)).alias("brackets"), F.coalesce(~F.col("above") | (F.col("after") >= F.col("lr")), F.lit(True)).alias("monotone"))


@query(f"""WITH {EV}, w AS (SELECT 1 / (ln(10) * (avg(mag) - 2.0)) AS cap FROM ev WHERE mag >= 2.0), a AS (SELECT mag_type, 1 / (ln(10) * (avg(mag) FILTER (win < 15) - 2.0)) AS early, 1 / (ln(10) * (avg(mag) FILTER (win >= 15) - 2.0)) AS late FROM ev WHERE mag >= 2.0 GROUP BY mag_type)
SELECT mag_type, {r6('100 * (least(late, cap) - early) / abs(early)')} AS change, {r6('100 * (least(late, cap) - late) / abs(late)')} AS held_back, late >= cap AS pinned FROM a, w""")
def q_rel_change(spark, sf):
    """Slopes of each kind, held at or under that of the whole catalog: their change from the earlier era's and from the free fit in percent, null where
    there is nothing to relate to, and whether they stand at the bound."""
    big, early = events(spark, sf).filter("mag >= 2.0"), F.col("win") < 15
    slope = lambda m: 1 / (F.log(F.lit(10.0)) * (m - 2.0))
    a = big.groupBy("mag_type").agg(slope(F.avg(F.when(early, F.col("mag")))).alias("early"), slope(F.avg(F.when(~early, F.col("mag")))).alias("late"))
    a = a.crossJoin(F.broadcast(big.agg(slope(F.avg("mag")).alias("cap")))).withColumn("held", F.least("late", "cap"))  # one row
    change = lambda x, y: fixed(F.try_divide(100 * (F.col(x) - F.col(y)), F.abs(y)))
    return a.select("mag_type", change("held", "early").alias("change"), change("held", "late").alias("held_back"), (F.col("late") >= F.col("cap")).alias("pinned"))


@query(f"""WITH {CUBE}, s AS (SELECT "window", sum(cnt7)::BIGINT AS n FROM cube GROUP BY ALL), b AS (SELECT arg_max("window", (n, -"window")) AS w FROM s) SELECT ir, ic, cnt7, nbr5_cnt7, (SELECT count(*) FROM ev e, b WHERE e.mag >= 2.0 AND e.win >= b.w - 7 AND e.win < b.w AND e.ir = cube.ir AND e.ic = cube.ic) = cnt7 AS recomputed FROM cube, b WHERE "window" = b.w""")
def q_most_active(spark, sf):
    """The window with most counts, recomputed from the events before it."""
    c = feature_cube(spark, sf)
    w = F.broadcast(c.groupBy("window").agg(F.sum("cnt7").alias("n")).agg(F.max_by("window", F.struct(F.col("n"), -F.col("window"))).alias("window")))
    again = events(spark, sf).filter("mag >= 2.0").join(w, (F.col("win") >= F.col("window") - 7) & (F.col("win") < F.col("window"))).groupBy("ir", "ic").agg(F.count("*").alias("n"))
    return c.join(w, "window").join(again, ["ir", "ic"], "left").select("ir", "ic", "cnt7", "nbr5_cnt7", (F.coalesce("n", F.lit(0)) == F.col("cnt7")).alias("recomputed"))


@query(f"WITH {EV}, h AS (SELECT floor(ln(value / 0.01) / ln(2))::INT AS bin, count(*)::BIGINT AS n FROM ev WHERE value > 0 GROUP BY 1) SELECT bin, n, (sum(n) OVER (ORDER BY bin DESC))::BIGINT AS above, {r6('coalesce(sum(n) OVER (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(n) OVER ()')} AS below FROM h")
def q_log_hist(spark, sf):
    """A histogram over doubling bins, with the rows at or above each and the share below."""
    h = events(spark, sf).filter("value > 0").groupBy(F.floor(F.log(F.col("value") / 0.01) / F.log(F.lit(2.0))).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    up, down = Window.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, Window.currentRow), Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # a row for each bin
    return h.select("bin", "n", F.sum("n").over(up).alias("above"), fixed(F.coalesce(F.sum("n").over(down), F.lit(0)) / F.sum("n").over(Window.partitionBy())).alias("below"))


@query("""WITH t AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="/([^"]+)"', 1)) AS ref FROM pages WHERE html IS NOT NULL), h AS (SELECT DISTINCT url[-3:] AS tail FROM pages), r AS (SELECT page_id, ref, ref IN (SELECT regexp_extract(url, '/([a-z][a-z])/', 1) FROM pages) AS known FROM t) SELECT page_id, count(*)::BIGINT AS refs, count(DISTINCT ref) FILTER (NOT known)::BIGINT AS dangling FROM r GROUP BY page_id""")
def q_regex_gate(spark, sf):
    """References found in text by a pattern, and how many distinct ones of each page resolve to nothing."""
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    refs = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="/([^"]+)"'), 1)).alias("ref")).groupBy("page_id", "ref").agg(F.count("*").alias("n"))
    known = pages.select(F.regexp_extract("url", "/([a-z][a-z])/", 1).alias("ref")).distinct().withColumn("known", F.lit(1))
    return refs.join(known, "ref", "left").groupBy("page_id").agg(F.sum("n").alias("refs"), F.count_if(F.col("known").isNull()).alias("dangling"))


@query(f"""WITH {PRED}, x AS (SELECT pred.*, coalesce(lam, 0) AS lam FROM pred LEFT JOIN (SELECT ir, ic, win + 1 AS "window", count(*)::DOUBLE AS lam FROM ev WHERE mag >= 3.0 GROUP BY ALL) USING ("window", ir, ic)) SELECT "window", ir, ic, {r6('lam')} AS lam, {r6('near')} AS near FROM x""")
def q_rates_join(spark, sf):
    """Rates of another table brought to the forecasts by window and cell, 0 where it has no row."""
    r = events(spark, sf).filter("mag >= 3.0").groupBy((F.col("win") + 1).alias("window"), "ir", "ic").agg(F.count("*").cast("double").alias("lam"))
    return predictions(spark, sf).join(r, ["window", "ir", "ic"], "left").select("window", "ir", "ic", fixed(F.coalesce("lam", F.lit(0.0))).alias("lam"), fixed(F.col("near")).alias("near"))


@query(f"""WITH {PRED}, h AS (SELECT "window", sum({RATE('near')}) AS a, sum({RATE('own')}) AS b FROM pred GROUP BY "window"), k AS (SELECT win AS "window", count(*) FILTER (mag >= 2.5)::DOUBLE AS k, count(*) FILTER (mag >= 3.0)::DOUBLE * 10 AS g FROM ev GROUP BY win)
SELECT {r6('sum(k) / sum(a)')} AS near_seen, {r6('sum(g) / sum(a)')} AS near_anchored, {r6('sum(k) / sum(b)')} AS own_seen, {r6('sum(g) / sum(b)')} AS own_anchored FROM h JOIN k USING ("window")""")
def q_count_attribution(spark, sf):
    """Two forecasts beside two observations: counts as seen, and counts scaled down from where the catalog is complete."""
    h = predictions(spark, sf).groupBy("window").agg(F.sum(rate_of(F.col("near"))).alias("a"), F.sum(rate_of(F.col("own"))).alias("b"))
    k = events(spark, sf).groupBy(F.col("win").alias("window")).agg(F.count_if(F.col("mag") >= 2.5).alias("k"), (F.count_if(F.col("mag") >= 3.0) * 10).alias("g"))
    s = h.join(k, "window")
    q = lambda x, y: fixed(F.sum(x) / F.sum(y))
    return s.agg(q("k", "a").alias("near_seen"), q("g", "a").alias("near_anchored"), q("k", "b").alias("own_seen"), q("g", "b").alias("own_anchored"))
