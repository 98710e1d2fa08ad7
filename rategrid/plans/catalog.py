"""Catalog preparation, bucketing and joins."""

from pyspark.sql import functions as F

from rategrid.functions.core import decimal_year, moment_magnitude
from rategrid.operators import catalog, joins
from rategrid.operators.sequences import trailing_count
from rategrid.plans.base import CELLS, EV, GRID, US_PER_DAY, events, fixed, query, r6

_KIND = "CASE mag_type WHEN 'click' THEN 'Mw' WHEN 'view' THEN ' ML ' WHEN 'purchase' THEN 'Md' WHEN 'signup' THEN 'Ms' ELSE 'Mb' END"


def _kind():
    m = F.col("mag_type")
    return F.when(m == "click", "Mw").when(m == "view", " ML ").when(m == "purchase", "Md").when(m == "signup", "Ms").otherwise("Mb")


@query(f"""WITH {EV}, k AS (SELECT id, lower(trim({_KIND})) AS k, mag + 3 AS m FROM ev)
SELECT id, {r6("CASE WHEN k='mw' THEN m WHEN k='md' THEN 0.7947*m+1.3420 WHEN k='ms' AND m<=5.4 THEN 0.5716*m+2.4980 WHEN k='ms' AND m>=5.5 THEN 0.8126*m+1.1723 WHEN k='ms' THEN NULL WHEN k='mb' THEN 1.0319*m+0.0223 ELSE 0.8095*m+1.3003 END")} AS mag_w FROM k""")
def q_mag_homogenize(spark, sf):
    return events(spark, sf).select("id", fixed(moment_magnitude(_kind(), F.col("mag") + 3)).alias("mag_w"))


@query(f"""WITH {EV} SELECT id, try_cast(nullif(nullif(v, '-.-'), '0.0') AS DOUBLE) AS x FROM (SELECT id, CASE WHEN id % 5 = 0 THEN '-.-' WHEN id % 7 = 0 THEN '0.0' WHEN id % 11 = 0 THEN '' ELSE (id % 90)::VARCHAR || '.5' END AS v FROM ev)""")
def q_parse_null(spark, sf):
    i = F.col("id")
    v = F.when(i % 5 == 0, "-.-").when(i % 7 == 0, "0.0").when(i % 11 == 0, "").otherwise(F.concat((i % 90).cast("string"), F.lit(".5")))
    return events(spark, sf).withColumn("v", v).select("id", F.nullif(F.nullif("v", F.lit("-.-")), F.lit("0.0")).try_cast("double").alias("x"))


@query(f"WITH {EV} SELECT id, (mag_type = 'error' OR t_us > 20 * 86400000000) AS is_preliminary FROM ev")
def q_prelim_flag(spark, sf):
    return events(spark, sf).select("id", ((F.col("mag_type") == "error") | (F.col("t_us") > 20 * US_PER_DAY)).alias("is_preliminary"))


@query(f"WITH {EV} SELECT id, ir, ic FROM ev WHERE ir BETWEEN 2 AND 6 AND ic BETWEEN 3 AND 9")
def q_box_filter(spark, sf):
    return events(spark, sf).filter(F.col("ir").between(2, 6) & F.col("ic").between(3, 9)).select("id", "ir", "ic")


@query(f"WITH {EV} SELECT user_id, mag_type, arg_min(id, (t_us, id)) AS id FROM ev GROUP BY ALL")
def q_dedupe_key(spark, sf):
    return catalog.first_of_key(events(spark, sf), ["user_id", "mag_type"], ["t_us", "id"]).select("user_id", "mag_type", "id")


_GAP = 3_600_000_000


@query(f"""WITH RECURSIVE {EV}, g AS (SELECT *, CASE WHEN t_us - lag(t_us) OVER w > {_GAP} OR lag(t_us) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM ev WINDOW w AS (PARTITION BY ic ORDER BY t_us, id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY ic ORDER BY t_us, id) AS ses FROM g),
n AS (SELECT *, row_number() OVER (PARTITION BY ic, ses ORDER BY t_us, id) AS k FROM s),
r AS (SELECT ic, ses, k, id, true AS keep, [{{'t': t_us, 'm': mag}}] AS kept FROM n WHERE k = 1
 UNION ALL SELECT n.ic, n.ses, n.k, n.id, x.ok, CASE WHEN x.ok THEN list_append(r.kept, {{'t': n.t_us, 'm': n.mag}}) ELSE r.kept END
 FROM r JOIN n ON n.ic = r.ic AND n.ses = r.ses AND n.k = r.k + 1,
 LATERAL (SELECT len(list_filter(r.kept, lambda z: n.t_us - z.t <= {_GAP} AND abs(n.mag - z.m) <= 0.05)) = 0 AS ok) x)
SELECT id FROM r WHERE keep""")
def q_dedupe_greedy(spark, sf):
    return catalog.drop_near_repeats(events(spark, sf).select("id", "t_us", "mag", "ic"), ["ic"], _GAP, 0.05).select("id")


@query(f"""WITH {EV}, a AS (SELECT * FROM ev WHERE mag_type IN ('click', 'view')), b AS (SELECT * FROM ev WHERE mag_type NOT IN ('click', 'view')), cut AS (SELECT max(t_us) - 2 * 86400000000 AS t FROM a)
SELECT id FROM a UNION ALL SELECT id FROM b, cut WHERE b.t_us < cut.t AND NOT EXISTS (SELECT 1 FROM a WHERE a.ic = b.ic AND a.t_us >= b.t_us - 600000000 AND a.t_us < b.t_us + 600000001)
UNION ALL SELECT id FROM b, cut WHERE b.t_us >= cut.t""")
def q_cross_source_anti(spark, sf):
    """Reviewed events, the others that none of them is near, and all others of the last two days, which aren't reviewed yet."""
    e = events(spark, sf)
    reviewed, others = e.filter("mag_type IN ('click', 'view')"), e.filter("mag_type NOT IN ('click', 'view')")
    others = others.crossJoin(F.broadcast(reviewed.agg((F.max("t_us") - 2 * US_PER_DAY).alias("cut"))))
    spans = reviewed.select((F.col("t_us") - 600_000_000).alias("low"), (F.col("t_us") + 600_000_001).alias("high"), "ic")
    lone = joins.range_join(others.filter("t_us < cut"), spans, "t_us", "low", "high", 3_600_000_000, ("ic",), "left_anti")
    return reviewed.select("id").unionAll(lone.select("id")).unionAll(others.filter("t_us >= cut").select("id"))


@query(f"""WITH {EV} SELECT count(*)::BIGINT AS pairs FROM ev a JOIN ev b ON a.id < b.id AND a.ic = b.ic AND abs(a.t_us - b.t_us) <= 300000000""")
def q_residual_pairs(spark, sf):
    e = events(spark, sf).select("id", "ic", "t_us")
    spans = e.select(F.col("id").alias("other"), "ic", (F.col("t_us") - 300_000_000).alias("low"), (F.col("t_us") + 300_000_001).alias("high"))
    return joins.range_join(e, spans, "t_us", "low", "high", 3_600_000_000, ("ic",)).filter("other < id").agg(F.count("*").alias("pairs"))


@query(f"""WITH {EV} SELECT max(mag_type) AS last_type, count(*)::BIGINT AS n, count(DISTINCT id)::BIGINT AS ids, count(*) FILTER (mag IS NULL)::BIGINT AS no_mag, count(*) FILTER (ir NOT BETWEEN 0 AND 9 OR ic NOT BETWEEN 0 AND 14)::BIGINT AS outside FROM ev""")
def q_quality(spark, sf):
    return events(spark, sf).agg(F.max("mag_type").alias("last_type"), F.count("*").alias("n"), F.countDistinct("id").alias("ids"), F.count_if(F.col("mag").isNull()).alias("no_mag"), F.count_if(~F.col("ir").between(0, 9) | ~F.col("ic").between(0, 14)).alias("outside"))


@query("""SELECT vec_id, CASE WHEN floor((embedding[1]::DOUBLE + 1) / 0.2) BETWEEN 0 AND 9 THEN floor((embedding[1]::DOUBLE + 1) / 0.2)::INT ELSE -1 END AS ir,
CASE WHEN floor((embedding[2]::DOUBLE + 1) / 0.2) BETWEEN 0 AND 14 THEN floor((embedding[2]::DOUBLE + 1) / 0.2)::INT ELSE -1 END AS ic FROM embeddings""")
def q_cell_index(spark, sf):
    from rategrid.operators.lattice import Lattice

    v = spark.read.parquet(f"{sf}/embeddings.parquet")
    ir, ic = Lattice(10, 15, -1.0, -1.0, 0.2).index(F.col("embedding")[0].cast("double"), F.col("embedding")[1].cast("double"))
    return v.select("vec_id", ir.alias("ir"), ic.alias("ic"))


@query(f"WITH {EV} SELECT ir * 15 + ic AS cell, count(*)::BIGINT AS n FROM ev GROUP BY 1")
def q_flat_cell(spark, sf):
    return events(spark, sf).groupBy((F.col("ir") * 15 + F.col("ic")).alias("cell")).agg(F.count("*").alias("n"))


@query(f"WITH {EV}, {CELLS} SELECT c.ir, c.ic, c.ir + 0.5::DOUBLE AS row_centre, c.ic + 0.5::DOUBLE AS col_centre, count(DISTINCT e.user_id)::BIGINT AS stations FROM cells c LEFT JOIN ev e USING (ir, ic) GROUP BY c.ir, c.ic")
def q_lattice(spark, sf):
    """Every cell with its centre, and the stations in it."""
    n = events(spark, sf).groupBy("ir", "ic", "user_id").agg(F.lit(1).alias("one")).groupBy("ir", "ic").agg(F.count("*").alias("stations"))
    centre = lambda c: (F.col(c) + 0.5)
    return GRID.cells(spark).join(n, ["ir", "ic"], "left").select("ir", "ic", centre("ir").alias("row_centre"), centre("ic").alias("col_centre"), F.coalesce("stations", F.lit(0)).alias("stations"))


@query("SELECT o_orderkey, floor((year(o_orderdate) + (epoch_us(date_trunc('day', o_orderdate)) - epoch_us(date_trunc('year', o_orderdate)))::DOUBLE / (epoch_us(date_trunc('year', o_orderdate) + INTERVAL 1 YEAR) - epoch_us(date_trunc('year', o_orderdate)))::DOUBLE) * 1000000 + 0.5) / 1000000 AS decimal_year FROM orders")
def q_decimal_year(spark, sf):
    return spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", fixed(decimal_year(F.col("o_orderdate"))).alias("decimal_year"))


@query("SELECT CASE WHEN o_orderdate < DATE '1998-01-01' THEN 'train' WHEN o_orderdate < DATE '2000-01-01' THEN 'val' WHEN o_orderdate + INTERVAL 30 DAY <= DATE '2001-06-30' THEN 'test' ELSE 'tail' END AS split, count(*)::BIGINT AS n FROM orders GROUP BY 1")
def q_splits(spark, sf):
    d = F.col("o_orderdate")
    s = F.when(d < "1998-01-01", "train").when(d < "2000-01-01", "val").when(d + F.expr("INTERVAL 30 DAYS") <= F.lit("2001-06-30").cast("timestamp"), "test").otherwise("tail")
    return spark.read.parquet(f"{sf}/orders.parquet").groupBy(s.alias("split")).agg(F.count("*").alias("n"))


@query(f"""WITH {EV}, w AS (SELECT range::BIGINT AS h, range::BIGINT * 3600000000 AS high FROM range(24, 720))
SELECT w.h, count(*)::BIGINT AS n, {r6("max(mag)")} AS top FROM w JOIN ev ON t_us >= high - 86400000000 AND t_us < high GROUP BY w.h""")
def q_range_join(spark, sf):
    spans = spark.range(24, 720).select(F.col("id").alias("h"), (F.col("id") * 3_600_000_000).alias("high")).withColumn("low", F.col("high") - US_PER_DAY)
    return joins.range_join(events(spark, sf), spans, "t_us", "low", "high", US_PER_DAY).groupBy("h").agg(F.count("*").alias("n"), fixed(F.max("mag")).alias("top"))


@query(f"""WITH {EV}, p AS (SELECT DISTINCT ic, range::BIGINT * 86400000000 AS t_us FROM ev, range(1, 30))
SELECT p.ic, p.t_us, (SELECT {r6("arg_max(mag, (e.t_us, e.id))")} FROM ev e WHERE e.ic = p.ic AND e.t_us < p.t_us) AS last_mag FROM p""")
def q_asof(spark, sf):
    e = events(spark, sf)
    # events at one microsecond of a cell: the largest id is the last
    e = e.groupBy("ic", "t_us").agg(F.max_by("mag", "id").alias("mag"))
    probes = e.select("ic").distinct().crossJoin(F.broadcast(spark.range(1, 30).select((F.col("id") * US_PER_DAY).alias("t_us"))))
    return joins.as_of(e, probes, "t_us", "mag", ["ic"], US_PER_DAY).select("ic", "t_us", fixed(F.col("last_value")).alias("last_mag"))


@query(f"""WITH {EV}, big AS (SELECT * FROM ev WHERE mag >= 3.2) SELECT b.id, coalesce(min(e.t_us), -1)::BIGINT AS first_t FROM big b LEFT JOIN ev e ON e.ic = b.ic AND e.mag >= 2.5 AND e.t_us > b.t_us AND e.t_us <= b.t_us + 7200000000 GROUP BY b.id""")
def q_follow_on(spark, sf):
    e = events(spark, sf)
    big = e.filter("mag >= 3.2").select(F.col("id").alias("trigger"), "ic", (F.col("t_us") + 1).alias("low"), (F.col("t_us") + 7_200_000_001).alias("high"))
    hit = joins.range_join(e.filter("mag >= 2.5"), big, "t_us", "low", "high", 7_200_000_000, ("ic",)).groupBy("trigger").agg(F.min("t_us").alias("first_t"))
    return big.select("trigger").join(hit, "trigger", "left").select(F.col("trigger").alias("id"), F.coalesce("first_t", F.lit(-1)).cast("long").alias("first_t"))


_EPISODE = "a.ic = b.ic AND a.id < b.id AND abs(a.t_us - b.t_us) <= 3600000000"


@query(f"""WITH RECURSIVE {EV}, big AS (SELECT id, ic, t_us FROM ev WHERE mag >= 3.1),
e AS (SELECT a.id AS a, b.id AS b FROM big a JOIN big b ON {_EPISODE} UNION SELECT b.id, a.id FROM big a JOIN big b ON {_EPISODE}),
r AS (SELECT id, id AS cluster FROM big UNION SELECT e.b, r.cluster FROM r JOIN e ON r.id = e.a)
SELECT id, min(cluster) AS cluster FROM r GROUP BY id""")
def q_episodes(spark, sf):
    big = events(spark, sf).filter("mag >= 3.1").select("id", "ic", "t_us")
    spans = big.select(F.col("id").alias("b"), "ic", (F.col("t_us") - 3_600_000_000).alias("low"), (F.col("t_us") + 3_600_000_001).alias("high"))
    edges = joins.range_join(big, spans, "t_us", "low", "high", 3_600_000_000, ("ic",)).filter("id < b").select(F.col("id").alias("a"), "b")
    return catalog.clusters(big.select("id"), edges)


@query("""WITH v AS (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3] > 0 AS place FROM embeddings)
SELECT p.vec_id, arg_min(s.vec_id, (sqrt((p.x-s.x)*(p.x-s.x)+(p.y-s.y)*(p.y-s.y)), s.vec_id)) AS place FROM v p, v s WHERE NOT p.place AND s.place GROUP BY p.vec_id""")
def q_nearest(spark, sf):
    e = F.col("embedding")
    v = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", e[0].cast("double").alias("x"), e[1].cast("double").alias("y"), (e[2] > 0).alias("place"))
    return joins.nearest(v.filter("not place"), v.filter("place").select(F.col("vec_id").alias("place"), "x", "y"), "vec_id", "place", 0.05).select("vec_id", "place")


@query(f"WITH {EV}, a AS (SELECT DISTINCT ir, ic FROM ev WHERE mag >= 2.5), b AS (SELECT DISTINCT ir, ic FROM ev WHERE mag >= 3.2) SELECT 'both' AS k, count(*)::BIGINT AS n FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'minus', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'either', count(*) FROM (SELECT * FROM a UNION SELECT * FROM b)")
def q_set_operations(spark, sf):
    e = events(spark, sf)
    a, b = (e.filter(F.col("mag") >= m).select("ir", "ic").distinct() for m in (2.5, 3.2))
    n = lambda df, k: df.agg(F.lit(k).alias("k"), F.count("*").alias("n"))
    return n(a.intersect(b), "both").union(n(a.subtract(b), "minus")).union(n(a.union(b).distinct(), "either"))


@query(f"""WITH {EV} SELECT id, (count(*) OVER (PARTITION BY ic ORDER BY t_us RANGE BETWEEN 3600000000 PRECEDING AND 1 PRECEDING))::BIGINT AS n FROM ev""")
def q_trailing_count(spark, sf):
    return trailing_count(events(spark, sf), ["ic"], 3_600_000_000, 6 * 3_600_000_000).select("id", "n")
