"""The whole feature cube: counts, histories and slopes around cells, model rates, and fields of the place."""

from pyspark.sql import functions as F

from rategrid.plans.base import EV, events, fixed, query, r6
from rategrid.plans.features import REAL, feature_cube
from rategrid.plans.model import EXPECTED, expected_counts
from rategrid.plans.prepare import POLY, polyline
from rategrid.plans.sequence import BPOS, STRAIN, slopes_around, strain_field

KEYS = ["window", "ir", "ic"]
SIMS = 20
#: Rates of simulated catalogs of the day before; a catalog is the events whose id leaves one remainder.
LAM_SIM = f"""lam_sim AS (SELECT win + 1 AS "window", ir, ic, count(*)::DOUBLE / {SIMS} AS lam FROM ev WHERE mag >= 2.0 GROUP BY ALL)"""
FULL = f"""{EXPECTED}, {BPOS}, {POLY}, {STRAIN}, {LAM_SIM},
full_cube AS (SELECT c.*, b.b AS b_pos, b.fallback AS b_pos_is_fallback, p.dist AS dist_fault, s.strain AS strain_inv, x.lam AS etas_rate, ln(coalesce(z.lam, 0) + 1e-9) AS ln_lam_sim
  FROM cube c JOIN bpos b USING ("window", ir, ic) JOIN poly p USING (ir, ic) JOIN strain s USING (ir, ic) JOIN expected x USING ("window", ir, ic) LEFT JOIN lam_sim z USING ("window", ir, ic))"""


def simulated_rates(spark, sf):
    """window, ir, ic, lam: events a simulated catalog has in a cell, on average; summed by catalog first, as simulations come."""
    per = events(spark, sf).filter("mag >= 2.0").groupBy((F.col("win") + 1).alias("window"), "ir", "ic", (F.col("id") % SIMS).alias("sim")).agg(F.count("*").alias("n"))
    return per.groupBy(*KEYS).agg((F.sum("n") / float(SIMS)).alias("lam"))


def full_cube(spark, sf):
    """All features of a cell in a window and its target.  Parts by window meet on the window and cell; fields of a place are a row a cell."""
    c = feature_cube(spark, sf)
    slopes = slopes_around(spark, sf).select(*KEYS, F.col("b").alias("b_pos"), F.col("fallback").alias("b_pos_is_fallback"))
    place = polyline(spark).select("ir", "ic", F.col("dist").alias("dist_fault")).join(strain_field(spark, sf), ["ir", "ic"]).withColumnRenamed("strain", "strain_inv")
    rate = expected_counts(spark, sf).select(*KEYS, F.col("lam").alias("etas_rate"))
    sims = simulated_rates(spark, sf).select(*KEYS, F.log(F.col("lam") + 1e-9).alias("ln_lam_sim"))
    out = c.join(slopes, KEYS).join(rate, KEYS).join(sims, KEYS, "left").join(F.broadcast(place), ["ir", "ic"])
    return out.withColumn("ln_lam_sim", F.coalesce("ln_lam_sim", F.log(F.lit(1e-9))))


_MORE = ("b_pos", "dist_fault", "strain_inv", "etas_rate", "ln_lam_sim")
_COUNTS = ("cnt1", "cnt3", "cnt7", "nbr3_cnt1", "nbr3_cnt7", "nbr5_cnt1", "nbr5_cnt7")


@query(f"""WITH {FULL} SELECT "window", ir, ic, {", ".join(_COUNTS)}, {", ".join(f"{r6(c)} AS {c}" for c in (*REAL, *_MORE))}, b_pos_is_fallback, y FROM full_cube""")
def q_feature_cube(spark, sf):
    c = full_cube(spark, sf)
    return c.select(*KEYS, *_COUNTS, *[fixed(F.col(x)).alias(x) for x in (*REAL, *_MORE)], "b_pos_is_fallback", "y")
