"""Calibration of forecasts, consistency tests, and simulated occupancies."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from rategrid.functions.core import rate_of, ratio
from rategrid.operators.isotonic import pool
from rategrid.operators.quantiles import quantiles
from rategrid.operators.resample import digits
from rategrid.plans.base import EV, events, fixed, query, r6
from rategrid.plans.features import CUBE, feature_cube
from rategrid.plans.process import _SIMS, _sims
from rategrid.plans.scores import PRED, RATE, long, predictions
from rategrid.sources.shared import materialize

_TENTHS = [k / 10 for k in range(1, 10)]


@query(f"""WITH {PRED}, q AS (SELECT model, list_distinct(quantile_cont(p, {_TENTHS})) AS q FROM long GROUP BY model), b AS (SELECT model, len(list_filter(q, lambda x: x < p)) AS bin, avg(p) AS p, avg(y) AS f, count(*)::DOUBLE AS n, sum(y)::DOUBLE AS pos FROM long JOIN q USING (model) GROUP BY ALL),
s AS (SELECT model, sum(n) AS w, sum(n * p) AS x, sum(n * f) AS y, sum(n * p * p) AS xx, sum(n * p * f) AS xy, sum(pos) AS pos, count(*)::BIGINT AS bins FROM b GROUP BY model), l AS (SELECT *, (w * xy - x * y) / (w * xx - x * x) AS slope FROM s)
SELECT model, bins, {r6('slope')} AS slope, {r6('(y - slope * x) / w')} AS intercept, CASE WHEN pos < 10 THEN 'untestable' WHEN slope BETWEEN 0.8 AND 1.25 AND abs((y - slope * x) / w) < 0.02 THEN 'calibrated' ELSE 'miscalibrated' END AS verdict FROM l""")
def q_reliability_q(spark, sf):
    """Reliability over quantile bins: a weighted line through their frequencies, and a verdict on slope and intercept."""
    df = long(spark, sf)
    q = F.broadcast(quantiles(df, ["model"], "p", _TENTHS).select("model", F.array_distinct("p").alias("q")))  # a row for each model
    b = df.join(q, "model").groupBy("model", F.size(F.filter("q", lambda x: x < F.col("p"))).alias("bin")).agg(F.avg("p").alias("p"), F.avg("y").alias("f"), F.count("*").cast("double").alias("n"), F.sum("y").alias("pos"))
    n, p, f = F.col("n"), F.col("p"), F.col("f")
    s = b.groupBy("model").agg(F.sum(n).alias("w"), F.sum(n * p).alias("x"), F.sum(n * f).alias("y"), F.sum(n * p * p).alias("xx"), F.sum(n * p * f).alias("xy"), F.sum("pos").alias("pos"), F.count("*").alias("bins"))
    slope = ratio(F.col("w") * F.col("xy") - F.col("x") * F.col("y"), F.col("w") * F.col("xx") - F.col("x") * F.col("x"))
    s = s.withColumn("slope", slope).withColumn("c", (F.col("y") - F.col("slope") * F.col("x")) / F.col("w"))
    good = F.col("slope").between(0.8, 1.25) & (F.abs("c") < 0.02)
    verdict = F.when(F.col("pos") < 10, "untestable").when(good, "calibrated").otherwise("miscalibrated")
    return s.select("model", "bins", fixed(F.col("slope")).alias("slope"), fixed(F.col("c")).alias("intercept"), verdict.alias("verdict"))


#: Isotonic regression by its min-max form: the largest mean from a lower end to the smallest mean up to a higher one.
_ISO = f"""{PRED}, v AS (SELECT floor(near * 200)::BIGINT AS k, sum(y)::DOUBLE AS s, count(*)::DOUBLE AS n FROM pred WHERE "window" < 18 GROUP BY 1), c AS (SELECT k, coalesce(sum(s) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s0, coalesce(sum(n) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n0, sum(s) OVER (ORDER BY k) AS s1, sum(n) OVER (ORDER BY k) AS n1 FROM v),
m AS (SELECT a.k AS a, x.k AS k, min((b.s1 - a.s0) / (b.n1 - a.n0)) AS low FROM c a JOIN c x ON a.k <= x.k JOIN c b ON b.k >= x.k GROUP BY ALL), iso AS (SELECT k, max(low) AS q FROM m GROUP BY k)"""


@query(f"WITH {_ISO} SELECT k, {r6('q')} AS q FROM iso")
def q_isotonic(spark, sf):
    """The increasing step function nearest to outcomes of the validation windows, over bins of the forecast, by pooling violators."""
    v = predictions(spark, sf).filter("window < 18").groupBy(F.floor(F.col("near") * 200).alias("k")).agg(F.sum("y").cast("double").alias("s"), F.count("*").cast("double").alias("n"))
    return pool(v, "k", "s", "n").select("k", fixed(F.col("q")).alias("q"))


@query(f"""WITH {_ISO}, e AS (SELECT (SELECT arg_min(q, (abs(i.k - floor(near * 200)), i.k)) FROM iso i) AS q, near AS p, y FROM pred WHERE "window" >= 18) SELECT {r6('avg((p - y) * (p - y))')} AS before, {r6('avg((q - y) * (q - y))')} AS after, {r6('sum(y) / sum(p)')} AS ratio_before, {r6('sum(y) / sum(q)')} AS ratio_after FROM e""")
def q_isotonic_apply(spark, sf):
    """The calibration applied to later windows; beyond its ends and in gaps the nearest step holds."""
    p = predictions(spark, sf)
    v = p.filter("window < 18").groupBy(F.floor(F.col("near") * 200).alias("k")).agg(F.sum("y").cast("double").alias("s"), F.count("*").cast("double").alias("n"))
    steps = F.broadcast(pool(v, "k", "s", "n").agg(F.array_sort(F.collect_list(F.struct("k", "q"))).alias("steps")))  # 201 steps at most
    at = F.floor(F.col("near") * 200)
    e = p.filter("window >= 18").crossJoin(steps)
    near = F.array_min(F.transform("steps", lambda s: F.struct(F.abs(s["k"] - at).alias("d"), s["k"].alias("k"), s["q"].alias("q"))))
    e = e.select(near["q"].alias("q"), F.col("near").alias("p"), "y")
    sq = lambda c: fixed(F.avg((F.col(c) - F.col("y")) * (F.col(c) - F.col("y"))))
    return e.agg(sq("p").alias("before"), sq("q").alias("after"), fixed(F.sum("y") / F.sum("p")).alias("ratio_before"), fixed(F.sum("y") / F.sum("q")).alias("ratio_after"))


@query(f"""WITH {PRED}, l AS (SELECT *, {RATE('near')} AS lam FROM pred), m AS (SELECT quantile_cont(lam, 0.5) AS m FROM l WHERE "window" < 18), s AS (SELECT lam > m AS high, sum(y) / sum(lam) AS s FROM l, m WHERE "window" < 18 GROUP BY 1),
c AS (SELECT ir, ic, (sum(y) + 1.0) / (sum(lam) + 1.0) AS s FROM l WHERE "window" < 18 GROUP BY ALL), e AS (SELECT l.*, greatest(lam * s.s, 1e-9) AS two, greatest(lam * c.s, 1e-9) AS static FROM l JOIN m ON true JOIN s ON s.high = (lam > m) JOIN c USING (ir, ic) WHERE "window" >= 18)
SELECT {r6('sum(y * ln(lam) - lam)')} AS plain, {r6('sum(y * ln(two) - two)')} AS two_scalars, {r6('sum(y * ln(static) - static)')} AS static_map FROM e""")
def q_static_map(spark, sf):
    """Likelihood of later windows as forecast, with a scalar on either side of the median rate, and with a shrunk factor for each cell."""
    df = predictions(spark, sf).withColumn("lam", rate_of(F.col("near")))
    train = df.filter("window < 18")
    m = F.broadcast(quantiles(train, [], "lam", [0.5]).select(F.col("p")[0].alias("m")))  # one row
    two = train.crossJoin(m).groupBy((F.col("lam") > F.col("m")).alias("high")).agg((F.sum("y") / F.sum("lam")).alias("s2"))
    cell = train.groupBy("ir", "ic").agg(((F.sum("y") + 1.0) / (F.sum("lam") + 1.0)).alias("sc"))
    e = df.filter("window >= 18").crossJoin(m).withColumn("high", F.col("lam") > F.col("m")).join(F.broadcast(two), "high").join(cell, ["ir", "ic"])
    ll = lambda r: fixed(F.sum(F.col("y") * F.log(F.greatest(r, F.lit(1e-9))) - F.greatest(r, F.lit(1e-9))))
    return e.agg(ll(F.col("lam")).alias("plain"), ll(F.col("lam") * F.col("s2")).alias("two_scalars"), ll(F.col("lam") * F.col("sc")).alias("static_map"))


_FITTED = 12


def _step_sql(k: int) -> str:
    """From st<k> to st<k+1>: Newton's step where it changes neither factor more than fourfold, else one of expectation and maximisation."""
    lam = "(a * lo + b * ln_)"
    return f"""gr{k} AS MATERIALIZED (SELECT sum(y * lo / {lam} - lo) AS ga, sum(y * ln_ / {lam} - ln_) AS gb, sum(y * lo * lo / {lam} ** 2) AS haa, sum(y * lo * ln_ / {lam} ** 2) AS hab, sum(y * ln_ * ln_ / {lam} ** 2) AS hbb, sum(lo) AS la, sum(ln_) AS lb FROM l, st{k}),
nw{k} AS MATERIALIZED (SELECT a, b, a + (hbb * ga - hab * gb) / greatest(haa * hbb - hab * hab, 1e-300) AS na, b + (haa * gb - hab * ga) / greatest(haa * hbb - hab * hab, 1e-300) AS nb, a * (ga + la) / la AS ea, b * (gb + lb) / lb AS eb FROM st{k}, gr{k}),
st{k + 1} AS MATERIALIZED (SELECT CASE WHEN na BETWEEN a / 4 AND a * 4 AND nb BETWEEN b / 4 AND b * 4 THEN na ELSE ea END AS a, CASE WHEN na BETWEEN a / 4 AND a * 4 AND nb BETWEEN b / 4 AND b * 4 THEN nb ELSE eb END AS b FROM nw{k})"""


@query(f"""WITH {PRED}, l AS (SELECT y, {RATE('own')} AS lo, {RATE('near')} AS ln_ FROM pred WHERE "window" < 18), st0 AS MATERIALIZED (SELECT 0.5::DOUBLE AS a, 0.5::DOUBLE AS b), {", ".join(map(_step_sql, range(_FITTED)))}
SELECT {r6('any_value(a)')} AS a, {r6('any_value(b)')} AS b, {r6('sum(y * ln(a * lo + b * ln_) - (a * lo + b * ln_))')} AS ll FROM l, st{_FITTED}""")
def q_two_scalars(spark, sf):
    """Factors of two added rates that fit best, by steps on seven sums: Newton's, or, where that would change a factor more than fourfold, one of
    expectation and maximisation, which can't overshoot."""
    df = materialize(predictions(spark, sf).filter("window < 18").select("y", rate_of(F.col("own")).alias("lo"), rate_of(F.col("near")).alias("ln")), "scalars")
    y, lo, ln = F.col("y"), F.col("lo"), F.col("ln")
    a = b = 0.5
    for _ in range(_FITTED):
        lam = a * lo + b * ln
        ga, gb, haa, hab, hbb, la, lb = df.agg(
            F.sum(y * lo / lam - lo), F.sum(y * ln / lam - ln), F.sum(y * lo * lo / (lam * lam)), F.sum(y * lo * ln / (lam * lam)), F.sum(y * ln * ln / (lam * lam)), F.sum(lo), F.sum(ln)
        ).first()
        det = max(haa * hbb - hab * hab, 1e-300)
        na, nb = a + (hbb * ga - hab * gb) / det, b + (haa * gb - hab * ga) / det
        near = a / 4 <= na <= a * 4 and b / 4 <= nb <= b * 4
        a, b = (na, nb) if near else (a * (ga + la) / la, b * (gb + lb) / lb)
    lam = a * lo + b * ln
    return df.agg(fixed(F.lit(a)).alias("a"), fixed(F.lit(b)).alias("b"), fixed(F.sum(y * F.log(lam) - lam)).alias("ll"))


@query(f"""WITH {PRED}, d AS (SELECT ("window" < 18)::INT AS early, (ir < 5)::INT AS zone, y * (ln({RATE('own')}) - ln({RATE('near')})) AS placement, -({RATE('own')} - {RATE('near')}) AS counts FROM pred), t AS (SELECT coalesce(early, -1) AS early, coalesce(zone, -1) AS zone, sum(placement) AS placement, sum(counts) AS counts FROM d GROUP BY CUBE (early, zone))
SELECT early, zone, {r6('placement')} AS placement, {r6('counts')} AS counts, {r6('(placement + counts) / max(abs(placement + counts)) OVER ()')} AS share FROM t""")
def q_mechanism(spark, sf):
    """A gain split into placement and counts, by era and zone with their margins."""
    a, b = rate_of(F.col("own")), rate_of(F.col("near"))
    d = predictions(spark, sf).select((F.col("window") < 18).cast("int").alias("early"), (F.col("ir") < 5).cast("int").alias("zone"), (F.col("y") * (F.log(a) - F.log(b))).alias("placement"), (b - a).alias("counts"))
    t = d.cube("early", "zone").agg(F.sum("placement").alias("placement"), F.sum("counts").alias("counts"))
    whole = F.col("placement") + F.col("counts")
    share = ratio(whole, F.max(F.abs(whole)).over(Window.partitionBy()))  # nine rows
    return t.select(F.coalesce("early", F.lit(-1)).alias("early"), F.coalesce("zone", F.lit(-1)).alias("zone"), fixed(F.col("placement")).alias("placement"), fixed(F.col("counts")).alias("counts"), fixed(share).alias("share"))


@query(f"""WITH {PRED}, d AS (SELECT ir, "window", sum(y * (ln({RATE('own')}) - ln({RATE('near')})) - ({RATE('own')} - {RATE('near')})) AS d FROM pred GROUP BY ALL), k AS (SELECT ir, count(*) FILTER (d > 0) AS k, count(*) AS n FROM d GROUP BY ir)
SELECT ir, k::BIGINT AS k, {r6('(SELECT sum(exp(lgamma(n + 1.0) - lgamma(i + 1.0) - lgamma(n - i + 1.0) - n * ln(2.0))) FROM range(24) r(i) WHERE i >= k AND i <= n)')} AS tail FROM k""")
def q_binomial_gate(spark, sf):
    """The chance of at least as many winning windows if each side won half of them, as a closed sum."""
    gain = F.col("y") * (F.log(rate_of(F.col("own"))) - F.log(rate_of(F.col("near")))) - (rate_of(F.col("own")) - rate_of(F.col("near")))
    k = predictions(spark, sf).groupBy("ir", "window").agg(F.sum(gain).alias("d")).groupBy("ir").agg(F.count_if(F.col("d") > 0).alias("k"), F.count("*").cast("int").alias("n"))
    # log factorials from 0 to 23
    logs = F.concat(F.array(F.lit(0.0)), F.transform(F.sequence(F.lit(1), F.lit(23)), lambda i: F.aggregate(F.sequence(F.lit(1), i), F.lit(0.0), lambda a, j: a + F.log(j.cast("double")))))
    f = lambda i: F.element_at(logs, (i + 1).cast("int"))
    term = lambda i: F.exp(f(F.col("n")) - f(i) - f(F.col("n") - i) - F.col("n") * F.log(F.lit(2.0)))
    tail = F.aggregate(F.sequence(F.col("k").cast("int"), F.col("n")), F.lit(0.0), lambda a, i: a + term(i))
    return k.select("ir", "k", fixed(tail).alias("tail"))


@query(f"WITH {PRED} SELECT \"window\", ir, ic, {r6('1 - pow(1 - near, 2.5::DOUBLE)')} AS p FROM pred")
def q_prob_scale(spark, sf):
    """Probabilities at another horizon: 1 - (1 - p)^s."""
    return predictions(spark, sf).select("window", "ir", "ic", fixed(1 - F.pow(1 - F.col("near"), F.lit(2.5))).alias("p"))


@query(f"""WITH {PRED}, k AS (SELECT win AS "window", ir, ic, count(*) AS k, max(mag) AS top FROM ev WHERE mag >= 2.0 GROUP BY ALL), f AS (SELECT * FROM (VALUES (2.3::DOUBLE), (2.6::DOUBLE), (2.9::DOUBLE)) f(floor)), v AS (SELECT floor, (coalesce(top, 0) >= floor)::INT AS y, {RATE('own')} AS a, {RATE('near')} AS b FROM pred LEFT JOIN k USING ("window", ir, ic), f)
SELECT floor, sum(y)::BIGINT AS pos, {r6('sum(y * (ln(a) - ln(b)) - (a - b)) / greatest(sum(y), 1)::DOUBLE')} AS gain FROM v GROUP BY floor""")
def q_label_floor(spark, sf):
    """The gain when the label's threshold moves."""
    top = events(spark, sf).filter("mag >= 2.0").groupBy(F.col("win").alias("window"), "ir", "ic").agg(F.max("mag").alias("top"))
    v = predictions(spark, sf).join(top, ["window", "ir", "ic"], "left").withColumn("floor", F.explode(F.array(F.lit(2.3), F.lit(2.6), F.lit(2.9))))
    y = (F.coalesce("top", F.lit(0.0)) >= F.col("floor")).cast("int")
    a, b = rate_of(F.col("own")), rate_of(F.col("near"))
    gain = F.sum(y * (F.log(a) - F.log(b)) - (a - b)) / F.greatest(F.sum(y), F.lit(1))
    return v.groupBy("floor").agg(F.sum(y).alias("pos"), fixed(gain).alias("gain"))


@query(f"""WITH {CUBE}, s AS (SELECT "window", sum(cnt7) AS n FROM cube GROUP BY ALL), m AS (SELECT quantile_cont(n, 0.5) AS m FROM s) SELECT CASE WHEN n > m THEN 'active' ELSE 'quiet' END AS regime, count(*)::BIGINT AS rows, sum(y)::BIGINT AS pos, {r6('avg(y)')} AS rate FROM cube JOIN s USING ("window"), m GROUP BY 1""")
def q_regimes(spark, sf):
    """Windows split into active and quiet ones at the median of their counts."""
    s = feature_cube(spark, sf).groupBy("window").agg(F.sum("cnt7").alias("n"), F.count("*").alias("rows"), F.sum("y").alias("pos"))
    m = F.broadcast(s.agg(F.percentile("n", 0.5).alias("m")))
    t = s.crossJoin(m).groupBy(F.when(F.col("n") > F.col("m"), "active").otherwise("quiet").alias("regime")).agg(F.sum("rows").alias("rows"), F.sum("pos").alias("pos"))
    return t.select("regime", "rows", "pos", fixed(F.col("pos") / F.col("rows")).alias("rate"))


_HASH = "('0x' || substr(md5(user_id::VARCHAR), 1, 8))::BIGINT % 100"


@query(f"WITH {EV} SELECT CASE WHEN {_HASH} < 70 THEN 'train' WHEN {_HASH} < 85 THEN 'val' ELSE 'test' END AS part, count(DISTINCT user_id)::BIGINT AS users, count(*)::BIGINT AS n FROM ev GROUP BY 1")
def q_group_split(spark, sf):
    """Groups, not rows, dealt to three parts by their hash."""
    u = events(spark, sf).groupBy("user_id").agg(F.count("*").alias("n"))
    h = digits(F.col("user_id").cast("string"), 1, 8) % 100
    return u.groupBy(F.when(h < 70, "train").when(h < 85, "val").otherwise("test").alias("part")).agg(F.count("*").alias("users"), F.sum("n").alias("n"))


# simulated occupancies


@query(f"""WITH {_SIMS}, k AS (SELECT k.k, ir, ic, count(DISTINCT sim)::DOUBLE / k.k AS p FROM s JOIN (VALUES (5), (10), (20)) k(k) ON sim < k.k WHERE mag >= 2.5 GROUP BY k.k, ir, ic) SELECT ir, ic, {r6('regr_intercept(p, 1.0 / k)')} AS p FROM k GROUP BY ir, ic HAVING count(*) > 1""")
def q_k_extrapolate(spark, sf):
    """Occupancies at several numbers of simulations, drawn out to infinitely many."""
    per = _sims(spark, sf).filter("mag >= 2.5").select("ir", "ic", "sim").distinct()
    per = per.withColumn("k", F.explode(F.filter(F.array(*[F.lit(x) for x in (5, 10, 20)]), lambda k: F.col("sim") < k)))
    k = per.groupBy("k", "ir", "ic").agg((F.count("*") / F.col("k")).alias("p"))
    return k.groupBy("ir", "ic").agg(F.count("*").alias("n"), F.regr_intercept(F.col("p"), 1.0 / F.col("k")).alias("p")).filter("n > 1").select("ir", "ic", fixed(F.col("p")).alias("p"))


@query(f"""WITH {_SIMS}, c AS (SELECT ir, ic, sim, count(*)::DOUBLE AS n FROM s WHERE mag >= 2.0 GROUP BY ALL), g AS (SELECT ir, ic, sum(n) / 20 AS lam FROM c GROUP BY ALL) SELECT ir, ic, {r6('(sum(1 - exp(-0.5 * n)) / 20 + (1 - exp(-any_value(lam) * 1.5))) / 2')} AS p FROM c JOIN g USING (ir, ic) GROUP BY ir, ic""")
def q_top_up(spark, sf):
    """Occupancy of catalogs thinned to half of their events, blended with that of a Poisson rate topped up by half."""
    c = _sims(spark, sf).filter("mag >= 2.0").groupBy("ir", "ic", "sim").agg(F.count("*").alias("n"))
    g = c.groupBy("ir", "ic").agg((F.sum(1 - F.exp(-0.5 * F.col("n"))) / 20).alias("occ"), (F.sum("n") / 20).alias("lam"))
    return g.select("ir", "ic", fixed((F.col("occ") + (1 - F.exp(-F.col("lam") * 1.5))) / 2).alias("p"))


@query(f"WITH {_SIMS}, n AS (SELECT sim, count(*) FILTER (mag >= 2.5)::DOUBLE AS n FROM s GROUP BY sim) SELECT {r6('stddev_samp(n) / sqrt(avg(n))')} AS over, {r6('avg((n >= 20)::INT)')} AS share FROM n")
def q_overdispersion(spark, sf):
    """How much simulated totals vary beside a Poisson count, and the share at or above an observed total."""
    n = _sims(spark, sf).groupBy("sim").agg(F.count_if(F.col("mag") >= 2.5).cast("double").alias("n"))
    return n.agg(fixed(F.stddev_samp("n") / F.sqrt(F.avg("n"))).alias("over"), fixed(F.avg((F.col("n") >= 20).cast("int"))).alias("share"))


@query(f"WITH {EV}, g AS (SELECT r.range / 2.0 AS r, c.range / 2.0 AS c, t.range AS t FROM range(20) r, range(30) c, range(30) t), big AS (SELECT * FROM ev WHERE mag >= 3.2), k AS (SELECT g.*, EXISTS (SELECT 1 FROM big b WHERE b.win < g.t AND b.win >= g.t - 2 AND (b.ir - g.r) ** 2 + (b.ic - g.c) ** 2 <= 2.25) AS hit FROM g) SELECT t::BIGINT AS t, {r6('avg(hit::INT)')} AS covered FROM k GROUP BY t")
def q_coverage_union(spark, sf):
    """The share of a space-time lattice that lies in the union of cylinders around large events."""
    half = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    big = events(spark, sf).filter("mag >= 3.2").select("ir", "ic", "win").distinct()
    # each cylinder marks its points; a point that several mark counts once
    t = big.withColumn("t", F.explode(F.sequence(F.col("win") + 1, F.col("win") + 2))).filter("t < 30")
    near = t.withColumn("r", F.explode(F.sequence(2 * F.col("ir") - 3, 2 * F.col("ir") + 3))).withColumn("c", F.explode(F.sequence(2 * F.col("ic") - 3, 2 * F.col("ic") + 3)))
    inside = F.col("r").between(0, 19) & F.col("c").between(0, 29) & ((F.col("ir") - F.col("r") / 2) ** 2 + (F.col("ic") - F.col("c") / 2) ** 2 <= 2.25)
    n = near.filter(inside).select("t", "r", "c").distinct().groupBy("t").agg(F.count("*").alias("n"))
    every = spark.range(1).select(half(30).alias("t"))
    return every.join(n, "t", "left").select(F.col("t").cast("long").alias("t"), fixed(F.coalesce("n", F.lit(0)) / 600).alias("covered"))


@query(f"""WITH {PRED}, n AS (SELECT pred."window", pred.ir, pred.ic, count(e.id) AS k FROM pred LEFT JOIN ev e ON e.win = "window" AND e.ir = pred.ir AND e.ic = pred.ic AND e.mag >= 2.5 GROUP BY ALL), s AS (SELECT sum(k)::DOUBLE AS ev, sum((k > 0)::INT)::DOUBLE AS n FROM n), l AS (SELECT model, sum({RATE('p')}) AS lam FROM long GROUP BY model)
SELECT model, {r6('ev / n')} AS multiplicity, {r6('n / lam')} AS s, {r6('(n / ev) * (ev / lam)')} AS product, {r6('ln(n / lam) + (1 - n / lam) * lam / n')} AS gain FROM l, s""")
def q_multiplicity(spark, sf):
    """Events per occupied cell, and the scalar of occurrence as its product with that of counts, with the gain that it brings."""
    k = events(spark, sf).filter("mag >= 2.5 AND win >= 7").groupBy("win", "ir", "ic").agg(F.count("*").alias("k")).agg(F.sum("k").cast("double").alias("ev"), F.count("*").cast("double").alias("n"))
    l = long(spark, sf).groupBy("model").agg(F.sum(rate_of(F.col("p"))).alias("lam")).crossJoin(F.broadcast(k))  # noqa: E741
    s = F.col("n") / F.col("lam")
    return l.select("model", fixed(F.col("ev") / F.col("n")).alias("multiplicity"), fixed(s).alias("s"), fixed(F.col("n") / F.col("ev") * (F.col("ev") / F.col("lam"))).alias("product"), fixed(F.log(s) + (1 - s) * F.col("lam") / F.col("n")).alias("gain"))
