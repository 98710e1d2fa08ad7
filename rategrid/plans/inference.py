"""Comparing forecasts: bootstrap intervals, pairs, verdicts and weights."""

from itertools import combinations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rategrid.functions.core import ln, rate_of
from rategrid.operators import metrics
from rategrid.operators.resample import multiplicities, ranked_draws, stationary
from rategrid.plans.base import fixed, query, r6
from rategrid.plans.scores import PRED, RATE, predictions

DRAWS, UNITS, FIRST = 2000, 23, 7
#: A third forecast between the two: the geometric mean of their rates.
THREE = f"""{PRED}, three AS (SELECT * FROM long UNION ALL SELECT 'mix', "window", ir, ic, y, 1 - exp(-sqrt({RATE('own')} * {RATE('near')})) FROM pred),
lls AS (SELECT model, "window", sum(y * ln({RATE('p')}) - {RATE('p')}) AS ll, sum(y * ln(p) + (1 - y) * ln(1 - p)) AS bl, sum((p - y) * (p - y)) AS sq, sum(y)::DOUBLE AS y, count(*)::DOUBLE AS n FROM three GROUP BY ALL)"""


MODELS = ("own", "near", "mix")


def abreast(spark, sf):
    """The three forecasts of a cell and window in one row."""
    return predictions(spark, sf).withColumn("mix", 1 - F.exp(-F.sqrt(rate_of(F.col("own")) * rate_of(F.col("near")))))


def three(spark, sf):
    return abreast(spark, sf).unpivot(["window", "ir", "ic", "y"], list(MODELS), "model", "p")


def cell_scores(p, y):
    """Log-likelihoods of a cell under the Poisson and the Bernoulli form."""
    lam = rate_of(p)
    return y * F.log(lam) - lam, y * ln(p) + (1 - y) * ln(1 - p)


def window_scores(df):
    """Of each model and window the sums that all additive scores are made of."""
    p, y = F.col("p"), F.col("y")
    ll, bl = cell_scores(p, y)
    return df.groupBy("model", "window").agg(F.sum(ll).alias("ll"), F.sum(bl).alias("bl"), F.sum((p - y) * (p - y)).alias("sq"), F.sum(y).cast("double").alias("y"), F.count("*").cast("double").alias("n"))


def plan_sql(block: int = 3, draws: int = DRAWS, name: str = "plan") -> str:
    hexa = "('0x' || substr(md5(draw || '-' || pos), {}, 8))::BIGINT"
    return f"""{name}_g AS (SELECT d.range AS draw, p.range AS pos FROM range({draws}) d, range({UNITS}) p), {name}_f AS (SELECT *, CASE WHEN pos = 0 OR {hexa.format(1)} % {block} = 0 THEN pos END AS begun, {hexa.format(9)} % {UNITS} AS s FROM {name}_g),
{name}_l AS (SELECT draw, pos, max(begun) OVER (PARTITION BY draw ORDER BY pos ROWS UNBOUNDED PRECEDING) AS begun FROM {name}_f),
{name} AS (SELECT l.draw, (f.s + l.pos - l.begun) % {UNITS} + {FIRST} AS "window" FROM {name}_l l JOIN {name}_f f ON f.draw = l.draw AND f.pos = l.begun)"""


def plan(spark, block: int = 3):
    return stationary(spark, UNITS, DRAWS, block).select("draw", (F.col("place") + FIRST).cast("int").alias("window"))


#: Ranking scores of each draw and model; windows that a draw repeats count as often, and ties together.
RANKS = f"""{THREE}, {plan_sql()}, m AS (SELECT draw, "window", count(*) AS m FROM plan GROUP BY ALL), tied AS (SELECT draw, model, p, sum(m * y)::DOUBLE AS pos, sum(m)::DOUBLE AS n FROM m JOIN three USING ("window") GROUP BY ALL),
c AS (SELECT *, sum(pos) OVER w AS tp, sum(n) OVER w AS seen FROM tied WINDOW w AS (PARTITION BY draw, model ORDER BY p DESC ROWS UNBOUNDED PRECEDING)),
ranks AS (SELECT draw, model, sum(pos * tp / seen) / sum(pos) AS pr, sum((n - pos) * (tp - pos / 2)) / (sum(pos) * (sum(n) - sum(pos))) AS roc FROM c GROUP BY ALL HAVING sum(pos) > 0 AND sum(pos) < sum(n))"""


def ranks(spark, df):
    return ranked_draws(df, multiplicities(plan(spark), UNITS, FIRST, DRAWS), FIRST)


@query(f"""WITH {RANKS}, b AS (SELECT draw, model, sum(sq) / sum(n) AS brier FROM plan JOIN lls USING ("window") GROUP BY ALL),
d AS (SELECT draw, max(pr) FILTER (model = 'own') - max(pr) FILTER (model = 'near') AS pr, max(roc) FILTER (model = 'own') - max(roc) FILTER (model = 'near') AS roc, max(brier) FILTER (model = 'own') - max(brier) FILTER (model = 'near') AS brier FROM ranks JOIN b USING (draw, model) GROUP BY draw),
l AS (UNPIVOT d ON pr, roc, brier INTO NAME score VALUE x)
SELECT score, count(*)::BIGINT AS draws, {r6("quantile_cont(x, 0.025)")} AS low, {r6("quantile_cont(x, 0.975)")} AS high, {r6("avg((x > 0)::INT)")} AS wins FROM l GROUP BY score""")
def q_bootstrap_scores(spark, sf):
    """Paired intervals of precision-recall, ROC and Brier differences: one plan of draws for both forecasts and all scores."""
    df = three(spark, sf)
    brier = plan(spark).join(window_scores(df), "window").groupBy("draw", "model").agg((F.sum("sq") / F.sum("n")).alias("brier"))
    of = lambda c: (F.max(F.when(F.col("model") == "own", F.col(c))) - F.max(F.when(F.col("model") == "near", F.col(c)))).alias(c)
    d = ranks(spark, df).join(brier, ["draw", "model"]).groupBy("draw").agg(of("pr"), of("roc"), of("brier")).unpivot("draw", ["pr", "roc", "brier"], "score", "x").filter("x is not null")
    q = lambda at: fixed(F.percentile("x", F.lit(at)))
    return d.groupBy("score").agg(F.count("*").alias("draws"), q(0.025).alias("low"), q(0.975).alias("high"), fixed(F.avg((F.col("x") > 0).cast("int"))).alias("wins"))


_ORDER = "CASE {} WHEN 'own' THEN 0 WHEN 'near' THEN 1 ELSE 2 END"
PAIRS = f"""pairs AS (SELECT a.model AS a, b.model AS b, a."window", a.ll - b.ll AS d, a.bl - b.bl AS bd, a.y FROM lls a JOIN lls b ON a."window" = b."window" AND {_ORDER.format('a.model')} < {_ORDER.format('b.model')})"""
#: The same pairs with differences taken cell by cell: where forecasts are equal they are 0 in every cell, so a tie does not hang on the order of summation.
CELLWISE = f"""pairs AS (SELECT x.model AS a, z.model AS b, "window", sum((x.y * ln({RATE('x.p')}) - {RATE('x.p')}) - (z.y * ln({RATE('z.p')}) - {RATE('z.p')})) AS d, sum(x.y)::DOUBLE AS y
FROM three x JOIN three z USING ("window", ir, ic) WHERE {_ORDER.format('x.model')} < {_ORDER.format('z.model')} GROUP BY ALL)"""


def _order(c):
    return F.when(F.col(c) == "own", 0).when(F.col(c) == "near", 1).otherwise(2)


def pairs(df):
    """All pairs of models, in order, with their differences in each window.

    Differences are taken cell by cell (``df`` is ``abreast``), so forecasts that are equal in every cell tie exactly, in whatever order cells are summed."""
    scores = {m: cell_scores(F.col(m), F.col("y")) for m in MODELS}
    sums = {(a, b): [F.sum(x - z).alias(f"{a}_{b}_{c}") for c, x, z in zip(("d", "bd"), scores[a], scores[b])] for a, b in combinations(MODELS, 2)}
    per = df.groupBy("window").agg(F.sum("y").cast("double").alias("y"), *[x for both in sums.values() for x in both])
    rows = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{a}_{b}_d").alias("d"), F.col(f"{a}_{b}_bd").alias("bd")) for a, b in sums]
    return per.select("window", "y", F.explode(F.array(*rows)).alias("_p")).select("_p.a", "_p.b", "window", "_p.d", "_p.bd", "y")


def _interval(x):
    return F.percentile(x, F.lit(0.025)), F.percentile(x, F.lit(0.975))


@query(f"""WITH {THREE}, {PAIRS}, {plan_sql()}, g AS (SELECT a, b, draw, sum(d) / greatest(sum(y), 1) AS gain FROM plan JOIN pairs USING ("window") GROUP BY ALL),
p AS (SELECT a, b, sum(d) / greatest(sum(y), 1) AS point FROM pairs GROUP BY ALL)
SELECT a, b, {r6("any_value(point)")} AS point, {r6("quantile_cont(gain, 0.025)")} AS low, {r6("quantile_cont(gain, 0.975)")} AS high, {r6("avg((gain > 0)::INT)")} AS wins FROM g JOIN p USING (a, b) GROUP BY a, b""")
def q_pairs_models(spark, sf):
    pr = pairs(abreast(spark, sf))
    gain = F.sum("d") / F.greatest(F.sum("y"), F.lit(1.0))
    draws = plan(spark).join(pr, "window").groupBy("a", "b", "draw").agg(gain.alias("gain"))
    low, high = _interval("gain")
    out = draws.groupBy("a", "b").agg(fixed(low).alias("low"), fixed(high).alias("high"), fixed(F.avg((F.col("gain") > 0).cast("int"))).alias("wins"))
    return out.join(pr.groupBy("a", "b").agg(fixed(gain).alias("point")), ["a", "b"]).select("a", "b", "point", "low", "high", "wins")


_FLIP = f"""WITH {THREE}, {PAIRS}, {plan_sql()}, g AS (SELECT a, b, draw, sum(d) / greatest(sum(y), 1) AS gain FROM plan JOIN pairs USING ("window") GROUP BY ALL)
SELECT b AS a, a AS b, {r6("-quantile_cont(gain, 0.975)")} AS low, {r6("-quantile_cont(gain, 0.025)")} AS high FROM g GROUP BY g.a, g.b"""


@query(_FLIP)
def q_flip_pair(spark, sf):
    """Every pair seen from its other side: bounds negated and swapped."""
    draws = plan(spark).join(pairs(abreast(spark, sf)), "window").groupBy("a", "b", "draw").agg((F.sum("d") / F.greatest(F.sum("y"), F.lit(1.0))).alias("gain"))
    low, high = _interval("gain")
    return draws.groupBy("a", "b").agg(fixed(-high).alias("low"), fixed(-low).alias("high")).select(F.col("b").alias("a"), F.col("a").alias("b"), "low", "high")


_SIGN = "CASE WHEN quantile_cont({0}, 0.025) > 0 THEN 1 WHEN quantile_cont({0}, 0.975) < 0 THEN -1 ELSE 0 END"
VERDICTS = f"""{RANKS}, {PAIRS}, g AS (SELECT a, b, draw, sum(d) / greatest(sum(y), 1) AS gain FROM plan JOIN pairs USING ("window") GROUP BY ALL),
x AS (SELECT g.*, ra.pr - rb.pr AS pr FROM g JOIN ranks ra ON ra.draw = g.draw AND ra.model = g.a JOIN ranks rb ON rb.draw = g.draw AND rb.model = g.b),
v AS (SELECT a, b, {_SIGN.format('gain')} AS gain_sign, {_SIGN.format('pr')} AS pr_sign FROM x GROUP BY a, b),
verdicts AS (SELECT *, CASE WHEN gain_sign > 0 AND pr_sign > 0 THEN a || ' better' WHEN gain_sign < 0 AND pr_sign < 0 THEN b || ' better' ELSE 'not separable' END AS verdict, gain_sign <> 0 AND pr_sign <> 0 AS two_axis FROM v)"""


def verdicts(spark, sf):
    """Verdict of each pair: both intervals exclude 0 in one direction.  ``two_axis``: each does, in any direction."""
    df = three(spark, sf)
    gain = plan(spark).join(pairs(abreast(spark, sf)), "window").groupBy("a", "b", "draw").agg((F.sum("d") / F.greatest(F.sum("y"), F.lit(1.0))).alias("gain"))
    r = ranks(spark, df)
    x = gain.join(r.select(F.col("draw"), F.col("model").alias("a"), F.col("pr").alias("pa")), ["draw", "a"]).join(r.select(F.col("draw"), F.col("model").alias("b"), F.col("pr").alias("pb")), ["draw", "b"])
    x = x.withColumn("pr", F.col("pa") - F.col("pb"))

    def sign(c):
        low, high = _interval(c)
        return F.when(low > 0, 1).when(high < 0, -1).otherwise(0)

    v = x.groupBy("a", "b").agg(sign("gain").alias("gain_sign"), sign("pr").alias("pr_sign"))
    up, down = (F.col("gain_sign") > 0) & (F.col("pr_sign") > 0), (F.col("gain_sign") < 0) & (F.col("pr_sign") < 0)
    named = F.when(up, F.concat("a", F.lit(" better"))).when(down, F.concat("b", F.lit(" better"))).otherwise("not separable")
    return v.select("*", named.alias("verdict"), ((F.col("gain_sign") != 0) & (F.col("pr_sign") != 0)).alias("two_axis"))


@query(f"WITH {VERDICTS} SELECT * FROM verdicts")
def q_verdict(spark, sf):
    return verdicts(spark, sf)


@query(f"""WITH {THREE}, b AS (SELECT "window", w.range * 0.1::DOUBLE AS w, sum(y * ((1 - w.range * 0.1::DOUBLE) * ln({RATE('own')}) + w.range * 0.1::DOUBLE * ln({RATE('near')})) - pow({RATE('own')}, 1 - w.range * 0.1::DOUBLE) * pow({RATE('near')}, w.range * 0.1::DOUBLE)) AS ll, sum(y)::DOUBLE AS y
FROM pred, range(11) w GROUP BY ALL), t AS (SELECT w, sum(ll) AS ll FROM b GROUP BY w), best AS (SELECT arg_max(w, (ll, -w)) AS w FROM t), {plan_sql()},
d AS (SELECT b.w, plan.draw, sum(b.ll - o.ll) / greatest(sum(b.y), 1) AS d FROM plan JOIN b ON b."window" = plan."window" JOIN best ON true JOIN b o ON o."window" = b."window" AND o.w = best.w GROUP BY ALL),
s AS (SELECT w, stddev_pop(d) AS se FROM d GROUP BY w), p AS (SELECT b.w, sum(b.ll - o.ll) / greatest(sum(b.y), 1) AS diff FROM b JOIN best ON true JOIN b o ON o."window" = b."window" AND o.w = best.w GROUP BY b.w)
SELECT {r6("min(w) FILTER (diff >= -se)")} AS w_1se, {r6("(SELECT w FROM best)")} AS w_best FROM s JOIN p USING (w)""")
def q_w_1se(spark, sf):
    """The smallest weight of a geometric blend whose likelihood is within one paired bootstrap standard error of the best one's."""
    w, y = F.col("w"), F.col("y")
    la, lb = rate_of(F.col("own")), rate_of(F.col("near"))
    p = predictions(spark, sf).withColumn("w", F.explode(F.array(*[F.lit(k * 0.1) for k in range(11)])))
    b = p.groupBy("window", "w").agg(F.sum(y * ((1 - w) * F.log(la) + w * F.log(lb)) - F.pow(la, 1 - w) * F.pow(lb, w)).alias("ll"), F.sum(y).cast("double").alias("y"))
    best = b.groupBy("w").agg(F.sum("ll").alias("ll")).agg(F.max_by("w", F.struct("ll", -w)).alias("best"))  # eleven rows, then one
    top = b.join(F.broadcast(best), w == F.col("best")).select("window", F.col("ll").alias("top"), "best")
    d = b.join(top, "window").select("window", "w", "best", (F.col("ll") - F.col("top")).alias("d"), "y")
    rate = F.sum("d") / F.greatest(F.sum("y"), F.lit(1.0))
    se = plan(spark).join(d, "window").groupBy("w", "draw").agg(rate.alias("d")).groupBy("w").agg(F.stddev_pop("d").alias("se"))
    point = d.groupBy("w").agg(rate.alias("diff"), F.max("best").alias("best"))
    return se.join(point, "w").agg(fixed(F.min(F.when(F.col("diff") >= -F.col("se"), w))).alias("w_1se"), fixed(F.max("best")).alias("w_best"))


_BLOCKS = (2, 3, 5, 8)


@query("WITH " + THREE + ", " + PAIRS + ", " + ", ".join(plan_sql(k, name=f"plan{k}") for k in _BLOCKS) + ", every AS (" + " UNION ALL ".join(f'SELECT {k} AS block, draw, "window" FROM plan{k}' for k in _BLOCKS) + f"""),
g AS (SELECT block, a, b, draw, sum(d) / greatest(sum(y), 1) AS gain FROM every JOIN pairs USING ("window") GROUP BY ALL) SELECT block, a, b, {_SIGN.format('gain')} AS sign FROM g GROUP BY block, a, b""")
def q_block_lengths(spark, sf):
    """Whether a pair's interval excludes 0, for several mean lengths of the blocks."""
    every = plan(spark, _BLOCKS[0]).withColumn("block", F.lit(_BLOCKS[0]))
    for k in _BLOCKS[1:]:
        every = every.unionByName(plan(spark, k).withColumn("block", F.lit(k)))
    g = every.join(pairs(abreast(spark, sf)), "window").groupBy("block", "a", "b", "draw").agg((F.sum("d") / F.greatest(F.sum("y"), F.lit(1.0))).alias("gain"))
    low, high = _interval("gain")
    return g.groupBy("block", "a", "b").agg(F.when(low > 0, 1).when(high < 0, -1).otherwise(0).alias("sign"))


@query(f"""WITH {THREE}, {PAIRS}, {plan_sql()}, l AS (SELECT a, b, "window", 'poisson' AS scoring, d, y FROM pairs UNION ALL SELECT a, b, "window", 'bernoulli', bd, y FROM pairs),
g AS (SELECT a, b, scoring, draw, sum(d) / greatest(sum(y), 1) AS gain FROM plan JOIN l USING ("window") GROUP BY ALL)
SELECT a, b, scoring, {r6("quantile_cont(gain, 0.025)")} AS low, {r6("quantile_cont(gain, 0.975)")} AS high FROM g GROUP BY a, b, scoring""")
def q_two_scorings(spark, sf):
    """Every pair under two scorings side by side."""
    x = pairs(abreast(spark, sf)).select("a", "b", "window", "y", F.col("d").alias("poisson"), F.col("bd").alias("bernoulli")).unpivot(["a", "b", "window", "y"], ["poisson", "bernoulli"], "scoring", "d")
    g = plan(spark).join(x, "window").groupBy("a", "b", "scoring", "draw").agg((F.sum("d") / F.greatest(F.sum("y"), F.lit(1.0))).alias("gain"))
    low, high = _interval("gain")
    return g.groupBy("a", "b", "scoring").agg(fixed(low).alias("low"), fixed(high).alias("high"))


@query(f"""WITH {THREE}, c AS (SELECT model, sum(k * ln({RATE('p')}) - {RATE('p')}) AS count_ll, sum(y * ln({RATE('p')}) - {RATE('p')}) AS occ_ll, sum(y * ln(p) + (1 - y) * ln(1 - p)) AS bern_ll, sum(k) AS k, sum(y) AS y
FROM three JOIN (SELECT w.win AS "window", c.ir, c.ic, count(e.id) AS k FROM wins w CROSS JOIN cells c LEFT JOIN ev e ON e.win = w.win AND e.ir = c.ir AND e.ic = c.ic AND e.mag >= 2.5 GROUP BY ALL) USING ("window", ir, ic) GROUP BY model)
SELECT model, {r6("count_ll / k")} AS per_event, {r6("occ_ll / y")} AS per_cell, {r6("bern_ll / y")} AS bernoulli FROM c""")
def q_three_scorings(spark, sf):
    """Log-likelihood of counts per event, and of occurrences under the Poisson and the Bernoulli form per positive cell."""
    from rategrid.plans.base import events

    k = events(spark, sf).filter("mag >= 2.5").groupBy(F.col("win").alias("window"), "ir", "ic").agg(F.count("*").alias("k"))
    df = three(spark, sf).join(k, ["window", "ir", "ic"], "left").withColumn("k", F.coalesce("k", F.lit(0)))
    lam, p, y = rate_of(F.col("p")), F.col("p"), F.col("y")
    return df.groupBy("model").agg(
        fixed(F.sum(F.col("k") * F.log(lam) - lam) / F.sum("k")).alias("per_event"), fixed(F.sum(y * F.log(lam) - lam) / F.sum(y)).alias("per_cell"), fixed(F.sum(y * ln(p) + (1 - y) * ln(1 - p)) / F.sum(y)).alias("bernoulli")
    )


def _arm(windows: str):
    return f"""SELECT a, b, CASE WHEN sum(d) > 0 THEN a ELSE b END AS leader, {r6("sum(d) / greatest(sum(y), 1)")} AS gain FROM pairs WHERE "window" {windows} GROUP BY a, b"""


@query(f"""WITH {THREE}, {PAIRS}, early AS ({_arm('< 18')}), late AS ({_arm('>= 18')}) SELECT e.a, e.b, e.leader AS early, l.leader AS late, e.leader <> l.leader AS changed FROM early e JOIN late l USING (a, b)""")
def q_verdict_diff(spark, sf):
    """Which pairs change their leader between two arms of the evaluation."""
    pr = pairs(abreast(spark, sf)).withColumn("arm", F.when(F.col("window") < 18, "early").otherwise("late"))
    led = pr.groupBy("a", "b").pivot("arm", ["early", "late"]).agg(F.when(F.sum("d") > 0, F.first("a")).otherwise(F.first("b")))
    return led.withColumn("changed", F.col("early") != F.col("late"))


@query(f"""WITH {THREE}, {CELLWISE}, arms AS (SELECT 'early' AS arm, * FROM ({_arm('< 18')}) UNION ALL SELECT 'late', * FROM ({_arm('>= 18')}) UNION ALL SELECT 'all', * FROM ({_arm('>= 0')}))
SELECT arm, a, b, leader, gain, bool_and(leader = 'own') OVER (PARTITION BY a, b) AS anchored FROM arms""")
def q_collate(spark, sf):
    """Leaders of all arms in one table, and whether a pair keeps its anchor in every arm.  Where a pair ties, its second forecast leads."""
    arms = F.array(F.lit("all"), F.when(F.col("window") < 18, F.lit("early")).otherwise("late"))
    led = pairs(abreast(spark, sf)).withColumn("arm", F.explode(arms)).groupBy("arm", "a", "b")
    led = led.agg(F.when(F.sum("d") > 0, F.first("a")).otherwise(F.first("b")).alias("leader"), fixed(F.sum("d") / F.greatest(F.sum("y"), F.lit(1.0))).alias("gain"))
    return led.withColumn("anchored", F.bool_and(F.col("leader") == "own").over(Window.partitionBy("a", "b")))


@query(f"""WITH {THREE}, {PAIRS}, s AS (SELECT a, b, (ir < 5)::INT AS south, sum(y * (ln({RATE('p1')}) - ln({RATE('p2')})) - ({RATE('p1')} - {RATE('p2')})) / greatest(sum(y), 1) AS gain, sum(y) AS pos
FROM (SELECT x.model AS a, z.model AS b, x.ir, x.y, x.p AS p1, z.p AS p2 FROM three x JOIN three z USING ("window", ir, ic) WHERE {_ORDER.format('x.model')} < {_ORDER.format('z.model')}) GROUP BY ALL)
SELECT a, b, {r6("sum(gain * pos) / sum(pos)")} AS gain, {r6("max(gain) - min(gain)")} AS spread FROM s GROUP BY a, b""")
def q_weighted_mean(spark, sf):
    """Gains of strata put together again, weighted by their positives."""
    df = three(spark, sf)
    right = df.select("window", "ir", "ic", F.col("model").alias("b"), F.col("p").alias("p2"))
    both = df.select("window", "ir", "ic", F.col("model").alias("a"), "y", F.col("p").alias("p1")).join(right, ["window", "ir", "ic"]).filter(_order("a") < _order("b"))
    gain = metrics.information_gain(rate_of(F.col("p1")), rate_of(F.col("p2")), F.col("y"))
    s = both.groupBy("a", "b", (F.col("ir") < 5).alias("south")).agg(gain.alias("gain"), F.sum("y").alias("pos"))
    return s.groupBy("a", "b").agg(fixed(F.sum(F.col("gain") * F.col("pos")) / F.sum("pos")).alias("gain"), fixed(F.max("gain") - F.min("gain")).alias("spread"))


@query(f"""WITH {THREE}, {PAIRS}, {plan_sql()}, k AS (SELECT * FROM pairs WHERE "window" NOT BETWEEN 12 AND 15), g AS (SELECT a, b, draw, sum(d) / greatest(sum(y), 1) AS gain FROM plan JOIN k USING ("window") GROUP BY ALL),
s AS (SELECT a, b, count(*) FILTER (d > 0)::BIGINT AS plus, sum(y)::BIGINT AS pos FROM k GROUP BY a, b)
SELECT a, b, {r6("quantile_cont(gain, 0.025)")} AS low, {r6("quantile_cont(gain, 0.975)")} AS high, any_value(plus) AS plus, any_value(pos) AS pos FROM g JOIN s USING (a, b) GROUP BY a, b""")
def q_leave_out(spark, sf):
    """Intervals without the windows that overlap a period, with the positives and signs of the windows left."""
    k = pairs(abreast(spark, sf)).filter("window NOT BETWEEN 12 AND 15")
    g = plan(spark).join(k, "window").groupBy("a", "b", "draw").agg((F.sum("d") / F.greatest(F.sum("y"), F.lit(1.0))).alias("gain"))
    low, high = _interval("gain")
    s = k.groupBy("a", "b").agg(F.count_if(F.col("d") > 0).alias("plus"), F.sum("y").cast("long").alias("pos"))
    return g.groupBy("a", "b").agg(fixed(low).alias("low"), fixed(high).alias("high")).join(s, ["a", "b"])


@query(f"""WITH {THREE}, x AS (SELECT "window", own, near, y, ic, ir, (ic + 7) % 15 AS jc FROM pred), n AS (SELECT k.range AS shift, sum(x.y * (ln({RATE('x.own')}) - ln({RATE('z.own')})) - ({RATE('x.own')} - {RATE('z.own')})) / greatest(sum(x.y), 1) AS gain
FROM range(1, 15) k, x JOIN x z ON z."window" = x."window" AND z.ir = x.ir AND z.ic = (x.ic + k.range) % 15 GROUP BY k.range)
SELECT count(*)::BIGINT AS shifts, {r6("quantile_cont(gain, 0.025)")} AS low, {r6("avg(gain)")} AS mean, {r6("quantile_cont(gain, 0.975)")} AS high FROM n""")
def q_placebo_shift(spark, sf):
    """Gain over the forecast itself shifted around the lattice: the band of a null that keeps its values."""
    p = predictions(spark, sf).select("window", "ir", "ic", "y", "own")
    moved = p.withColumn("shift", F.explode(F.sequence(F.lit(1), F.lit(14)))).select("window", "ir", ((F.col("ic") - F.col("shift") + 15) % 15).alias("ic"), "shift", F.col("own").alias("other"))
    gain = metrics.information_gain(rate_of(F.col("own")), rate_of(F.col("other")), F.col("y"))
    n = p.join(moved, ["window", "ir", "ic"]).groupBy("shift").agg(gain.alias("gain"))
    low, high = _interval("gain")
    return n.agg(F.count("*").alias("shifts"), fixed(low).alias("low"), fixed(F.avg("gain")).alias("mean"), fixed(high).alias("high"))
