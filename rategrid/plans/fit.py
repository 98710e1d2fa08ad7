"""The triggering model fitted to the events, and functions that its variants and intervals need."""

import math

from pyspark.sql import functions as F

from rategrid.functions.special import clopper_pearson, tapered_omori
from rategrid.operators import likelihood
from rategrid.plans.base import CELLS, EV, events, fixed, query, r6
from rategrid.plans.model import KDE, kde
from rategrid.plans.scores import PRED, predictions

BETA, SPAN, TAU, RADIUS = 2.3, 30.0, 0.125, 1.0
#: Where the likelihood is evaluated: mu, branching ratio, alpha, c, p, d, q, gamma.
AT = dict(mu=900.0, n=0.3, alpha=0.9, c=0.02, p=1.2, d=0.4, q=1.6, gamma=0.2)
PLACED = f"""{EV}, {CELLS}, {KDE}, pt AS (SELECT id, t_us::DOUBLE / 86400000000 AS t, ic + (user_id % 5) / 10.0::DOUBLE AS x, ir + (user_id % 7) / 10.0::DOUBLE AS y, mag - 2.0::DOUBLE AS dm, u FROM ev JOIN kde USING (ir, ic) WHERE mag >= 2.0)"""


def placed(spark, sf):
    """id, t, x, y, dm and the background density at each event of magnitude 2 or more."""
    e = events(spark, sf).filter("mag >= 2.0").join(F.broadcast(kde(spark, sf)), ["ir", "ic"])  # a row for each cell
    x, y = F.col("ic") + F.col("user_id") % 5 / 10.0, F.col("ir") + F.col("user_id") % 7 / 10.0
    return e.select("id", (F.col("t_us") / 86_400_000_000).alias("t"), x.alias("x"), y.alias("y"), (F.col("mag") - 2.0).alias("dm"), "u")


def _gradient_sql() -> str:
    theta = likelihood.pack(BETA, **AT)
    v = {k: f"{float(x)!r}::DOUBLE" for k, x in likelihood.unpack(theta, BETA).items()}
    mu, k, al, c, p, d, q, ga = (v[n] for n in ("mu", "k", "alpha", "c", "p", "d", "q", "gamma"))
    ln10 = f"{math.log(10)!r}::DOUBLE"
    return f"""WITH {PLACED}, pr AS (SELECT b.id, b.u, b.t - a.t AS dt, (b.x - a.x) ** 2 + (b.y - a.y) ** 2 AS r2, a.dm, {d} * exp({ga} * {ln10} * a.dm) AS s FROM pt b JOIN pt a ON a.t < b.t AND b.t - a.t <= {TAU}::DOUBLE AND abs(a.x - b.x) <= {RADIUS} AND abs(a.y - b.y) <= {RADIUS} AND (b.x - a.x) ** 2 + (b.y - a.y) ** 2 <= {RADIUS**2}::DOUBLE),
w AS (SELECT *, {k} * exp({al} * dm) * ({p} - 1) / {c} * pow(1 + dt / {c}, -{p}) * ({q} - 1) / (pi() * s) * pow(1 + r2 / s, -{q}) AS w, {q} * (r2 / s) / (1 + r2 / s) - 1 AS wide FROM pr),
one AS (SELECT id, sum(w) AS w, sum(w * dm) AS wa, sum(w * ({p} * (dt / {c}) / (1 + dt / {c}) - 1)) AS wc, sum(w * (1 - ({p} - 1) * ln(1 + dt / {c}))) AS wp, sum(w * wide) AS wd, sum(w * (1 - ({q} - 1) * ln(1 + r2 / s))) AS wq, sum(w * {ln10} * dm * wide) AS wg FROM w GROUP BY id),
l AS (SELECT {mu} * u AS bg, {mu} * u + coalesce(w, 0) AS lam, coalesce(w, 0) AS w, coalesce(wa, 0) AS wa, coalesce(wc, 0) AS wc, coalesce(wp, 0) AS wp, coalesce(wd, 0) AS wd, coalesce(wq, 0) AS wq, coalesce(wg, 0) AS wg FROM pt LEFT JOIN one USING (id)),
pnt AS (SELECT sum(ln(lam)) AS ln, sum(bg / lam) AS own, sum(w / lam) AS w, sum(wa / lam) AS wa, sum(wc / lam) AS wc, sum(wp / lam) AS wp, sum(wd / lam) AS wd, sum(wq / lam) AS wq, sum(wg / lam) AS wg FROM l),
src AS (SELECT dm, 1 + least({SPAN}::DOUBLE - t, {TAU}::DOUBLE) / {c} AS b2, least({SPAN}::DOUBLE - t, {TAU}::DOUBLE) AS t2, {d} * exp({ga} * {ln10} * dm) AS s, {k} * exp({al} * dm) AS kap FROM pt),
i AS (SELECT *, 1 - pow(b2, 1 - {p}) AS h, 1 - pow(1 + {RADIUS**2}::DOUBLE / s, 1 - {q}) AS f, (1 - {q}) * pow(1 + {RADIUS**2}::DOUBLE / s, -{q}) * ({RADIUS**2}::DOUBLE / s) AS fd, ({q} - 1) * ln(1 + {RADIUS**2}::DOUBLE / s) * pow(1 + {RADIUS**2}::DOUBLE / s, 1 - {q}) AS fq FROM src),
itg AS (SELECT sum(kap * h * f) AS k, sum(kap * h * f * dm) AS a, sum(-kap * f * ({p} - 1) / {c} * t2 * pow(b2, -{p})) AS c, sum(kap * f * ({p} - 1) * ln(b2) * pow(b2, 1 - {p})) AS p, sum(kap * h * fd) AS d, sum(kap * h * fq) AS q, sum(kap * h * fd * {ln10} * dm) AS g FROM i)
SELECT {r6(f"{mu} * {SPAN} + itg.k - ln")} AS nll, {r6(f"{mu} * {SPAN} - own")} AS d_ln_mu, {r6("itg.k - w")} AS d_ln_n, {r6(f"a - wa + (w - itg.k) / ({BETA} - {al})")} AS d_alpha, {r6("c - wc")} AS d_ln_c, {r6("itg.p - wp")} AS d_ln_p1, {r6("itg.d - wd")} AS d_ln_d, {r6("itg.q - wq")} AS d_ln_q1, {r6("itg.g - wg")} AS d_gamma FROM pnt, itg"""


@query(_gradient_sql())
def q_nll_gradient(spark, sf):
    """The negative log-likelihood and its derivatives in all eight parameters."""
    row = likelihood.Problem.of(placed(spark, sf), SPAN, TAU, RADIUS, BETA).sums(likelihood.pack(BETA, **AT))
    return row.select(*[fixed(F.col(c)).alias(c) for c in row.columns])


@query(None)
def q_model_fit(spark, sf):
    """The parameters that fit the events best, by projected quasi-Newton steps, and whether the search settled."""
    theta, nll, settled = likelihood.fit(placed(spark, sf), SPAN, TAU, RADIUS, BETA, starts=1, tol=1e-5)
    rows = [(k, round(float(x), 6)) for k, x in likelihood.unpack(theta, BETA).items()]
    return spark.createDataFrame([*rows, ("nll", round(nll, 4)), ("settled", float(settled))], "name string, value double")


_C, _OMEGA, _TAPER, _NODES = 0.02, 0.3, 6.0, 400
#: Simpson's rule over ln(t + c).
_SIMPSON = f"""list_sum(list_transform(range({_NODES + 1}), lambda i: CASE WHEN i IN (0, {_NODES}) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(-(exp(ln({_C}::DOUBLE) + i * h) - {_C}::DOUBLE) / {_TAPER}::DOUBLE) * exp(-{_OMEGA}::DOUBLE * (ln({_C}::DOUBLE) + i * h)))) * h / 3"""


@query(f"""WITH {EV}, a AS (SELECT id, ln((2592000000000 - t_us)::DOUBLE / 86400000000 / {_C}::DOUBLE + 1) / {_NODES} AS h FROM ev WHERE mag >= 2.5 AND t_us < 2592000000000) SELECT id, {r6(_SIMPSON)} AS mass FROM a""")
def q_tapered_omori(spark, sf):
    """What each event's tapered waiting times give until the end of the catalog, in units of its productivity."""
    age = (F.lit(2_592_000_000_000) - F.col("t_us")) / 86_400_000_000
    return events(spark, sf).filter("mag >= 2.5 AND t_us < 2592000000000").select("id", fixed(tapered_omori(F.lit(0.0), age, _C, _OMEGA, _TAPER)).alias("mass"))


def _tail(side: str, mid: str) -> str:
    among = "range(k, n + 1)" if side == "low" else "range(0, k + 1)"
    return f"list_sum(list_transform({among}, lambda i: exp(lgamma(n + 1.0) - lgamma(i + 1.0) - lgamma(n - i + 1.0) + i * ln({mid}) + (n - i) * ln(1 - {mid}))))"


@query(f"""WITH RECURSIVE {PRED}, s AS (SELECT ir, sum(y)::BIGINT AS k, count(*)::BIGINT AS n FROM pred GROUP BY ir),
b AS (SELECT ir, k, n, 0.0::DOUBLE AS l0, 1.0::DOUBLE AS l1, 0.0::DOUBLE AS h0, 1.0::DOUBLE AS h1, 0 AS i FROM s UNION ALL
  SELECT ir, k, n, CASE WHEN {_tail("low", "((l0 + l1) / 2)")} < 0.025 THEN (l0 + l1) / 2 ELSE l0 END, CASE WHEN {_tail("low", "((l0 + l1) / 2)")} < 0.025 THEN l1 ELSE (l0 + l1) / 2 END,
    CASE WHEN {_tail("high", "((h0 + h1) / 2)")} > 0.025 THEN (h0 + h1) / 2 ELSE h0 END, CASE WHEN {_tail("high", "((h0 + h1) / 2)")} > 0.025 THEN h1 ELSE (h0 + h1) / 2 END, i + 1 FROM b WHERE i < 44)
SELECT ir, {r6("CASE WHEN k = 0 THEN 0 ELSE (l0 + l1) / 2 END")} AS low, {r6("CASE WHEN k = n THEN 1 ELSE (h0 + h1) / 2 END")} AS high FROM b WHERE i = 44""")
def q_clopper_pearson(spark, sf):
    """The exact interval of the share of cells with an event, by row."""
    s = predictions(spark, sf).groupBy("ir").agg(F.sum("y").alias("k"), F.count("*").alias("n"))
    low, high = clopper_pearson(F.col("k"), F.col("n"))
    return s.select("ir", fixed(low).alias("low"), fixed(high).alias("high"))
