"""Consistency with catalogs, and what forecasts owe to their features."""

from pyspark.sql import functions as F

from rategrid.operators import consistency
from rategrid.operators.importance import importance
from rategrid.plans.base import EV, events, fixed, query, r6
from rategrid.plans.features import CUBE, feature_cube
from rategrid.plans.model import EXPECTED, expected_counts

SIMS = 20


@query(f"""WITH {EXPECTED}, rt AS (SELECT ir, ic, sum(lam) / {SIMS} AS lam FROM expected GROUP BY ALL), lg AS (SELECT ir, ic, ln(greatest(lam / sum(lam) OVER (), 1e-12)) AS s, ln(greatest(lam, 1e-12)) AS pl FROM rt),
ct AS (SELECT id % {SIMS} AS catalog, ir, ic, count(*) AS n FROM ev WHERE win >= 7 AND mag >= 2.0 GROUP BY ALL), sc AS (SELECT k.range AS catalog, coalesce(sum(n), 0) AS n, coalesce(sum(n * s), 0) AS s, coalesce(sum(n * pl), 0) AS pl FROM range({SIMS}) k LEFT JOIN ct ON ct.catalog = k.range LEFT JOIN lg USING (ir, ic) GROUP BY k.range),
v AS (SELECT count(*)::BIGINT AS catalogs, avg((x.n >= o.n)::INT) AS delta1, avg((x.n <= o.n)::INT) AS delta2, avg((x.s <= o.s)::INT) AS s, avg((x.pl <= o.pl)::INT) AS pl FROM sc x, sc o WHERE o.catalog = 0 AND x.catalog > 0)
SELECT catalogs, {r6('delta1')} AS delta1, {r6('delta2')} AS delta2, {r6('s')} AS s, {r6('pl')} AS pl, least(delta1, delta2) > 0.025 AS n_passes, s BETWEEN 0.025 AND 0.975 AS s_passes, pl BETWEEN 0.025 AND 0.975 AS pl_passes FROM v""")
def q_csep_quantile(spark, sf):
    """Number, space and likelihood tests of one catalog against the others that a forecast is to explain; catalog 0 is the observed one."""
    rates = expected_counts(spark, sf).groupBy("ir", "ic").agg((F.sum("lam") / float(SIMS)).alias("lam"))
    counts = events(spark, sf).filter("win >= 7 AND mag >= 2.0").groupBy((F.col("id") % SIMS).alias("catalog"), "ir", "ic").agg(F.count("*").alias("n"))
    scores = consistency.catalog_scores(counts, rates, spark.range(SIMS).select(F.col("id").alias("catalog")), ["ir", "ic"])
    v = consistency.verdicts(scores, 0)
    return v.select("catalogs", *[fixed(F.col(c)).alias(c) for c in ("delta1", "delta2", "s", "pl")], "n_passes", "s_passes", "pl_passes")


#: Features that move together.
GROUPS = {"own": ["cnt1", "cnt7"], "around": ["nbr3_cnt7"], "size": ["maxmag"], "counts": ["cnt1", "cnt7", "nbr3_cnt7"]}
_LAM = "(0.02::DOUBLE + 0.04::DOUBLE * cnt1 + 0.05::DOUBLE * cnt7 + 0.015::DOUBLE * nbr3_cnt7 + 0.03::DOUBLE * maxmag)"


def _rate():
    return 0.02 + 0.04 * F.col("cnt1") + 0.05 * F.col("cnt7") + 0.015 * F.col("nbr3_cnt7") + 0.03 * F.col("maxmag")


def _score(lam):
    return F.sum(F.col("y") * F.log(lam) - lam) / F.greatest(F.sum("y"), F.lit(1)).cast("double")


def _permuted_sql(scope: str, name: str, columns: list[str]) -> str:
    by = 'PARTITION BY "window"' if scope == "window" else ""
    hexa = lambda side: f"""('0x' || substr(md5('{scope}-{name}{side}-' || "window" || '-' || ir || '-' || ic), 1, 8))::BIGINT"""
    both = "cnt1 cnt7 nbr3_cnt7 maxmag".split()
    taken = ", ".join(f"{'s' if c in columns else 't'}.{c}" for c in both)
    rows = lambda side: f"""(SELECT *, row_number() OVER ({by} ORDER BY {hexa(side)}, "window", ir, ic) AS r FROM cube)"""
    on = 't.r = s.r AND t."window" = s."window"' if scope == "window" else "t.r = s.r"
    return f"SELECT '{scope}' AS scope, '{name}' AS name, t.y, {taken} FROM {rows('a')} t JOIN {rows('b')} s ON {on}"


_ALL = " UNION ALL ".join(["SELECT s.scope, 'all' AS name, y, cnt1, cnt7, nbr3_cnt7, maxmag FROM cube, (VALUES ('window'), ('global')) s(scope)", *[_permuted_sql(s, n, c) for s in ("window", "global") for n, c in GROUPS.items()]])


@query(f"""WITH {CUBE}, e AS ({_ALL}), s AS (SELECT scope, name, sum(y * ln({_LAM}) - {_LAM}) / greatest(sum(y), 1)::DOUBLE AS score FROM e GROUP BY ALL)
SELECT s.scope, s.name, {r6('s.score')} AS score, {r6('a.score - s.score')} AS loss FROM s JOIN s a ON a.scope = s.scope AND a.name = 'all'""")
def q_permutation_importance(spark, sf):
    """What a forecast loses when groups of its features are permuted among the cells of a window, and among all rows."""
    c = feature_cube(spark, sf).select("window", "ir", "ic", "y", "cnt1", "cnt7", "nbr3_cnt7", "maxmag")
    key = ["window", "ir", "ic"]
    within = importance(c, GROUPS, _rate, _score, ["window"], key, "window").withColumn("scope", F.lit("window"))
    among = importance(c, GROUPS, _rate, _score, [], key, "global", 16).withColumn("scope", F.lit("global"))
    return within.unionByName(among).select("scope", "name", fixed(F.col("score")).alias("score"), fixed(F.col("loss")).alias("loss"))


_FACTORS = [(a, b) for a in (0.02, 0.05, 0.1, 0.2) for b in (0.0, 0.01, 0.02, 0.05)]
_CANDIDATES = ", ".join(f"({k}, {a}::DOUBLE, {b}::DOUBLE)" for k, (a, b) in enumerate(_FACTORS))


@query(f"""WITH {CUBE}, f(k, a, b) AS (VALUES {_CANDIDATES}), s AS (SELECT k, a, b, sum(y * ln(0.02::DOUBLE + a * cnt7 + b * nbr3_cnt7) - (0.02::DOUBLE + a * cnt7 + b * nbr3_cnt7)) AS ll FROM cube, f WHERE "window" BETWEEN 15 AND 19 GROUP BY ALL)
SELECT k::BIGINT AS k, a, b, {r6('ll')} AS ll, k = (SELECT arg_max(k, (ll, -k)) FROM s) AS chosen FROM s""")
def q_candidate_sweep(spark, sf):
    """The likelihood of every combination of two factors on validation windows, in one aggregation; the first best is chosen."""
    c = feature_cube(spark, sf).filter("window BETWEEN 15 AND 19")
    lam = lambda a, b: 0.02 + a * F.col("cnt7") + b * F.col("nbr3_cnt7")
    ll = lambda x: F.sum(F.col("y") * F.log(x) - x)
    rows = [F.struct(F.lit(k).cast("long").alias("k"), F.lit(a).alias("a"), F.lit(b).alias("b"), ll(lam(a, b)).alias("ll")) for k, (a, b) in enumerate(_FACTORS)]
    s = c.agg(F.array(*rows).alias("s"))
    best = F.array_max(F.transform("s", lambda x: F.struct(x["ll"], -x["k"])))
    return s.select(F.explode("s").alias("x"), (-best["col2"]).alias("best")).select("x.k", "x.a", "x.b", fixed(F.col("x.ll")).alias("ll"), (F.col("x.k") == F.col("best")).alias("chosen"))


_BASE = dict(k=0.3, alpha=0.8, c=0.02, p=1.2)


def _mass_sql(v: dict) -> str:
    return f"sum({v['k']!r}::DOUBLE * exp({v['alpha']!r}::DOUBLE * (mag - 2)) * (1 - pow(1 + 1 / {v['c']!r}::DOUBLE, 1 - {v['p']!r}::DOUBLE)))"


_SHIFTED = {"base": _BASE, **{n: {**_BASE, n: x * 1.1} for n, x in _BASE.items()}}


@query(f"""WITH {EV}, m AS (SELECT {", ".join(f"{_mass_sql(v)} AS {n}_" for n, v in _SHIFTED.items())} FROM ev WHERE mag >= 2.0), u AS (UNPIVOT m ON {", ".join(f"{n}_" for n in _SHIFTED if n != "base")} INTO NAME name VALUE mass)
SELECT rtrim(name, '_') AS name, {r6('mass / base_ - 1')} AS change, {r6('abs(mass / base_ - 1) / (1 - pow(10, -0.1::DOUBLE))')} AS of_b FROM u""")
def q_perturbation(spark, sf):
    """What ten percent more of each parameter changes in the offspring of a day, and how much that is of what a slope 0.1 higher changes one magnitude up."""
    mass = lambda v: F.sum(v["k"] * F.exp(v["alpha"] * (F.col("mag") - 2)) * (1 - F.pow(F.lit(1 + 1 / v["c"]), F.lit(1 - v["p"]))))
    m = events(spark, sf).filter("mag >= 2.0").agg(*[mass(v).alias(n) for n, v in _SHIFTED.items()])
    u = m.unpivot("base", [n for n in _SHIFTED if n != "base"], "name", "mass").withColumn("change", F.col("mass") / F.col("base") - 1)
    return u.select("name", fixed(F.col("change")).alias("change"), fixed(F.abs("change") / (1 - 10**-0.1)).alias("of_b"))
