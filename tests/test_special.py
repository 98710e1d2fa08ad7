"""Special functions against tabulated values, which are the published ones to ten digits or more, and identities."""

import math

import pytest
from pyspark.sql import functions as F

from rategrid.functions import special as sp


def values(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first().asDict()


def test_log_gamma(spark):
    xs = [1e-3, 0.5, 1.0, 1.5, 2.0, 7.25, 100.0, 1e5]
    got = values(spark, **{f"v{i}": sp.log_gamma(F.lit(x)) for i, x in enumerate(xs)})
    for i, x in enumerate(xs):
        assert got[f"v{i}"] == pytest.approx(math.lgamma(x), rel=1e-12, abs=1e-13)


def test_upper_gamma(spark):
    # fixed values: Gamma(1/2, x) = sqrt(pi) erfc(sqrt x); E1(0.1), E1(1), E1(5)
    e1 = {0.1: 1.8229239584193906, 1.0: 0.21938393439552029, 5.0: 0.0011482955912753257}
    got = values(spark, **{f"e{i}": sp.upper_gamma(0.0, F.lit(x)) for i, x in enumerate(e1)})
    assert [got[f"e{i}"] for i in range(3)] == pytest.approx(list(e1.values()), rel=1e-11)
    xs = [1e-6, 0.01, 0.5, 0.999, 1.0, 3.0, 40.0]
    half = values(spark, **{f"v{i}": sp.upper_gamma(0.5, F.lit(x)) for i, x in enumerate(xs)})
    assert [half[f"v{i}"] for i in range(len(xs))] == pytest.approx([math.sqrt(math.pi) * math.erfc(math.sqrt(x)) for x in xs], rel=1e-10)
    low = values(spark, **{f"v{i}": sp.upper_gamma(-0.5, F.lit(x)) for i, x in enumerate(xs)})
    want = [2 * math.exp(-x) / math.sqrt(x) - 2 * math.sqrt(math.pi) * math.erfc(math.sqrt(x)) for x in xs]
    assert [low[f"v{i}"] for i in range(4)] == pytest.approx(want[:4], rel=1e-10)
    assert [low[f"v{i}"] for i in range(4, 6)] == pytest.approx(want[4:6], rel=1e-9)
    with pytest.raises(ValueError):
        sp.upper_gamma(-2.0, F.lit(1.0))


def test_tapered_omori_against_quadrature(spark):
    c, omega, tau = 0.02, 0.3, 6.0
    for t1, t2 in ((0.0, 0.5), (0.1, 30.0), (5.0, 200.0)):
        n, a, b = 20_000, math.log(t1 + c), math.log(t2 + c)
        h = (b - a) / n
        f = lambda u: math.exp(-(math.exp(u) - c) / tau) * math.exp(-omega * u)
        want = h / 3 * sum((1 if i in (0, n) else 4 if i % 2 else 2) * f(a + i * h) for i in range(n + 1))
        assert values(spark, v=sp.tapered_omori(F.lit(t1), F.lit(t2), c, omega, tau))["v"] == pytest.approx(want, rel=1e-9)


def test_beta_and_its_inverse(spark):
    # I_x(a, b) for whole numbers is a binomial tail
    for x, a, b in ((0.3, 2, 5), (0.9, 7, 3), (0.5, 50, 50), (0.01, 1, 300), (0.2, 900, 4000)):
        n = a + b - 1
        tail = math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(x) + (n - j) * math.log(1 - x)) for j in range(a, n + 1))
        got = values(spark, v=sp.regular_beta(F.lit(x), F.lit(float(a)), F.lit(float(b))), q=sp.beta_quantile(F.lit(tail), F.lit(float(a)), F.lit(float(b))))
        assert got["v"] == pytest.approx(tail, rel=1e-9) and got["q"] == pytest.approx(x, abs=1e-6 if 1e-12 < tail < 1 - 1e-9 else 1)
    ends = values(spark, a=sp.regular_beta(F.lit(0.0), F.lit(2.0), F.lit(3.0)), b=sp.regular_beta(F.lit(1.0), F.lit(2.0), F.lit(3.0)))
    assert ends == {"a": 0.0, "b": 1.0}


def test_clopper_pearson(spark):
    # fixed values: published 95 % intervals of 0, 1, 5 and 10 out of 10
    table = {0: (0.0, 0.3084971078), 1: (0.0025285785, 0.4450161170), 5: (0.1870860284, 0.8129139716), 10: (0.6915028922, 1.0)}
    df = spark.createDataFrame([(k, 10) for k in table] + [(0, 0)], "k long, n long")
    low, high = sp.clopper_pearson(F.col("k"), F.col("n"))
    got = {(r["k"], r["n"]): (r["low"], r["high"]) for r in df.select("k", "n", low.alias("low"), high.alias("high")).collect()}
    assert got[0, 0] == (None, None)
    for k, want in table.items():
        assert got[k, 10] == pytest.approx(want, abs=1e-9)
