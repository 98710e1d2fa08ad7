"""The likelihood against plain sums, its derivatives against differences, and the fit on simulated events."""

import math

import numpy as np
import pytest

from rategrid.operators import likelihood as lk

BETA = 2.3
EVENTS = "id long, t double, x double, y double, dm double, u double"


def simulated(seed, mu, n, alpha, c, p, d, q, gamma, span, side=40.0):
    """Background at random places and their offspring, generation by generation."""
    r = np.random.default_rng(seed)
    k = n * (BETA - alpha) / BETA
    make = lambda size: r.exponential(1 / BETA, size).clip(0, 4)
    size = r.poisson(mu * span)
    now = np.column_stack([r.uniform(0, span, size), r.uniform(0, side, size), r.uniform(0, side, size), make(size)])
    out = [now]
    while len(now):
        children = r.poisson(k * np.exp(alpha * now[:, 3]))
        parent = np.repeat(now, children, axis=0)
        u, v, turn = r.random(len(parent)), r.random(len(parent)), r.uniform(0, 2 * math.pi, len(parent))
        t = parent[:, 0] + c * ((1 - u) ** (-1 / (p - 1)) - 1)
        radius = np.sqrt(d * 10 ** (gamma * parent[:, 3]) * ((1 - v) ** (-1 / (q - 1)) - 1))
        now = np.column_stack([t, parent[:, 1] + radius * np.cos(turn), parent[:, 2] + radius * np.sin(turn), make(len(parent))])
        now = now[now[:, 0] < span]
        out.append(now)
    rows = np.concatenate(out)
    return [(i, *map(float, row), 1 / side**2) for i, row in enumerate(rows[rows[:, 0].argsort()])]


def plain(rows, theta, span, tau, radius):
    v = lk.unpack(theta, BETA)
    nll = v["mu"] * span
    for _, t, x, y, dm, u in rows:
        s = v["d"] * 10 ** (v["gamma"] * dm)
        t1, t2 = min(max(-t, 0), tau), min(span - t, tau)
        nll += v["k"] * math.exp(v["alpha"] * dm) * ((1 + t1 / v["c"]) ** (1 - v["p"]) - (1 + t2 / v["c"]) ** (1 - v["p"])) * (1 - (1 + radius**2 / s) ** (1 - v["q"]))
        if t < 0:
            continue
        lam = v["mu"] * u
        for _, t0, x0, y0, dm0, _ in rows:
            dt, r2 = t - t0, (x - x0) ** 2 + (y - y0) ** 2
            if 0 < dt <= tau and r2 <= radius**2:
                s0 = v["d"] * 10 ** (v["gamma"] * dm0)
                lam += v["k"] * math.exp(v["alpha"] * dm0) * (v["p"] - 1) / v["c"] * (1 + dt / v["c"]) ** -v["p"] * (v["q"] - 1) / (math.pi * s0) * (1 + r2 / s0) ** -v["q"]
        nll -= math.log(lam)
    return nll


TRUE = dict(mu=6.0, n=0.5, alpha=1.2, c=0.02, p=1.3, d=0.5, q=1.9, gamma=0.3)


def test_likelihood_and_all_derivatives(spark):
    rows = simulated(1, **{**TRUE, "mu": 2.0}, span=40.0)
    rows = [(i, t - 10, x, y, dm, u) for i, t, x, y, dm, u in rows]  # the first ten days only trigger
    problem = lk.Problem.of(spark.createDataFrame(rows, EVENTS), 30.0, 5.0, 6.0, BETA)
    theta = lk.pack(BETA, 3.0, 0.4, 0.9, 0.03, 1.2, 0.8, 1.7, 0.5)
    value, grad = problem.value(theta)
    assert value == pytest.approx(plain(rows, theta, 30.0, 5.0, 6.0), rel=1e-10)
    for i in range(8):
        ends = []
        for step in (1e-5, -1e-5):
            moved = theta.copy()
            moved[i] += step
            ends.append(plain(rows, moved, 30.0, 5.0, 6.0))
        assert grad[i] == pytest.approx((ends[0] - ends[1]) / 2e-5, rel=1e-5, abs=1e-4), lk.NAMES[i]


def test_steps_sum_pairs_without_a_shuffle(spark):
    rows = simulated(2, **{**TRUE, "mu": 1.0}, span=20.0)
    problem = lk.Problem.of(spark.createDataFrame(rows, EVENTS), 20.0, 5.0, 6.0, BETA)
    by_event = problem.pairs.groupBy("id").count()
    plan = by_event._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and by_event.count() == len(rows)


def test_fit_finds_the_parameters(spark):
    """As the likelihood is flat in some directions, the branching ratio, background and value are what must come back."""
    rows = simulated(5, **TRUE, span=150.0)
    events = spark.createDataFrame(rows, EVENTS).repartition(4)
    theta, value, settled = lk.fit(events, 150.0, 150.0, 60.0, BETA, starts=1)
    v, true = lk.unpack(theta, BETA), lk.pack(BETA, **TRUE)
    assert settled and value <= lk.Problem.of(events, 150.0, 150.0, 60.0, BETA).value(true)[0] + 1e-6
    n = v["k"] * BETA / (BETA - v["alpha"])
    assert n == pytest.approx(TRUE["n"], abs=0.12) and v["mu"] == pytest.approx(TRUE["mu"], rel=0.25)
    assert 0.6 < v["alpha"] < 1.8 and 1.1 < v["p"] < 1.7 and 1.4 < v["q"] < 3.0


def test_minimise_at_bounds():
    value = lambda x: (float(((x - [3, -1, 0.2]) ** 2 * [1, 10, 100]).sum()), 2 * (x - [3, -1, 0.2]) * [1, 10, 100])
    theta, f, settled = lk.minimise(value, np.array([0.5, 0.5, 0.9]), np.zeros(3), np.ones(3))
    assert settled and theta == pytest.approx([1, 0, 0.2], abs=1e-4)
