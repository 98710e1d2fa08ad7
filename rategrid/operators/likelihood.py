"""Maximum likelihood of the space-time triggering model.

Events (id, t in days, x, y, dm: magnitude above the threshold, u: background density at the place) before t = 0 only trigger; those from 0 to
``span`` count.  The rate at an event is ``mu u`` and, summed over earlier events within ``tau`` days and a distance of ``radius``,

    k exp(alpha dm)  (p - 1) / c (1 + dt / c)^-p  (q - 1) / (pi s) (1 + r^2 / s)^-q,   s = d 10^(gamma dm).

Parameters are kept as theta = ln mu, ln n, alpha, ln c, ln(p - 1), ln d, ln(q - 1), gamma, with the branching ratio n = k beta / (beta - alpha).

Pairs grow with the square of the events' density, so none are written.  Events are, once, in buckets by bands of the plane and blocks of time, each
to those it can trigger in, so an evaluation of the likelihood and its eight derivatives needs no shuffle, and one row of sums comes to the driver.
Within a block few events meet as pairs; for many, what sources add at a place are running sums: time is cut into parts, and in a part the kernel is a
polynomial of both times.  Steps in the driver are projected quasi-Newton steps on eight numbers.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rategrid.operators import joins
from rategrid.operators.kernel_sums import _AT, NODES, _basis
from rategrid.sources.shared import bucketed_table, materialize

LN10 = math.log(10)
NAMES = ("ln_mu", "ln_n", "alpha", "ln_c", "ln_p1", "ln_d", "ln_q1", "gamma")
TICKS = 1_000_000  # of a day, for the buckets of time that pairs meet in


def bounds(beta: float) -> tuple[np.ndarray, np.ndarray]:
    """Lowest and highest theta."""
    low = [math.log(1e-4), math.log(1e-3), 0.05, math.log(5e-4), math.log(0.02), math.log(1e-3), math.log(0.08), 0.0]
    high = [math.log(1e6), math.log(0.99), min(3.2, beta - 0.02), math.log(3.0), math.log(1.5), math.log(400.0), math.log(2.5), 1.5]
    return np.array(low), np.array(high)


def unpack(theta, beta: float) -> dict:
    """mu, k, alpha, c, p, d, q, gamma."""
    n, alpha = math.exp(theta[1]), theta[2]
    return {
        "mu": math.exp(theta[0]), "k": n * (beta - alpha) / beta, "alpha": alpha, "c": math.exp(theta[3]), "p": 1 + math.exp(theta[4]), "d": math.exp(theta[5]),
        "q": 1 + math.exp(theta[6]), "gamma": theta[7],
    }


def pack(beta: float, mu: float, n: float, alpha: float, c: float, p: float, d: float, q: float, gamma: float) -> np.ndarray:
    return np.array([math.log(mu), math.log(n), alpha, math.log(c), math.log(p - 1), math.log(d), math.log(q - 1), gamma])


def pairs(events: DataFrame, tau: float, radius: float) -> DataFrame:
    """id, u, dt, r2, dm: of every target one row by itself (dt null) and one for each earlier event within ``tau`` and ``radius``.

    Pairs meet on squares as wide as the radius and on buckets of time.
    """
    at = events.withColumn("_t", F.floor(F.col("t") * TICKS)).withColumn("_i", F.floor(F.col("x") / radius)).withColumn("_j", F.floor(F.col("y") / radius))
    later = at.filter("t >= 0").select("id", "u", F.col("t").alias("t1"), F.col("x").alias("x1"), F.col("y").alias("y1"), "_t", "_i", "_j")
    reach = int(math.ceil(tau * TICKS)) + 1
    around = F.array(*[F.lit(k) for k in (-1, 0, 1)])
    source = at.select(F.col("id").alias("src"), "t", "x", "y", "dm", F.col("_t").alias("_low"), (F.col("_t") + reach).alias("_high"), "_i", "_j")
    source = source.withColumn("_di", F.explode(around)).withColumn("_dj", F.explode(around)).withColumn("_i", F.col("_i") + F.col("_di")).withColumn("_j", F.col("_j") + F.col("_dj")).drop("_di", "_dj")
    met = joins.range_join(later, source, "_t", "_low", "_high", reach, ("_i", "_j"))
    dt, dx, dy = F.col("t1") - F.col("t"), F.col("x1") - F.col("x"), F.col("y1") - F.col("y")
    met = met.select("id", "u", dt.alias("dt"), (dx * dx + dy * dy).alias("r2"), "dm")
    met = met.filter((F.col("dt") > 0) & (F.col("dt") <= tau) & (F.col("r2") <= radius * radius))
    alone = later.select("id", "u", *[F.lit(None).cast("double").alias(c) for c in ("dt", "r2", "dm")])
    return met.unionByName(alone)


def blocks(events: DataFrame, tau: float, radius: float) -> DataFrame:
    """Events by ``_j``, bands as high as the radius, and ``_b``, blocks of ``tau``: as ``own`` in the one where they lie, and without u in all where they can
    trigger.  An event without a place is in a band of its own."""
    band = F.coalesce(F.floor(F.col("y") / radius), F.lit(0))
    first, last = F.floor(F.col("t") / tau), F.floor((F.col("t") + tau * (1 + 1e-9)) / tau)
    rows = events.select("t", "x", "y", "dm", "u", band.alias("_j"), first.alias("_b"), F.explode(F.array(*[F.lit(k) for k in (-1, 0, 1)])).alias("_dj"), last.alias("_last"))
    rows = rows.withColumn("_k", F.explode(F.sequence("_b", "_last")))
    own = (F.col("_dj") == 0) & (F.col("_k") == F.col("_b")) & (F.col("t") >= 0) & F.col("u").isNotNull()
    placed = F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("dm").isNotNull()
    return rows.select((F.col("_j") + F.col("_dj")).alias("_j"), F.col("_k").alias("_b"), "t", "x", "y", "dm", F.when(own, F.col("u")).alias("u"), own.alias("own")).filter(placed | F.col("own"))


@dataclass
class Problem:
    """The data of a likelihood: events in blocks, and the sources with the span of time in which they can trigger."""

    events: DataFrame
    blocks: DataFrame
    sources: DataFrame
    span: float
    tau: float
    radius: float
    beta: float

    @classmethod
    def of(cls, events: DataFrame, span: float, tau: float, radius: float, beta: float) -> Problem:
        events = materialize(events.select("id", "t", "x", "y", "dm", "u").filter(F.col("t") < span), "fit-events")
        spark = events.sparkSession
        buckets = min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(spark.sparkContext.defaultParallelism, events.count() // 8_000))  # each step runs a task a bucket
        written = bucketed_table(blocks(events, tau, radius), "blocks", ["_j", "_b"], buckets)
        ends = F.least(F.lit(span) - F.col("t"), F.lit(tau))
        sources = materialize(events.select("dm", F.least(F.greatest(-F.col("t"), F.lit(0.0)), F.lit(tau)).alias("t1"), ends.alias("t2")), "fit-sources")
        return cls(events, written, sources, span, tau, radius, beta)

    @cached_property
    def pairs(self) -> DataFrame:
        """The pairs themselves, in buckets by event; written when first asked for, and not needed for the likelihood."""
        return bucketed_table(pairs(self.events, self.tau, self.radius), "pairs", ["id"])

    def value(self, theta) -> tuple[float, np.ndarray]:
        """The negative log-likelihood and its derivatives at ``theta``."""
        row = self.sums(theta).first()
        return row["nll"], np.array([row[f"d_{n}"] for n in NAMES])

    def sums(self, theta) -> DataFrame:
        """One row: nll and d_<name> for each parameter."""
        v = unpack(theta, self.beta)
        mu, k, alpha, c, p, d, q, gamma = (float(v[n]) for n in ("mu", "k", "alpha", "c", "p", "d", "q", "gamma"))
        kernels, tau, radius = _Kernels(k, alpha, c, p, d, q, gamma), self.tau, self.radius

        def summed(key: tuple, table: pa.Table) -> pa.Table:
            t, x, y, dm, u = (table.column(n).to_numpy() for n in ("t", "x", "y", "dm", "u"))
            own = table.column("own").to_numpy()
            w = _rates(kernels, tau, radius, key[1].as_py(), t, x, y, dm, own)
            lam = mu * u[own] + w[:, 0]
            one = [np.log(lam).sum(), (mu * u[own] / lam).sum(), *(w / lam[:, None]).sum(axis=0)]
            return pa.table({n: [float(z)] for n, z in zip(_SUMS, one)})

        rows = self.blocks.groupBy("_j", "_b").applyInArrow(summed, ", ".join(f"{n} double" for n in _SUMS))
        points = rows.agg(*[F.sum(n).alias(n) for n in _SUMS])
        joined = points.crossJoin(F.broadcast(self.sources.agg(*_integrals(k, alpha, c, p, d, q, gamma, self.radius))))  # one row each
        g = lambda a, b: F.col(a) - F.col(b)
        grad = {
            "ln_mu": F.col("own") - mu * self.span, "ln_n": g("w", "i_k"), "alpha": g("w_alpha", "i_alpha") - g("w", "i_k") / (self.beta - alpha), "ln_c": g("w_c", "i_c"),
            "ln_p1": g("w_p", "i_p"), "ln_d": g("w_d", "i_d"), "ln_q1": g("w_q", "i_q"), "gamma": g("w_g", "i_g"),
        }
        return joined.select((mu * self.span + F.col("i_k") - F.col("ln")).alias("nll"), *[(-x).alias(f"d_{n}") for n, x in grad.items()])


_SUMS = ("ln", "own", "w", "w_alpha", "w_d", "w_q", "w_g", "w_c", "w_p")
WHOLE = 200_000  # pairs of a block that are met at once
CHUNK = 1_000_000  # pairs in memory at once


@dataclass
class _Kernels:
    """What a source adds to a rate is a function of time times one of distance and magnitude, and so are the derivatives that are weighted by it."""

    k: float
    alpha: float
    c: float
    p: float
    d: float
    q: float
    gamma: float

    def time(self, dt: np.ndarray) -> tuple:
        """Of the rate, and of its derivatives in ln c and ln (p - 1)."""
        a = 1 + dt / self.c
        ln = np.log(a)
        f = np.exp(-self.p * ln)
        return f, f * (self.p * (dt / self.c) / a - 1), f * (1 - (self.p - 1) * ln)

    def place(self, r2: np.ndarray, dm: np.ndarray) -> tuple:
        """Of the rate, and of its derivatives in alpha, ln d, ln (q - 1) and gamma."""
        s = self.d * np.exp(self.gamma * LN10 * dm)
        f = r2 / s
        b = 1 + f
        ln = np.log(b)
        w = self.k * np.exp(self.alpha * dm) * ((self.p - 1) / self.c) * (self.q - 1) / (math.pi * s) * np.exp(-self.q * ln)
        wide = w * (self.q * f / b - 1)
        return w, w * dm, wide, w * (1 - (self.q - 1) * ln), wide * LN10 * dm


def _rates(kernels: _Kernels, tau: float, radius: float, block: int, t, x, y, dm, own) -> np.ndarray:
    """For each of a block's own events the sums over its sources, in the order of _SUMS from w on."""
    out = np.zeros((int(own.sum()), 7))
    known = np.flatnonzero(~(np.isnan(x) | np.isnan(y) | np.isnan(dm)))
    known = known[np.argsort(t[known], kind="stable")]
    source = (t[known], x[known], y[known], dm[known])
    asked = (t[own], x[own], y[own])
    if len(out) * len(known) <= WHOLE:
        _met(kernels, tau, radius, asked, np.arange(len(out)), source, out)
        return out
    parts = 2 ** math.ceil(math.log2(max(8.0, 5 * tau / kernels.c)))
    spots, spot = np.unique(np.column_stack(source[1:3]), axis=0, return_inverse=True)
    asked_spots, asked_spot = np.unique(np.column_stack(asked[1:]), axis=0, return_inverse=True)
    of = np.split(np.argsort(asked_spot.ravel(), kind="stable"), np.cumsum(np.bincount(asked_spot.ravel()))[:-1])
    grid = None
    for (x1, y1), mine in zip(asked_spots, of):
        r2 = (x1 - spots[:, 0]) * (x1 - spots[:, 0]) + (y1 - spots[:, 1]) * (y1 - spots[:, 1])
        near = np.flatnonzero((r2 <= radius * radius)[spot.ravel()])
        if not len(near):
            continue
        if len(mine) * len(near) * 60 <= len(near) * 250 + 400 * parts * parts:  # nanoseconds: pairs, or terms of sums and steps between parts
            _met(kernels, tau, radius, asked, mine, tuple(z[near] for z in source), out)
            continue
        grid = grid or _Grid(kernels, tau, parts, (block - 1) * tau, source[0])
        out[mine] = grid.sums(asked[0][mine], near, np.stack(kernels.place(r2[spot.ravel()[near]], source[3][near]), axis=1))
    return out


def _met(kernels: _Kernels, tau: float, radius: float, asked: tuple, mine: np.ndarray, source: tuple, out: np.ndarray) -> None:
    """Sums over pairs, some of those asked for at a time."""
    t0, x0, y0, dm = source
    for rows in np.array_split(mine, max(1, len(mine) * len(t0) // CHUNK)):
        t1, x1, y1 = (z[rows][:, None] for z in asked)
        dt, r2 = t1 - t0, (x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)
        i, j = np.nonzero((dt > 0) & (dt <= tau) & (r2 <= radius * radius))
        time, place = kernels.time(dt[i, j]), kernels.place(r2[i, j], dm[j])
        for n, w in enumerate([*(time[0] * w for w in place), time[1] * place[0], time[2] * place[0]]):
            out[rows, n] = np.bincount(i, w, len(rows))


class _Grid:
    """Time in ``parts`` of tau, from one tau before a block to its end; in a part, kernels are polynomials of both times to about 14 digits."""

    def __init__(self, kernels: _Kernels, tau: float, parts: int, begin: float, t: np.ndarray):
        self.tau, self.parts, self.begin, self.step, self.t = tau, parts, begin, tau / parts, t
        between = self.step * (np.arange(parts + 1)[:, None, None] + _AT[:, None] - _AT[None, :])
        self.tables = kernels.time(between)
        self.part, inside = self._cut(t)
        self.basis = _basis(inside)

    def _cut(self, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        since = (t - self.begin) / self.step
        part = np.clip(np.floor(since), 0, 2 * self.parts - 1).astype(int)
        return part, since - part

    def sums(self, asked: np.ndarray, near: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """For each of the times ``asked`` (in the second tau) the sums over the sources ``near`` (in order of time)."""
        parts, t = self.parts, self.t[near]
        terms = (self.basis[near][:, :, None] * weights[:, None, :]).reshape(len(near), -1)
        so_far = np.concatenate([np.zeros((1, terms.shape[1])), np.cumsum(terms, axis=0)])
        begin = np.searchsorted(self.part[near], np.arange(2 * parts + 1))
        whole = (so_far[begin[1:]] - so_far[begin[:-1]]).reshape(2 * parts, NODES, -1)
        m, inside = self._cut(asked)
        m = np.maximum(m, parts)
        basis = _basis(inside)
        newest = (so_far[np.searchsorted(t, asked)] - so_far[begin[m]]).reshape(len(m), NODES, -1)
        edge = np.clip(np.searchsorted(t, asked - self.tau), begin[m - parts], begin[m - parts + 1])
        oldest = (so_far[begin[m - parts + 1]] - so_far[edge]).reshape(len(m), NODES, -1)
        used, at = np.unique(m, return_inverse=True)
        back = np.arange(1, parts)
        seen = whole[used[:, None] - back].transpose(0, 3, 1, 2).reshape(len(used), whole.shape[2], -1)  # part, weight, steps back and nodes
        found = []
        for table, count in zip(self.tables, (whole.shape[2], 1, 1)):
            full = seen[:, :count] @ table[1:parts].transpose(0, 2, 1).reshape(-1, NODES)
            total = full[at].transpose(0, 2, 1) + table[0] @ newest[:, :, :count] + table[parts] @ oldest[:, :, :count]
            found.append(np.einsum("ni,niw->nw", basis, total))
        return np.concatenate(found, axis=1)


def _integrals(k, alpha, c, p, d, q, gamma, radius) -> list[Column]:
    """Sums over sources: of what they trigger within the span and radius, and of its derivatives."""
    dm, r2 = F.col("dm"), radius * radius
    b1, b2 = 1 + F.col("t1") / c, 1 + F.col("t2") / c
    e1, e2 = F.pow(b1, F.lit(1 - p)), F.pow(b2, F.lit(1 - p))
    time = e1 - e2
    s = d * F.exp(gamma * LN10 * dm)
    g = 1 + r2 / s
    ge = F.pow(g, F.lit(1 - q))
    space = 1 - ge
    kap = k * F.exp(alpha * dm)
    by_c = (p - 1) / c * (F.col("t1") * F.pow(b1, F.lit(-p)) - F.col("t2") * F.pow(b2, F.lit(-p)))
    by_p = (p - 1) * (F.log(b2) * e2 - F.log(b1) * e1)
    by_d = (1 - q) * F.pow(g, F.lit(-q)) * (r2 / s)
    by_q = (q - 1) * F.log(g) * ge
    out = {"i_k": time * space, "i_alpha": time * space * dm, "i_c": space * by_c, "i_p": space * by_p, "i_d": time * by_d, "i_q": time * by_q, "i_g": time * by_d * LN10 * dm}
    return [F.coalesce(F.sum(kap * x), F.lit(0.0)).alias(name) for name, x in out.items()]


def minimise(value, theta: np.ndarray, low: np.ndarray, high: np.ndarray, steps: int = 60, tol: float = 1e-7) -> tuple[np.ndarray, float, bool]:
    """theta, value and whether it settled, by projected quasi-Newton steps.

    Parameters at a bound that the gradient pushes against it stay; the others step by an inverse Hessian built up from gradients (BFGS), halved
    until the value falls enough.
    """
    theta = np.clip(theta, low + 1e-9, high - 1e-9)
    f, g = value(theta)
    h = np.eye(len(theta)) / max(1.0, float(np.abs(g).max()))
    for _ in range(steps):
        stuck = ((theta <= low + 1e-9) & (g > 0)) | ((theta >= high - 1e-9) & (g < 0))
        free = ~stuck
        step = np.zeros_like(theta)
        step[free] = -h[np.ix_(free, free)] @ g[free]
        if step @ g >= 0:
            step = np.where(free, -g, 0.0) / max(1.0, float(np.abs(g).max()))
            h = np.eye(len(theta)) / max(1.0, float(np.abs(g).max()))
        step *= min(1.0, 1.0 / max(1e-12, float(np.abs(step).max())))
        size = 1.0
        while True:
            new = np.clip(theta + size * step, low, high)
            fn, gn = value(new)
            if fn <= f + 1e-4 * (g @ (new - theta)) or size < 1e-6:
                break
            size /= 2
        if fn > f:
            return theta, f, float(np.abs(g[free]).max(initial=0)) < 1e-3 * max(1.0, abs(f))
        s, y = new - theta, gn - g
        done = f - fn <= tol * max(1.0, abs(f), abs(fn))
        theta, f, g = new, fn, gn
        if s @ y > 1e-12:
            rho, one = 1 / (s @ y), np.eye(len(theta))
            h = (one - rho * np.outer(s, y)) @ h @ (one - rho * np.outer(y, s)) + rho * np.outer(s, s)
        if done:
            return theta, f, True
    return theta, f, False


def fit(events: DataFrame, span: float, tau: float, radius: float, beta: float, starts: int = 2, tol: float = 1e-7) -> tuple[np.ndarray, float, bool]:
    """theta, its negative log-likelihood and whether it settled: the best of ``starts`` (1 to 3) starting points."""
    problem = Problem.of(events, span, tau, radius, beta)
    rate = max(1e-3, problem.events.filter("t >= 0").count() / span)
    low, high = bounds(beta)
    inits = [
        pack(beta, 0.5 * rate, 0.35, min(1.5, beta / 2), 0.01, 1.13, 1.5, 1.7, 0.4), pack(beta, 0.8 * rate, 0.15, min(2.0, beta / 2), 0.03, 1.30, 5.0, 2.2, 0.1),
        pack(beta, 0.3 * rate, 0.60, min(1.0, beta / 2), 0.005, 1.08, 0.5, 1.5, 0.8),
    ]
    return min((minimise(problem.value, x, low, high, tol=tol) for x in inits[:starts]), key=lambda r: r[1])
