"""Consistency of observed catalogs with a forecast, against simulated catalogs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EPS = 1e-12


def catalog_scores(counts: DataFrame, rates: DataFrame, catalogs: DataFrame, cell: list[str]) -> DataFrame:
    """catalog, n, s, pl: events of each catalog, their log-likelihood under the rates made a density in space, and under the rates themselves.

    ``counts`` holds catalog, ``cell`` and n; ``rates`` ``cell`` and lam; ``catalogs`` every catalog, also those without events.  An event
    where the forecast has nothing counts with the least rate.
    """
    whole = rates.agg(F.sum("lam").alias("_whole"))
    logs = rates.crossJoin(F.broadcast(whole))  # one row
    floor = lambda x: F.log(F.greatest(x, F.lit(EPS)))
    logs = logs.select(*cell, floor(F.col("lam") / F.greatest("_whole", F.lit(EPS))).alias("_s"), floor(F.col("lam")).alias("_pl"))
    met = counts.join(logs, cell, "left")
    least = floor(F.lit(0.0))
    sums = met.groupBy("catalog").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.coalesce("_s", least)).alias("s"), F.sum(F.col("n") * F.coalesce("_pl", least)).alias("pl"))
    filled = catalogs.select("catalog").distinct().join(sums, "catalog", "left")
    return filled.select("catalog", F.coalesce("n", F.lit(0)).alias("n"), *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("s", "pl")])


def verdicts(scores: DataFrame, observed, level: float = 0.025) -> DataFrame:
    """One row: catalogs, delta1 and delta2 (shares of simulated catalogs with at least, and at most, the observed number of events), s and pl (shares
    whose log-likelihood is at most the observed), and for each test whether it passes."""
    own = scores.filter(F.col("catalog") == observed).select(F.col("n").alias("_n"), F.col("s").alias("_s"), F.col("pl").alias("_pl"))
    share = lambda c: F.avg(c.cast("int"))
    both = scores.filter(F.col("catalog") != observed).crossJoin(F.broadcast(own))  # one row
    out = both.agg(
        F.count("*").alias("catalogs"), share(F.col("n") >= F.col("_n")).alias("delta1"), share(F.col("n") <= F.col("_n")).alias("delta2"), share(F.col("s") <= F.col("_s")).alias("s"),
        share(F.col("pl") <= F.col("_pl")).alias("pl"),
    )
    inside = lambda c: F.col(c).between(level, 1 - level)
    return out.select("*", (F.least("delta1", "delta2") > level).alias("n_passes"), inside("s").alias("s_passes"), inside("pl").alias("pl_passes"))
