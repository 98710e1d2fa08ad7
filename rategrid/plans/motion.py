"""Likelihoods over pairs, and streams."""

from pyspark.sql import functions as F

from rategrid.functions.core import micros_since, omori_cumulative, productivity
from rategrid.operators.kernel_sums import kernel_sums
from rategrid.plans import catalog  # noqa: F401  its SQL is used
from rategrid.plans.base import EV, ORACLES, events, fixed, query, r6
from rategrid.sources.shared import shared_folder
from rategrid.streaming.counts import drained, sequences, sliding_counts, window_counts
from rategrid.streaming.ordered import keyed_timers, without_near_repeats

#: Offspring of an event: mean K exp(ALPHA (m - 2)), waiting times (C, P) in days, up to REACH hours, over the 3 x 3 cells around.
MU, K, ALPHA, C, P, REACH = 0.4, 0.3, 0.8, 0.02, 1.2, 3
HOUR = 3_600_000_000
_TRIG = f"""{EV}, x AS (SELECT b.id, sum({K}::DOUBLE * exp({ALPHA}::DOUBLE * (a.mag - 2)) * 0.2::DOUBLE * pow({C}::DOUBLE, 0.2::DOUBLE) * pow((b.t_us - a.t_us)::DOUBLE / 86400000000 + {C}::DOUBLE, -{P}::DOUBLE) / 9) AS trig
FROM ev a JOIN ev b ON abs(a.ir - b.ir) <= 1 AND abs(a.ic - b.ic) <= 1 AND b.t_us > a.t_us AND b.t_us <= a.t_us + {REACH * HOUR} GROUP BY b.id),
r AS (SELECT ev.id, mag, t_us, coalesce(trig, 0) AS trig FROM ev LEFT JOIN x ON x.id = ev.id)"""


def triggered(e):
    """id, ir, ic, mag and the rate ``trig`` at each event that earlier events near it add up to."""
    waiting = lambda us: (P - 1) * C ** (P - 1) * (us / 86_400_000_000 + C) ** -P / 9
    sources = e.select("id", "ir", "ic", "t_us", "mag", productivity(F.col("mag"), K, ALPHA, 2).alias("offspring"))
    return kernel_sums(sources, "offspring", REACH * HOUR, waiting, carry=("ir", "ic", "mag")).withColumnRenamed("total", "trig")


def _rates(spark, sf):
    return triggered(events(spark, sf))


@query(f"WITH {_TRIG} SELECT id, {r6(f'{MU}::DOUBLE / ({MU}::DOUBLE + trig)')} AS rho FROM r")
def q_rho(spark, sf):
    """Probability that an event is background."""
    return _rates(spark, sf).select("id", fixed(MU / (MU + F.col("trig"))).alias("rho"))


@query(f"""WITH {_TRIG} SELECT {r6(f"-sum(ln({MU}::DOUBLE + trig))")} AS points, {r6(f"{MU}::DOUBLE * 30 * 150 + sum({K}::DOUBLE * exp({ALPHA}::DOUBLE * (mag - 2))) * (1 - pow(1 + {REACH}::DOUBLE / 24 / {C}::DOUBLE, -0.2::DOUBLE))")} AS integral FROM r""")
def q_nll_eval(spark, sf):
    """The two parts of the negative log-likelihood at given parameters, in one aggregation."""
    reach = omori_cumulative(F.lit(REACH / 24), C, P)
    return _rates(spark, sf).agg(
        fixed(-F.sum(F.log(MU + F.col("trig")))).alias("points"),
        fixed(MU * 30 * 150 + F.sum(productivity(F.col("mag"), K, ALPHA, 2)) * F.max(reach)).alias("integral"),
    )


@query("SELECT date_trunc('day', ts)::TIMESTAMP AS start, count(DISTINCT event_id)::BIGINT AS n, max(value) AS top FROM events GROUP BY 1")
def q_stream_counts(spark, sf):
    """Daily counts by Structured Streaming: watermark, repeats dropped, windows updated."""
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    # the times carry no zone and a watermark needs instants: they are read as UTC, whatever the session's zone
    instants = lambda e: e.withColumn("ts", F.timestamp_micros(micros_since(F.col("ts"), "1970-01-01")))
    out = drained(spark, sf, schema, lambda e: window_counts(instants(e)), shared_folder(spark), "events.parquet")
    return out.select(F.timestamp_add("SECOND", F.unix_seconds("start"), F.lit("1970-01-01").cast("timestamp_ntz")).alias("start"), "n", "top")


def _instants(e):
    return e.withColumn("ts", F.timestamp_micros(micros_since(F.col("ts"), "1970-01-01")))


def _plain(c):
    """A UTC instant as a timestamp without zone."""
    return F.timestamp_add("SECOND", F.unix_seconds(c), F.lit("1970-01-01").cast("timestamp_ntz"))


@query("WITH d AS (SELECT unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY, date_trunc('day', ts) - INTERVAL 2 DAY]) AS start FROM events) SELECT start::TIMESTAMP AS start, count(*)::BIGINT AS n FROM d GROUP BY start")
def q_stream_sliding(spark, sf):
    """Three-day counts sliding by a day, by Structured Streaming."""
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    out = drained(spark, sf, schema, lambda e: sliding_counts(_instants(e)), shared_folder(spark), "events.parquet")
    return out.select(_plain("start").alias("start"), "n")


@query("""WITH g AS (SELECT event_type, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 3 HOUR THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts)), s AS (SELECT event_type, ts, sum(new) OVER (PARTITION BY event_type ORDER BY ts) AS k FROM g)
SELECT event_type, epoch_us(min(ts)) AS start, count(*)::BIGINT AS n FROM s GROUP BY event_type, k""")
def q_stream_sessions(spark, sf):
    """Sequences of each kind by Structured Streaming; each comes out when the watermark has passed it, and leaves the state."""
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    build = lambda e: sequences(_instants(e), "event_type", gap="3 hours").withColumn("start", F.struct("event_type", "start"))
    out = drained(spark, sf, schema, build, shared_folder(spark), "events.parquet", "append", close="ts")
    return out.select("event_type", F.unix_micros("start.start").alias("start"), "n")


@query(ORACLES["q_dedupe_greedy"].replace("SELECT id FROM r WHERE keep", "SELECT ic, id FROM r WHERE keep"))
def q_stream_dedupe(spark, sf):
    """The greedy dedupe over a stream whose rows may come out of order, with waiting rows and kept ones as its state."""
    schema = spark.read.parquet(f"{sf}/events.parquet").schema

    def build(e):
        rows = _instants(e).select(F.col("event_id").alias("id"), "ts", F.unix_micros("ts").alias("t_us"), (1 + F.log(1 + F.col("value")) / F.log(F.lit(10.0))).alias("mag"), (F.floor(F.col("user_id") / 10) % 15).cast("int").alias("ic"))
        return without_near_repeats(rows, "ic", HOUR, 0.05).withColumn("start", F.col("id"))

    with keyed_timers(spark):
        out = drained(spark, sf, schema, build, shared_folder(spark), "events.parquet", "append", close="ts")
    return out.select("ic", "id")
