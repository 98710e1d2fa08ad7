"""What a sequence looks like at a moment: its size, largest event, age and the fall of its magnitude slope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rategrid.operators import joins
from rategrid.operators.sequences import steps

US_PER_DAY = 86_400_000_000


def slope(step: Column, inside: Column, least: float = 0.1, enough: int = 30) -> Column:
    """An aggregate: the slope of the positive steps where ``inside`` holds, null if they are too few."""
    up = F.when(inside & (step >= least), step)
    return F.when(F.count(up) >= enough, 1 / (F.log(F.lit(10.0)) * (F.avg(up) - least)))


def drop(reference: float, of: Column) -> Column:
    """By how much a slope is below the reference; 0 where it isn't known."""
    return F.coalesce(F.lit(reference) - of, F.lit(0.0))


def scores(events: DataFrame, points: DataFrame, days: float, radius: float, reference: float, mc: float = 2.0, fewest: int = 3) -> DataFrame:
    """place, b_drop, seq_count, max_mag, t_since_start of each point (place, t_us, x, y) around which at least ``fewest`` ``events`` (id, t_us, x, y, mag)
    of magnitude ``mc`` happened in the ``days`` up to it, within ``radius``.

    Points and events meet on squares as wide as the radius and on buckets of time, so a point sees its surroundings only.
    """
    span = int(days * US_PER_DAY)
    own = events.filter(F.col("mag") >= mc).select("id", "t_us", "x", "y", "mag", F.floor(F.col("x") / radius).alias("_i"), F.floor(F.col("y") / radius).alias("_j"))
    around = F.array(*[F.lit(k) for k in (-1, 0, 1)])
    asked = points.select("place", F.col("x").alias("px"), F.col("y").alias("py"), (F.col("t_us") - span).alias("low"), (F.col("t_us") + 1).alias("high"), F.col("t_us").alias("at"))
    asked = asked.withColumn("_di", F.explode(around)).withColumn("_dj", F.explode(around))
    asked = asked.withColumn("_i", F.floor(F.col("px") / radius) + F.col("_di")).withColumn("_j", F.floor(F.col("py") / radius) + F.col("_dj")).drop("_di", "_dj")
    met = joins.range_join(own, asked, "t_us", "low", "high", span, ("_i", "_j"))
    dx, dy = F.col("x") - F.col("px"), F.col("y") - F.col("py")
    met = met.filter(dx * dx + dy * dy <= radius * radius)
    step = F.col("mag") - F.lag("mag").over(Window.partitionBy("place").orderBy("t_us", "id"))
    out = met.withColumn("step", step).groupBy("place").agg(
        drop(reference, slope(F.col("step"), F.lit(True))).alias("b_drop"), F.count("*").alias("seq_count"), F.max("mag").alias("max_mag"),
        F.least(F.max((F.col("at") - F.col("t_us")) / US_PER_DAY), F.lit(float(days))).alias("t_since_start"),
    )
    return out.filter(F.col("seq_count") >= fewest)


def followed(events: DataFrame, triggers: DataFrame, by: list[str], days: tuple, later: int, reference: float, mc: float = 2.0, least: float = 0.1, enough: int = 30) -> DataFrame:
    """id, days, n, top, b_drop, later_top for each trigger (id, t_us, ``by``) and horizon: of the group's ``events`` (id, t_us, mag, win, ``by``) after the
    trigger and up to ``days`` later their number and largest magnitude, the fall of the slope of their steps, and the largest magnitude of
    the ``later`` days beyond.

    Nothing is copied to the triggers whose horizons hold it.  What a horizon holds is the rest of the trigger's hour, whole hours, and the
    beginning of its last hour: the first and last come from running sums within an hour, the hours between from a table with one
    row a group and hour.  A step belongs to the event that ends it, so only the first of a horizon, which begins before it, is left out.
    """
    hour, per_day = US_PER_DAY // 24, 24
    heavy = F.coalesce(F.col("mag") >= mc, F.lit(False))
    big = steps(events.filter(heavy), "mag", by).select(*by, "id", "t_us", "mag", F.lit(True).alias("heavy"), "step")
    rest = events.filter(~heavy).select(*by, "id", "t_us", "mag", F.lit(False).alias("heavy"), F.lit(None).cast("double").alias("step"))
    up = F.col("step") >= least
    e = big.unionByName(rest).withColumn("up", F.when(up, 1).otherwise(0)).withColumn("rise", F.when(up, F.col("step")).otherwise(0.0)).withColumn("one", F.lit(1)).withColumn("_b", F.floor(F.col("t_us") / hour))
    first = F.when(F.col("heavy"), F.struct("t_us", "id", "step"))
    offsets = sorted({0, *days, *(d + later for d in days)})
    points = triggers.select(*by, "id", F.col("t_us").alias("t0"), F.explode(F.array(*[F.lit(o) for o in offsets])).alias("off"))
    points = points.withColumn("t_us", F.col("t0") + F.col("off") * US_PER_DAY).withColumn("_b", F.floor(F.col("t_us") / hour))
    both = e.unionByName(points, allowMissingColumns=True).withColumn("kind", F.col("off").isNotNull())
    # at one time events come before points in the one order and after them in the other: they belong to what lies up to the point
    upto = Window.partitionBy(*by, "_b").orderBy("t_us", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    beyond = Window.partitionBy(*by, "_b").orderBy(F.desc("t_us"), F.desc("kind"), F.desc("id")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = both.withColumn("next", F.last(first, ignorenulls=True).over(beyond)).withColumn("top2", F.max("mag").over(beyond)).withColumn("top1", F.max("mag").over(upto))
    sums = ("one", "up", "rise")
    for c in sums:
        both = both.withColumn(f"{c}1", F.coalesce(F.sum(c).over(upto), F.lit(0)))
    at = both.filter("kind").groupBy("id", *by, "t0").agg(
        F.max(F.when(F.col("off") == 0, F.col("next"))).alias("next"),
        *[F.max(F.when(F.col("off") == o, F.col(c))).alias(f"{c}_{o}") for o in offsets for c in ("one1", "up1", "rise1", "top1", "top2")],
    ).withColumn("_b", F.floor(F.col("t0") / hour))
    hours = e.groupBy(*by, "_b").agg(*[F.sum(c).alias(f"{c}_h") for c in sums], F.max("mag").alias("top_h"), F.min(first).alias("first_h"))
    span = lambda a, b: Window.partitionBy(*by).orderBy("_b").rangeBetween(a, b)  # noqa: E731  a row for each hour
    between = [F.coalesce(F.sum(f"{c}_h").over(span(1, per_day * d - 1)), F.lit(0)).alias(f"{c}_m{d}") for d in days for c in sums]
    between += [F.max("top_h").over(span(1, per_day * d - 1)).alias(f"top_m{d}") for d in days]
    between += [F.max("top_h").over(span(per_day * d + 1, per_day * (d + later) - 1)).alias(f"late_m{d}") for d in days]
    after = Window.partitionBy(*by).orderBy("_b").rowsBetween(1, Window.unboundedFollowing)
    hours = hours.select(*by, "_b", *[f"{c}_h" for c in sums], *between, F.first("first_h", ignorenulls=True).over(after).alias("first_m"))
    met = at.join(hours, [*by, "_b"]).withColumn("next", F.coalesce("next", "first_m"))

    def horizon(d: int) -> Column:
        one, ups, rise = (F.col(f"{c}_h") - F.col(f"{c}1_0") + F.col(f"{c}_m{d}") + F.col(f"{c}1_{d}") for c in sums)
        early = (F.col("next.step") >= least) & (F.col("next.t_us") <= F.col("t0") + d * US_PER_DAY)
        ups, rise = ups - F.when(early, 1).otherwise(0), rise - F.when(early, F.col("next.step")).otherwise(0.0)
        b = F.when(ups >= enough, 1 / (F.log(F.lit(10.0)) * (rise / ups - least)))
        top = F.greatest("top2_0", f"top_m{d}", f"top1_{d}")
        late = F.greatest(f"top2_{d}", f"late_m{d}", f"top1_{d + later}")
        return F.struct(F.lit(d).alias("days"), one.alias("n"), top.alias("top"), drop(reference, b).alias("b_drop"), late.alias("later_top"))

    return met.select("id", F.explode(F.array(*[horizon(d) for d in days])).alias("s")).select("id", "s.*")


def line_distance(x: Column, y: Column, line: list[tuple[float, float]]) -> Column:
    """The distance of a place to a line of corners (y, x), clamped to its ends."""
    out = []
    for (r0, c0), (r1, c1) in zip(line, line[1:]):
        dr, dc = r1 - r0, c1 - c0
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((y - r0) * dr + (x - c0) * dc) / (dr * dr + dc * dc)))
        out.append(F.sqrt((y - r0 - t * dr) * (y - r0 - t * dr) + (x - c0 - t * dc) * (x - c0 - t * dc)))
    return F.least(*out) if len(out) > 1 else out[0]

