"""Sources in text form, preparation of catalogs, and their joins."""

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from rategrid.functions.core import micros_since
from rategrid.operators import catalog, joins
from rategrid.plans.base import CELLS, EV, GRID, events, fixed, query, r6
from rategrid.sources import encoded, tables, text
from rategrid.sources.shared import release_later, shared_folder

HOUR = 3_600_000_000


def _pages(df, lines, wrap, column):
    """One page a day from the lines of its events."""
    per = df.groupBy("win").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", lines.alias("l")))), lambda x: x["l"]), "\n").alias("body"), F.count("*").alias("n"))
    return per.select(F.col("win").cast("long").alias("page_id"), wrap(F.col("body"), F.col("n")).alias(column))


@query(f"WITH {EV} SELECT win::BIGINT AS page_id, id, {r6('round(mag, 1)')} AS pref, CASE WHEN id % 3 = 0 THEN NULL ELSE {r6('round(mag, 1)')} END AS md, count(*) OVER (PARTITION BY win)::BIGINT AS announced, CASE WHEN mag_type = 'error' THEN 'Sm' ELSE 'Ke' END AS kind FROM ev")
def q_parse_bulletin(spark, sf):
    """A day's events are written as a page with a tab-separated table, and read back from its text."""
    e = events(spark, sf)
    mag = F.format_number("mag", 1)
    blank = F.lit("")
    fields = [F.col("id").cast("string"), F.concat(F.lit("c"), F.col("id")), F.date_format("ts", "yyyy.MM.dd"), F.date_format("ts", "HH:mm:ss.SS"), F.col("ir").cast("string"), F.col("ic").cast("string"), F.lit("5.0"), mag]
    fields += [F.when(F.col("id") % 3 == 0, "-.-").otherwise(mag), mag, blank, blank, F.lit("0.0"), F.when(F.col("mag_type") == "error", "Sm").otherwise("Ke"), F.lit("SOMEWHERE")]
    pages = _pages(e, F.concat_ws("\t", *fields), lambda b, n: F.concat(F.lit("<html><b>"), n, F.lit(" rows</b><pre>No\tcode\n"), b, F.lit("\n</pre></html>")), "html")
    got = text.bulletin(pages)
    return got.select("page_id", F.col("no").cast("long").alias("id"), fixed(text.number(F.col("pref"))).alias("pref"), fixed(text.number(F.col("md"))).alias("md"), F.when(F.col("announced") == F.col("rows"), F.col("announced")).alias("announced"), "kind")


#: Letters that the older code page has and ASCII has not.
_PLACE = "\u0130ZM\u0130R \u015eİLE \u011f\u0131"


@query(f"""WITH {EV}, p AS (SELECT range AS page_id FROM range(32)), n AS (SELECT win AS page_id, count(*) AS n, sum(round(mag, 1)) AS mag FROM ev GROUP BY win)
SELECT p.page_id::BIGINT AS page_id, (CASE WHEN p.page_id >= 30 THEN 2 ELSE coalesce(n, 0) + (p.page_id % 10 = 3)::INT END)::BIGINT AS announced, coalesce(n, 0)::BIGINT AS rows, p.page_id < 30 AND p.page_id % 10 <> 3 AS ok, coalesce(n, 0)::BIGINT AS places, {r6('coalesce(mag, 0)')} AS mag FROM p LEFT JOIN n USING (page_id)""")
def q_encoded_bulletin(spark, sf):
    """Events as pages in files of code page 1254, one a day, read back by file: counts that a page announces wrongly show, and so do pages that announce
    rows and hold none."""
    e = events(spark, sf)
    mag, blank = F.format_number("mag", 1), F.lit("")
    fields = [F.col("id").cast("string"), F.concat(F.lit("c"), F.col("id")), F.date_format("ts", "yyyy.MM.dd"), F.date_format("ts", "HH:mm:ss.SS"), F.col("ir").cast("string"), F.col("ic").cast("string"), F.lit("5.0"), mag, mag, mag, blank, blank, F.lit("0.0"), F.lit("Ke"), F.lit(_PLACE)]
    rows = e.select(F.col("win").cast("long").alias("page_id"), F.lit(1).alias("part"), "id", F.concat_ws("\t", *fields).alias("line"))
    n = e.groupBy(F.col("win").cast("long").alias("page_id")).agg(F.count("*").alias("n"))
    said = spark.range(32).withColumnRenamed("id", "page_id").join(n, "page_id", "left")
    wrong = F.coalesce("n", F.lit(0)) + (F.col("page_id") % 10 == 3).cast("int")
    head = said.select("page_id", F.lit(0).alias("part"), F.lit(0).cast("long").alias("id"), F.concat(F.lit("<html><b>"), F.when(F.col("page_id") >= 30, 2).otherwise(wrong), F.lit(" rows</b><pre>No\tcode")).alias("line"))
    foot = said.select("page_id", F.lit(2).alias("part"), F.lit(0).cast("long").alias("id"), F.lit("</pre></html>").alias("line"))
    folder = f"{shared_folder(spark)}/pages-{uuid.uuid4().hex}"
    release_later(spark, folder)
    encoded.write_pages(head.unionByName(rows).unionByName(foot), folder, "page_id", ["part", "id"], "cp1254")
    lines = encoded.read_lines(spark, folder, "cp1254", "*.csv").withColumn("page_id", F.col("page_id").cast("long"))
    got, pages = text.bulletin_of_lines(lines.select("page_id", "at", "line"))
    sums = got.groupBy("page_id").agg(F.count_if(F.col("place") == _PLACE).alias("places"), fixed(F.sum(text.number(F.col("pref")))).alias("mag"))
    return encoded.judged(pages, got).join(sums, "page_id", "left").select("page_id", "announced", "rows", "ok", F.coalesce("places", F.lit(0)).alias("places"), F.coalesce("mag", F.lit(0.0)).alias("mag"))


@query(f"WITH {EV} SELECT mag_type AS kind, count(*)::BIGINT AS n, mag_type <> 'error' AS kept, {r6('count(*)::DOUBLE / sum(count(*)) OVER ()')} AS share FROM ev GROUP BY mag_type")
def q_type_histogram(spark, sf):
    """Rows of each kind, and whether the category filter keeps it."""
    n = events(spark, sf).groupBy(F.col("mag_type").alias("kind")).agg(F.count("*").alias("n"))
    whole = F.sum("n").over(Window.partitionBy())  # a row for each kind
    return n.select("kind", "n", (F.col("kind") != "error").alias("kept"), fixed(F.col("n") / whole).alias("share"))


@query(f"WITH {EV} SELECT id, ir::DOUBLE AS lat, {r6('round(mag, 1)')} AS mag, epoch_us(ts) - 10800000000 AS utc_us FROM ev")
def q_parse_xml(spark, sf):
    """Events written as XML elements in local time, read back by expressions and brought to UTC."""
    e = events(spark, sf)
    name = F.concat(F.date_format("ts", "yyyy.MM.dd HH:mm:ss"), F.lit("."), F.lpad((F.unix_micros(F.col("ts").cast("timestamp")) % 1_000_000).cast("string"), 6, "0"))
    line = F.concat(F.lit('<earhquake name="'), name, F.lit('" lokasyon="'), F.col("id"), F.lit('" lat="'), F.col("ir"), F.lit('.0" lng="'), F.col("ic"), F.lit('.0" mag="'), F.format_number("mag", 1), F.lit('" Depth="5.0"/>'))
    got = text.events_of_xml(_pages(e, line, lambda b, n: F.concat(F.lit("<eqlist>"), b, F.lit("</eqlist>")), "xml"))
    local = F.to_timestamp_ntz("name", F.lit("yyyy.MM.dd HH:mm:ss.SSSSSS"))
    # a coordinate of 0 stands for none in this format, as does a magnitude of 0
    return got.select(F.col("place").cast("long").alias("id"), F.coalesce("lat", F.lit(0.0)).alias("lat"), fixed(F.col("mag")).alias("mag"), micros_since(text.to_utc(local), "1970-01-01").alias("utc_us"))


@query(f"WITH {EV} SELECT lpad(ic::VARCHAR, 4, '0') AS station, count(*)::BIGINT AS days, min(win)::INT AS first_day, {r6('sum(s)')} AS east, {r6('sum(n)::DOUBLE')} AS north FROM (SELECT ic, win, count(*) AS n, round(sum(mag), 4) AS s FROM ev GROUP BY ALL) GROUP BY ic")
def q_station_series(spark, sf):
    """Daily positions as files of whitespace-separated columns, one a station, read back."""
    d = events(spark, sf).groupBy("ic", "win").agg(F.count("*").alias("n"), F.round(F.sum("mag"), 4).alias("s"))
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.col("win"))
    number = lambda x: F.format_string("%.7f", x / 1000)
    line = F.concat_ws("  ", F.lpad(F.col("ic").cast("string"), 4, "0"), F.date_format(day, "yyMMMdd"), F.lit("2024.0001"), (F.datediff(day, F.lit("1858-11-17").cast("date"))).cast("string"), F.lit("2000"), F.lit("1"), F.lit("27.0"), F.lit("0"), number(F.col("s")), F.lit("0"), number(F.col("n")))
    rows = d.select(F.col("ic").alias("station"), F.col("win").alias("at"), line.alias("line"))
    heads = d.select(F.col("ic").alias("station"), F.lit(-1).alias("at"), F.lit("site YYMMMDD yyyy.yyyy __MJD week d reflon _e0(m)").alias("line")).distinct()
    folder = f"{shared_folder(spark)}/series-{uuid.uuid4().hex}"
    release_later(spark, folder)
    rows.unionByName(heads).repartition("station").sortWithinPartitions("station", "at").select("station", F.col("line").alias("value")).write.partitionBy("station").text(folder)
    got = text.station_series(spark.read.text(folder).select(F.col("value").alias("line")))
    first = F.datediff(F.min("day"), F.lit("2024-01-01").cast("date"))
    return got.groupBy("station").agg(F.count("*").alias("days"), first.alias("first_day"), fixed(F.sum("east")).alias("east"), fixed(F.sum("north")).alias("north"))


@query(f"WITH {EV}, s AS (SELECT user_id, max(ts)::DATE AS day, count(*)::INT AS kind FROM ev GROUP BY user_id) SELECT lpad(user_id::VARCHAR, 5, '0') AS station, day, kind FROM s")
def q_station_steps(spark, sf):
    s = events(spark, sf).groupBy("user_id").agg(F.max("ts").alias("ts"), F.count("*").alias("kind"))
    line = F.concat_ws(" ", F.lpad(F.col("user_id").cast("string"), 5, "0"), F.upper(F.date_format("ts", "yyMMMdd")), F.col("kind"))
    # months as JAN: the reader takes any case
    return text.station_steps(s.select(line.alias("line")))


@query("SELECT o_orderkey, epoch_us(o_orderdate::TIMESTAMP - CASE WHEN o_orderdate >= DATE '2016-09-08' THEN INTERVAL 3 HOUR ELSE INTERVAL 0 HOUR END) AS fixed_us, year(o_orderdate) - 1 AS year_before, date_trunc('month', o_orderdate)::DATE AS month_start, (o_orderdate - INTERVAL 365 DAY)::DATE AS cutoff FROM orders")
def q_local_times(spark, sf):
    """Month starts, cutoffs a year before, and times with a fixed offset of three hours from a day on."""
    d = F.col("o_orderdate").cast("timestamp_ntz")
    moved = F.when(d >= "2016-09-08", d - F.expr("INTERVAL 3 HOURS")).otherwise(d)
    o = spark.read.parquet(f"{sf}/orders.parquet")
    return o.select("o_orderkey", micros_since(moved, "1970-01-01").alias("fixed_us"), (F.year(d) - 1).alias("year_before").cast("long"), F.trunc(d, "month").alias("month_start"), F.date_sub(d.cast("date"), 365).alias("cutoff"))


@query(f"WITH {EV} SELECT win, count(*)::BIGINT AS n, {r6('sum(value)')} AS value FROM ev GROUP BY win")
def q_sinks(spark, sf):
    """Through a CSV sink, a partitioned Parquet sink and a JSON report, and back."""
    base = f"{shared_folder(spark)}/sinks-{spark.sparkContext.applicationId}"
    own = events(spark, sf).select("id", "win", "value", "ts")
    tables.write_csv(own, f"{base}/csv")
    tables.write_partitioned(spark.read.schema(own.schema).option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS").csv(f"{base}/csv", header=True), f"{base}/parquet", ("win",))
    per = spark.read.parquet(f"{base}/parquet").groupBy("win").agg(F.count("*").alias("n"), fixed(F.sum("value")).alias("value"))
    tables.write_report(per.select("win", F.struct("n", "value").alias("s")), f"{base}/json")
    return tables.read_report(spark, f"{base}/json", "win int, s struct<n: long, value: double>").select("win", "s.n", "s.value")


@query(f"WITH {EV} SELECT id, ir::DOUBLE AS lat, ic::DOUBLE AS lon, {r6('mag')} AS mag, NULL::DOUBLE AS depth, t_us + (epoch_us(TIMESTAMP '2024-01-01') - epoch_us(TIMESTAMP '2003-01-01')) AS since_us FROM ev")
def q_resolve_columns(spark, sf):
    """A catalog with other column names and float days since the origin."""
    e = events(spark, sf)
    days = (F.col("t_us") + micros_since(F.lit("2024-01-01").cast("timestamp_ntz"), "2003-01-01")) / 86_400_000_000.0
    odd = e.select(F.col("ir").alias("Latitude"), F.col("ic").alias("LNG"), F.col("mag").alias("Magnitude"), days.alias("Days"), "id")
    got = text.resolved(odd.select("Latitude", "LNG", "Magnitude", "Days"))
    # rows are found again by their values, which the time makes unique up to repeats
    keyed = e.select("id", "ir", "ic", "t_us", "mag")
    since = micros_since(F.col("time"), "2003-01-01")
    back = since - micros_since(F.lit("2024-01-01").cast("timestamp_ntz"), "2003-01-01")
    g = got.select(F.col("lat"), F.col("lon"), F.col("mag").alias("m"), "depth", since.alias("since_us"), back.alias("t"))
    both = keyed.join(g.distinct(), (F.col("t_us") == F.col("t")) & (F.col("ir") == F.col("lat")) & (F.col("ic") == F.col("lon")) & (F.col("mag") == F.col("m")))
    return both.select("id", "lat", "lon", fixed(F.col("m")).alias("mag"), "depth", "since_us")


@query(f"""WITH {EV}, v AS (SELECT id, round(mag, 1) AS mag, [round(mag, 1) + (id % 7) * 0.02::DOUBLE, round(mag, 1) + (id % 3) * 0.03::DOUBLE, round(mag, 1) - (id % 5) * 0.02::DOUBLE, CASE WHEN id % 2 = 0 THEN round(mag, 1) + 0.3 END, round(mag, 1) + 0.04] AS x FROM ev)
SELECT id, CASE WHEN abs(x[1] - mag) <= 0.05 THEN 'Mw' WHEN abs(x[2] - mag) <= 0.05 THEN 'ML' WHEN abs(x[3] - mag) <= 0.05 THEN 'Md' WHEN abs(x[4] - mag) <= 0.05 THEN 'Ms' WHEN abs(x[5] - mag) <= 0.05 THEN 'Mb' ELSE 'xM-unknown' END AS kind FROM v""")
def q_type_infer_all(spark, sf):
    """The first of five magnitudes, in their order of trust, that the preferred one agrees with."""
    m, i = F.round("mag", 1), F.col("id")
    values = {"Mw": m + i % 7 * 0.02, "ML": m + i % 3 * 0.03, "Md": m - i % 5 * 0.02, "Ms": F.when(i % 2 == 0, m + 0.3), "Mb": m + 0.04}
    return events(spark, sf).select("id", F.coalesce(*[F.when(F.abs(v - m) <= 0.05, F.lit(k)) for k, v in values.items()], F.lit("xM-unknown")).alias("kind"))


@query(f"""WITH {EV}, old AS (SELECT * FROM ev WHERE win < 15), fresh AS (SELECT * FROM ev WHERE win BETWEEN 13 AND 20)
SELECT id FROM fresh f WHERE NOT EXISTS (SELECT 1 FROM old o WHERE o.user_id = f.user_id AND floor(o.value) = floor(f.value)) AND NOT EXISTS (SELECT 1 FROM old o WHERE o.ir = f.ir AND o.ic = f.ic AND o.t_us BETWEEN f.t_us - {HOUR // 6} AND f.t_us + {HOUR // 6})""")
def q_novelty_known(spark, sf):
    """A refresh that overlaps what is there: rows with a known code, or near a known row in time and place, aren't new."""
    e = events(spark, sf)
    old, fresh = e.filter("win < 15"), e.filter("win BETWEEN 13 AND 20").withColumn("code", F.floor("value"))
    fresh = fresh.join(old.select("user_id", F.floor("value").alias("code")).distinct(), ["user_id", "code"], "left_anti")
    near = old.select("ir", "ic", (F.col("t_us") - HOUR // 6).alias("low"), (F.col("t_us") + HOUR // 6 + 1).alias("high"))
    return joins.range_join(fresh, near, "t_us", "low", "high", HOUR, ("ir", "ic"), "left_anti").select("id")


@query(f"""WITH {EV}, v AS (SELECT *, CASE WHEN id % 9 = 0 THEN NULL ELSE mag END AS m FROM ev) SELECT count(*)::BIGINT AS pairs, count(*) FILTER (a.m IS NULL OR b.m IS NULL)::BIGINT AS unknown FROM v a JOIN v b ON a.id < b.id AND a.ic = b.ic AND abs(a.t_us - b.t_us) <= 300000000 AND (a.m IS NULL OR b.m IS NULL OR abs(a.m - b.m) <= 0.5)""")
def q_residual_pairs_mag(spark, sf):
    """Pairs near in time and place whose magnitudes agree, or one is unknown."""
    e = events(spark, sf).select("id", "ic", "t_us", F.when(F.col("id") % 9 != 0, F.col("mag")).alias("m"))
    spans = e.select(F.col("id").alias("other"), F.col("m").alias("om"), "ic", (F.col("t_us") - 300_000_000).alias("low"), (F.col("t_us") + 300_000_001).alias("high"))
    unknown = F.col("m").isNull() | F.col("om").isNull()
    p = joins.range_join(e, spans, "t_us", "low", "high", HOUR, ("ic",)).filter((F.col("other") < F.col("id")) & (unknown | (F.abs(F.col("m") - F.col("om")) <= 0.5)))
    return p.agg(F.count("*").alias("pairs"), F.count_if(unknown).alias("unknown"))


@query(f"""WITH {EV}, a AS (SELECT * FROM ev WHERE mag_type IN ('click', 'view')), b AS (SELECT * FROM ev WHERE mag_type = 'purchase') SELECT b.id, EXISTS (SELECT 1 FROM a WHERE a.ir = b.ir AND a.ic = b.ic AND abs(a.t_us - b.t_us) <= 120000000) AS near FROM b""")
def q_near_time(spark, sf):
    """Whether a row of one source has a row of another within two minutes in its cell."""
    e = events(spark, sf)
    a, b = e.filter("mag_type IN ('click', 'view')"), e.filter("mag_type = 'purchase'")
    spans = a.select("ir", "ic", (F.col("t_us") - 120_000_000).alias("low"), (F.col("t_us") + 120_000_001).alias("high"))
    hit = joins.range_join(b, spans, "t_us", "low", "high", HOUR, ("ir", "ic"), "left_semi").select("id", F.lit(True).alias("hit"))
    return b.select("id").join(hit, "id", "left").select("id", F.coalesce("hit", F.lit(False)).alias("near"))


@query(f"""WITH {EV}, a AS (SELECT *, 1 AS src FROM ev WHERE mag_type = 'click' UNION ALL SELECT *, 2 FROM ev WHERE mag_type <> 'click') SELECT id, src, (row_number() OVER (ORDER BY t_us, id) - 1)::BIGINT AS place FROM a""")
def q_union_sorted(spark, sf):
    """Sources united and numbered in order of time: counts of the days before, and places within the day."""
    e = events(spark, sf)
    both = e.filter("mag_type = 'click'").withColumn("src", F.lit(1)).unionByName(e.filter("mag_type <> 'click'").withColumn("src", F.lit(2)))
    days = both.groupBy("win").agg(F.count("*").alias("n"))
    days = days.select("win", F.coalesce(F.sum("n").over(Window.orderBy("win").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # one row a day
    inside = Window.partitionBy("win").orderBy("t_us", "id")
    return both.join(F.broadcast(days), "win").select("id", "src", (F.col("before") + F.row_number().over(inside) - 1).alias("place"))


@query(f"""WITH RECURSIVE {EV}, o AS (SELECT id, t_us, ic, row_number() OVER (PARTITION BY ic ORDER BY t_us, id) AS k FROM ev WHERE mag_type = 'click'),
r AS (SELECT ic, k, t_us, true AS kept, t_us AS last FROM o WHERE k = 1 UNION ALL SELECT o.ic, o.k, o.t_us, o.t_us - r.last > 60000000, CASE WHEN o.t_us - r.last > 60000000 THEN o.t_us ELSE r.last END FROM r JOIN o ON o.ic = r.ic AND o.k = r.k + 1),
s AS (SELECT id, t_us, ic FROM ev WHERE mag_type IN ('signup', 'error') OR mag >= 3) SELECT s.id FROM s WHERE NOT EXISTS (SELECT 1 FROM r WHERE kept AND r.ic = s.ic AND r.t_us < s.t_us AND r.t_us >= s.t_us - 60000000)""")
def q_near_previous(spark, sf):
    """Rows of a later source that no earlier row of the first one is near, whatever their magnitudes.  The first source's own repeats are dropped
    before, and a dropped row drops no other."""
    e = events(spark, sf)
    later = e.filter("mag_type IN ('signup', 'error') OR mag >= 3")
    first = catalog.drop_near_repeats(e.filter("mag_type = 'click'").select("id", "t_us", "mag", "ic"), ["ic"], 60_000_000, 1e9, 86_400_000_000)
    spans = first.select("ic", (F.col("t_us") + 1).alias("low"), (F.col("t_us") + 60_000_001).alias("high"))
    return joins.range_join(later, spans, "t_us", "low", "high", HOUR, ("ic",), "left_anti").select("id")


# joins


@query(f"WITH {EV}, {CELLS}, n AS (SELECT ir, ic, count(*) AS n FROM ev WHERE mag >= 3 GROUP BY ALL) SELECT c.ir, c.ic, coalesce(n, 0)::BIGINT AS n, (CASE WHEN c.ir BETWEEN 2 AND 7 AND c.ic BETWEEN 2 AND 12 THEN 1 ELSE 0 END)::INT AS in_box, c.ir * 15 + c.ic AS flat, (c.ir * 15 + c.ic) // 15 AS ir2, (c.ir * 15 + c.ic) % 15 AS ic2 FROM cells c LEFT JOIN n USING (ir, ic)")
def q_wide_cells(spark, sf):
    """Every cell with its count or 0, whether it lies in the inner box, and its flat number with the inverse."""
    n = events(spark, sf).filter("mag >= 3").groupBy("ir", "ic").agg(F.count("*").alias("n"))
    flat = F.col("ir") * 15 + F.col("ic")
    inside = (F.col("ir").between(2, 7) & F.col("ic").between(2, 12)).cast("int")
    c = GRID.cells(spark).join(n, ["ir", "ic"], "left")
    return c.select("ir", "ic", F.coalesce("n", F.lit(0)).alias("n"), inside.alias("in_box"), flat.alias("flat"), F.floor(flat / 15).alias("ir2"), (flat % 15).alias("ic2"))


@query("SELECT s.s_suppkey, coalesce(n.n_name, 'none') AS nation, coalesce(r.r_name, 'none') AS region FROM supplier s LEFT JOIN nation n ON n.n_nationkey = s.s_nationkey AND n.n_nationkey % 4 <> 0 LEFT JOIN region r ON r.r_regionkey = n.n_regionkey")
def q_dim_lookup(spark, sf):
    """Dimension lookups with a default for what has no entry."""
    t = lambda name: spark.read.parquet(f"{sf}/{name}.parquet")
    n = t("nation").filter("n_nationkey % 4 <> 0")
    s = t("supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"), "left").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return s.select("s_suppkey", F.coalesce("n_name", F.lit("none")).alias("nation"), F.coalesce("r_name", F.lit("none")).alias("region"))


@query(f"WITH {EV}, a AS (SELECT ir, ic, count(*)::BIGINT AS early FROM ev WHERE win < 10 GROUP BY ALL), b AS (SELECT ir, ic, count(*)::BIGINT AS late, first(mag_type ORDER BY t_us, id) AS first_type FROM ev WHERE win >= 20 GROUP BY ALL) SELECT * FROM a JOIN b USING (ir, ic)")
def q_inner_merge(spark, sf):
    e = events(spark, sf)
    a = e.filter("win < 10").groupBy("ir", "ic").agg(F.count("*").alias("early"))
    b = e.filter("win >= 20").groupBy("ir", "ic").agg(F.count("*").alias("late"), F.min_by("mag_type", F.struct("t_us", "id")).alias("first_type"))
    return a.join(b, ["ir", "ic"])


@query(f"WITH {EV} SELECT id FROM ev WHERE (ir, ic) IN (SELECT (ir, ic) FROM ev WHERE mag >= 3.2) AND win IN (SELECT win FROM ev GROUP BY win HAVING count(*) > 30)")
def q_semi(spark, sf):
    e = events(spark, sf)
    busy = e.groupBy("win").agg(F.count("*").alias("n")).filter("n > 30")
    return e.join(e.filter("mag >= 3.2").select("ir", "ic"), ["ir", "ic"], "left_semi").join(busy, "win", "left_semi").select("id")


_LINE = [(0.0, 1.0), (3.0, 4.5), (5.5, 9.0), (9.0, 13.5)]
_EDGES = ", ".join(f"({k}, {a[0]}::DOUBLE, {a[1]}::DOUBLE, {b[0]}::DOUBLE, {b[1]}::DOUBLE)" for k, (a, b) in enumerate(zip(_LINE, _LINE[1:])))
_CLAMP = "greatest(0, least(1, ((ir - r0) * (r1 - r0) + (ic - c0) * (c1 - c0)) / ((r1 - r0) * (r1 - r0) + (c1 - c0) * (c1 - c0))))"
POLY = f"""edges(edge, r0, c0, r1, c1) AS (VALUES {_EDGES}), clamped AS (SELECT ir, ic, edge, r0, c0, r1, c1, {_CLAMP} AS t FROM cells, edges),
poly AS (SELECT ir, ic, min(sqrt((ir - r0 - t * (r1 - r0)) ** 2 + (ic - c0 - t * (c1 - c0)) ** 2)) AS dist, arg_min(edge, (sqrt((ir - r0 - t * (r1 - r0)) ** 2 + (ic - c0 - t * (c1 - c0)) ** 2), edge)) AS edge FROM clamped GROUP BY ir, ic)"""


def polyline(spark):
    """dist, edge of every cell: the nearest edge of a line, clamped to its ends."""
    edges = spark.createDataFrame([(k, *a, *b) for k, (a, b) in enumerate(zip(_LINE, _LINE[1:]))], "edge int, r0 double, c0 double, r1 double, c1 double")
    dr, dc = F.col("r1") - F.col("r0"), F.col("c1") - F.col("c0")
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((F.col("ir") - F.col("r0")) * dr + (F.col("ic") - F.col("c0")) * dc) / (dr * dr + dc * dc)))
    x, y = F.col("ir") - F.col("r0") - t * dr, F.col("ic") - F.col("c0") - t * dc
    d = GRID.cells(spark).crossJoin(F.broadcast(edges)).select("ir", "ic", F.struct(F.sqrt(x * x + y * y).alias("dist"), "edge").alias("m"))
    return d.groupBy("ir", "ic").agg(F.min("m").alias("m")).select("ir", "ic", "m.dist", "m.edge")


@query(f"""WITH {EV}, {CELLS}, {POLY} SELECT e.id, {r6("dist")} AS dist, CASE WHEN dist <= 2.5 THEN edge ELSE -1 END AS receiver FROM ev e JOIN poly USING (ir, ic)""")
def q_polyline_dist(spark, sf):
    """Each event's distance to the line, and the nearest edge as its receiver; beyond a reach the fallback."""
    near = F.broadcast(polyline(spark))  # one row a cell
    return events(spark, sf).join(near, ["ir", "ic"]).select("id", fixed(F.col("dist")).alias("dist"), F.when(F.col("dist") <= 2.5, F.col("edge")).otherwise(-1).alias("receiver"))


@query("""WITH v AS (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings), s AS (SELECT vec_id AS code, x, y FROM v WHERE x > 0), q AS (SELECT vec_id * 2 AS code, x, y FROM v),
n AS (SELECT q.code, arg_min(s.code, (sqrt((q.x-s.x)*(q.x-s.x)+(q.y-s.y)*(q.y-s.y)), s.code)) AS near, min(sqrt((q.x-s.x)*(q.x-s.x)+(q.y-s.y)*(q.y-s.y))) AS d FROM q, s WHERE q.code NOT IN (SELECT code FROM s) GROUP BY q.code)
SELECT code, code AS station, 'code' AS how FROM q WHERE code IN (SELECT code FROM s) UNION ALL SELECT code, CASE WHEN d < 0.1 THEN near END, CASE WHEN d < 0.1 THEN 'near' ELSE 'none' END FROM n""")
def q_station_match(spark, sf):
    """Stations by their code, else the nearest one within a distance."""
    e = F.col("embedding")
    v = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", e[0].cast("double").alias("x"), e[1].cast("double").alias("y"))
    s, asked = v.filter("x > 0").select(F.col("vec_id").alias("station"), "x", "y"), v.select((F.col("vec_id") * 2).alias("code"), "x", "y")
    codes = s.select(F.col("station").alias("code"))
    by_code = asked.join(codes, "code", "left_semi").select("code", F.col("code").alias("station"), F.lit("code").alias("how"))
    near = joins.nearest(asked.join(codes, "code", "left_anti"), s, "code", "station", 0.05)
    ok = F.col("distance") < 0.1
    return by_code.unionAll(near.select("code", F.when(ok, F.col("station")), F.when(ok, "near").otherwise("none")))


# buckets of time and place


@query(f"WITH {EV} SELECT id, {r6('(ic - 7) * 85.0::DOUBLE')} AS x, {r6('(ir - 5) * 111.0::DOUBLE')} AS y, {r6('5 + ((ir - 5) * 111.0::DOUBLE) / 111.0::DOUBLE')} AS lat, {r6('7 + ((ic - 7) * 85.0::DOUBLE) / 85.0::DOUBLE')} AS lon FROM ev")
def q_unproject(spark, sf):
    x, y = (F.col("ic") - 7) * 85.0, (F.col("ir") - 5) * 111.0
    return events(spark, sf).select("id", fixed(x).alias("x"), fixed(y).alias("y"), fixed(5 + y / 111.0).alias("lat"), fixed(7 + x / 85.0).alias("lon"))


@query(f"WITH {EV} SELECT {r6('(min(ir) + max(ir) + 1) / 2.0')} AS lat, {r6('(min(ic) + max(ic) + 1) / 2.0')} AS lon, {r6('(max(ir) + 1 - min(ir)) * 111.19::DOUBLE * (max(ic) + 1 - min(ic)) * 111.19::DOUBLE * cos(radians((min(ir) + max(ir) + 1) / 2.0))')} AS km2 FROM ev")
def q_region(spark, sf):
    """Centre and area of the region that the events span."""
    b = events(spark, sf).agg(F.min("ir").alias("a"), F.max("ir").alias("b"), F.min("ic").alias("c"), F.max("ic").alias("d"))
    lat = (F.col("a") + F.col("b") + 1) / 2.0
    area = (F.col("b") + 1 - F.col("a")) * 111.19 * (F.col("d") + 1 - F.col("c")) * 111.19 * F.cos(F.radians(lat))
    return b.select(fixed(lat).alias("lat"), fixed((F.col("c") + F.col("d") + 1) / 2.0).alias("lon"), fixed(area).alias("km2"))


@query("""SELECT o_orderkey, CASE WHEN o_orderdate < DATE '1998-01-01' THEN (CASE WHEN o_orderdate >= DATE '1998-01-01' - INTERVAL 548 DAY THEN 'tail of train' ELSE 'train' END) ELSE 'later' END AS part,
(o_orderdate < DATE '1996-06-01' AND o_orderdate + INTERVAL 30 DAY > DATE '1996-03-01') AS left_out FROM orders""")
def q_train_tail(spark, sf):
    """The last part of the training time, and windows of 30 days that overlap a period."""
    d = F.col("o_orderdate")
    tail = F.when(d >= F.date_sub(F.lit("1998-01-01").cast("date"), 548), "tail of train").otherwise("train")
    out = (d < "1996-06-01") & (F.date_add(d, 30) > F.lit("1996-03-01").cast("date"))
    return spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", F.when(d < "1998-01-01", tail).otherwise("later").alias("part"), out.alias("left_out"))
