"""Catalogs that come as text: HTML tables, XML, station series; and times without a zone."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rategrid.sources.shared import materialize

#: Columns of a line of the bulletin.
FIELDS = ("no", "code", "date", "time", "lat", "lon", "depth", "pref", "md", "ml", "mw", "ms", "mb", "kind", "place")


def number(text: Column) -> Column:
    """A number, or null for what stands for none."""
    t = F.trim(text)
    return F.when(~t.isin("", "-", "-.-", "0.0", "0"), t.try_cast("double"))


def bulletin(pages: DataFrame) -> DataFrame:
    """page_id, announced (rows the page says it has), rows (found) and the FIELDS of every row of tab-separated pages (page_id, html).

    The table stands in ``pre``; a row has 15 fields.  A page whose number of rows isn't the announced one shows in the counts; one that
    announces rows and has none is a row without fields.
    """
    body = F.regexp_extract("html", r"(?s)<pre>(.*?)</pre>", 1)
    announced = F.regexp_extract("html", r"(\d+) rows", 1).try_cast("long")
    return _table(pages.select("page_id", announced.alias("announced")), pages.select("page_id", F.explode(F.split(body, "\n")).alias("line")))


def bulletin_of_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What ``bulletin`` finds, for pages that come as lines (page_id, at: what orders them, line), so a page of any length is never one value; and
    page_id, announced of every page with a line."""
    lines = materialize(lines, "lines")
    n = F.regexp_extract("line", r"(\d+) rows", 1)
    first = lambda found, value: F.min(F.when(found, value))
    said = lines.groupBy("page_id").agg(first(n != "", F.struct("at", n.try_cast("long").alias("n"))).alias("_n"), first(F.contains("line", F.lit("<pre>")), F.col("at")).alias("_open"))
    said = materialize(said.select("page_id", F.col("_n.n").alias("announced"), "_open"), "said")
    after = F.when(F.col("at") == F.col("_open"), F.expr("substring(line, locate('<pre>', line) + 5)")).otherwise(F.col("line"))
    opened = lines.join(said.filter("_open IS NOT NULL").select("page_id", "_open"), "page_id").filter(F.col("at") >= F.col("_open")).select("page_id", "at", after.alias("line"))
    closed = opened.groupBy("page_id").agg(first(F.contains("line", F.lit("</pre>")), F.col("at")).alias("_close")).filter("_close IS NOT NULL")
    before = F.when(F.col("at") == F.col("_close"), F.substring_index("line", "</pre>", 1)).otherwise(F.col("line"))
    inside = opened.join(closed, "page_id").filter(F.col("at") <= F.col("_close")).select("page_id", before.alias("line"))
    said = said.select("page_id", "announced")
    return _table(said, inside), said


def _table(said: DataFrame, lines: DataFrame) -> DataFrame:
    """The rows among the lines (page_id, line) of pages, with what these announce (page_id, announced)."""
    rows = lines.withColumn("f", F.split("line", "\t")).filter(F.size("f") == len(FIELDS))
    found = rows.groupBy("page_id").agg(F.count("*").alias("rows"))
    every = said.join(found, "page_id", "left").filter("rows > 0 OR announced > 0")
    own = rows.select(F.col("page_id").alias("_page"), *[F.trim(F.col("f")[k]).alias(name) for k, name in enumerate(FIELDS)])
    return every.join(own, F.col("page_id") == F.col("_page"), "left").select("page_id", "announced", F.coalesce("rows", F.lit(0)).alias("rows"), *FIELDS)


def events_of_xml(pages: DataFrame) -> DataFrame:
    """The attributes of every ``earhquake`` element of XML texts (page_id, xml): page_id, name (local time), place, lat, lon, mag, depth."""
    attributes = {"name": "name", "place": "lokasyon", "lat": "lat", "lon": "lng", "mag": "mag", "depth": "Depth"}
    elements = pages.select("page_id", F.explode(F.regexp_extract_all("xml", F.lit(r"<earhquake\s[^>]*>"), 0)).alias("e"))
    of = lambda a: F.trim(F.regexp_extract("e", rf'\s{a}\s*=\s*"([^"]*)"', 1))
    text = [of(a).alias(n) if n in ("name", "place") else number(of(a)).alias(n) for n, a in attributes.items()]
    return elements.select("page_id", *text)


def to_utc(local: Column, zone: str = "Europe/Istanbul") -> Column:
    """UTC of a local time without zone, with the zone's rules of that day."""
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), local)


def station_series(lines: DataFrame) -> DataFrame:
    """station, day, decimal year, mjd, east, north (mm) of whitespace-separated lines (line); headers and short lines are left out."""
    f = F.split(F.trim("line"), r"\s+")
    rows = lines.select(f.alias("f")).filter((F.size("f") >= 11) & F.col("f")[2].try_cast("double").isNotNull())
    metres = lambda whole, part: (F.col("f")[whole].cast("double") + F.col("f")[part].cast("double")) * 1000
    return rows.select(
        F.col("f")[0].alias("station"), F.try_to_timestamp(F.concat(F.lit("20"), F.col("f")[1]), F.lit("yyyyMMMdd")).cast("date").alias("day"), F.col("f")[2].cast("double").alias("yr"),
        F.col("f")[3].cast("long").alias("mjd"), metres(7, 8).alias("east"), metres(9, 10).alias("north"),
    )


def station_steps(lines: DataFrame) -> DataFrame:
    """station, day, kind of lines ``NAME yyMMMdd kind ...``."""
    f = F.split(F.trim("line"), r"\s+")
    day = F.try_to_timestamp(F.concat(F.lit("20"), F.initcap(F.col("f")[1])), F.lit("yyyyMMMdd")).cast("date")
    return lines.select(f.alias("f")).filter(F.size("f") >= 3).select(F.col("f")[0].alias("station"), day.alias("day"), F.col("f")[2].try_cast("int").alias("kind")).filter("day is not null")


#: Names that a column may have in catalogs from elsewhere.
ALIASES = {
    "lat": ("latitude", "lat", "enlem"), "lon": ("longitude", "lon", "lng", "long", "boylam"), "mag": ("mag_w", "magnitude", "mag", "mw", "ml"),
    "depth": ("depth_km", "depth", "derinlik"), "time": ("datetime_utc", "datetime", "time", "origin_time", "days"),
}


def resolved(df: DataFrame, origin: str = "2003-01-01") -> DataFrame:
    """lat, lon, mag, depth and time (a timestamp without zone) of a catalog, whatever its columns are called.

    A time may be a timestamp, text, a number of days since ``origin``, or a date and a time column.  Depth may be missing.
    """
    known = {re.sub(r"[^a-z]", "_", c.lower()): c for c in df.columns}
    found = {k: next((known[a] for a in names if a in known), None) for k, names in ALIASES.items()}
    missing = [k for k in ("lat", "lon", "mag") if found[k] is None]
    if missing or found["time"] is None and "date" not in known:
        raise ValueError(f"no column for {missing or 'time'} among {df.columns}")
    if "date" in known and "time" in known and found["time"] == known["time"]:
        time = F.try_to_timestamp(F.concat_ws(" ", F.col(known["date"]).cast("string"), F.col(known["time"]).cast("string"))).cast("timestamp_ntz")
    else:
        column = found["time"] or known["date"]
        time = instants(F.col(column), dict(df.dtypes)[column], origin)
    depth = F.col(found["depth"]).cast("double") if found["depth"] else F.lit(None).cast("double")
    return df.select(*[F.col(found[k]).cast("double").alias(k) for k in ("lat", "lon", "mag")], depth.alias("depth"), time.alias("time"))


def instants(value: Column, kind: str, origin: str) -> Column:
    """A timestamp without zone from a column of type ``kind``; what is no kind of time raises before any row is read."""
    if kind in ("timestamp", "timestamp_ntz", "date"):
        return value.cast("timestamp_ntz")
    if kind in ("double", "float", "int", "bigint") or kind.startswith("decimal"):
        return F.timestamp_add("MICROSECOND", F.round(value.cast("double") * 86_400_000_000).cast("long"), F.lit(origin).cast("timestamp_ntz"))
    if kind == "string":
        return value.try_cast("timestamp_ntz")
    raise TypeError(f"{kind} is no time")
