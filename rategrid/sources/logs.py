"""Append-only logs of forecasts and typed CSV catalogs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

#: Columns of a raw event catalog.
CATALOG = (
    "datetime_utc timestamp_ntz, latitude double, longitude double, depth_km double, mag_pref double, mag_type string, md double, ml double, mw double, "
    "ms double, mb double, location_name string, catalog_source string, source_file string, event_code string"
)


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """A CSV catalog with a header; what doesn't parse is null."""
    return spark.read.schema(CATALOG).csv(path, header=True, mode="PERMISSIVE")


def append_new(rows: DataFrame, path: str, key: str) -> None:
    """Appends the rows whose key the JSON log at ``path`` doesn't hold yet; of rows that share a key one is taken.  Running it again adds
    nothing."""
    spark = rows.sparkSession
    first = rows.groupBy(key).agg(F.min(F.struct(*rows.columns)).alias("_r")).select("_r.*")
    try:
        known = spark.read.schema(rows.schema).json(path).select(key)
    except AnalysisException:  # no log yet
        known = None
    fresh = first if known is None else first.join(known, key, "left_anti")
    fresh.write.mode("append").json(path)
