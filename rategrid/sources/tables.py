"""Sinks, reports and sources that may be absent."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException


def write_csv(df: DataFrame, path: str) -> None:
    """A CSV catalog with a header; times to the microsecond, nulls empty."""
    df.write.mode("overwrite").option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS").csv(path, header=True, nullValue="")


def write_partitioned(df: DataFrame, path: str, by: tuple = ("window",)) -> None:
    """Parquet in folders by ``by``.  Rows of a folder come together first, so a folder has few files."""
    df.repartition(*by).write.mode("overwrite").partitionBy(*by).parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    """Rows as JSON lines, with nested columns as they are."""
    df.write.mode("overwrite").json(path)


def read_report(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(path)


def digest(df: DataFrame, columns: list[str], name: str = "sha") -> DataFrame:
    """``df`` with the first 16 digits of the sha256 of its row's JSON, keys in order of name."""
    return df.withColumn(name, F.substring(F.sha2(F.to_json(F.struct(*sorted(columns))), 256), 1, 16))


def available(spark: SparkSession, path: str, columns: tuple = ()) -> tuple[bool, str]:
    """Whether a Parquet source is there with its columns, and why not.  What is absent is said to be absent, never made up."""
    try:
        found = spark.read.parquet(path).columns
    except AnalysisException as e:
        return False, f"absent: {e.getCondition() or path}"
    missing = [c for c in columns if c not in found]
    return (False, f"lacks {', '.join(missing)}") if missing else (True, "")
