"""Fitted parameters, kept as rows of JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "model string, name string, value double"


def save(spark: SparkSession, path: str, model: str, values: dict[str, float]) -> None:
    """Adds a model's parameters to those at ``path``; a model saved again is read as it was saved last."""
    rows = spark.createDataFrame([(model, k, float(v)) for k, v in values.items()], SCHEMA)
    rows.withColumn("saved", F.current_timestamp()).coalesce(1).write.mode("append").json(path)


def load(spark: SparkSession, path: str, model: str) -> dict[str, float]:
    """The parameters of a model; KeyError if there is none of that name."""
    rows: DataFrame = spark.read.schema(SCHEMA + ", saved timestamp").json(path).filter(F.col("model") == model)
    last = rows.groupBy("name").agg(F.max_by("value", "saved").alias("value")).collect()  # a row for each parameter
    if not last:
        raise KeyError(model)
    return {r["name"]: r["value"] for r in last}
