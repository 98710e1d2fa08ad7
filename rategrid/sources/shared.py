"""The folder that driver and executors share, and tables written there between steps."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list = []


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where it is unset, a temporary folder in local mode, where one machine does everything, and
    the warehouse on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        local = spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"
        found = "file://" + tempfile.mkdtemp(prefix="rategrid-") if local else spark.conf.get("spark.sql.warehouse.dir")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def release() -> None:
    """Deletes the tables that ``materialize`` has written so far; for long sessions, once their results are read.  Runs when the driver ends."""
    while _written:
        path, fs = _written.pop()
        try:
            fs.delete(path, True)
        except Exception:  # the JVM may have ended before
            return


def release_later(spark: SparkSession, path: str) -> None:
    """``release`` will delete ``path``."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not _written:
        atexit.register(release)
    _written.append((jvm_path, jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())))


def materialize(df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared folder and return the written table.

    This cuts the lineage in a way that survives lost executors, and lets several consumers read what one pass made.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/rategrid-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    release_later(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed_table(df: DataFrame, label: str, keys: list[str], buckets: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder as a table in buckets sorted by ``keys``, and return it.  Grouping and joining it by ``keys`` then needs
    no shuffle, however often it is read.  A bucket is written by one task, so a key's rows are in one file."""
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"rategrid_{label.replace('-', '_')}_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/{name}"
    df.repartition(n, *keys).write.bucketBy(n, *keys).sortBy(*keys).option("path", path).saveAsTable(name)
    release_later(spark, path)
    return spark.table(name)
