import os
import sys
import tempfile
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    scratch = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    conf = {
        "spark.master": "local[4]", "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g", "spark.sql.session.timeZone": "UTC",
        "spark.local.dir": scratch, "spark.checkpoint.dir": f"file://{scratch}/shared", "spark.sql.warehouse.dir": f"{scratch}/warehouse",
    }
    session = SparkSession.builder.config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def same_rows(spark_rows, columns, relation) -> bool:
    """Whether Spark rows and a DuckDB result hold the same rows, whatever their order."""
    order = [relation.columns.index(c) for c in columns]
    theirs = [tuple(r[i] for i in order) for r in relation.fetchall()]
    key = lambda r: tuple((v is None, str(v)) for v in r)
    plain = lambda v: float(v) if isinstance(v, float) else int(v) if isinstance(v, bool) else v
    ours = sorted((tuple(plain(v) for v in r) for r in spark_rows), key=key)
    return ours == sorted((tuple(plain(v) for v in r) for r in theirs), key=key)


def views(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con
