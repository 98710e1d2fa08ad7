"""Tables so dense that forecasts are 1 and every cell has its event: quotients and logarithms have no finite value."""

import math
import shutil
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from rategrid.functions.core import fixed, ln, ratio
from rategrid.plans.registry import ORACLES, QUERIES
from tests.conftest import views


@pytest.fixture(scope="module")
def dense(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("dense"))
    at = F.timestamp_add("SECOND", (F.col("id") * 12).cast("long"), F.lit("2024-01-01").cast("timestamp_ntz"))
    rows = spark.range(216_000, numPartitions=1).select(F.col("id").alias("event_id"), at.alias("ts"), (F.col("id") % 150).alias("user_id"), F.lit("view").alias("event_type"), (50.0 + F.col("id") % 7).alias("value"))
    rows.write.parquet(f"{folder}/events.parquet")
    part = next(p for p in Path(folder, "events.parquet").glob("part-*"))
    part.rename(f"{folder}/e.tmp")
    shutil.rmtree(f"{folder}/events.parquet")
    Path(f"{folder}/e.tmp").rename(f"{folder}/events.parquet")
    return folder


def _rows(rows, skip=()):
    plain = lambda v: "nan" if isinstance(v, float) and math.isnan(v) else float(v) if isinstance(v, (int, float)) else v
    return sorted((tuple(plain(v) for i, v in enumerate(r) if i not in skip) for r in rows), key=str)


NAMES = ["q_mechanism", "q_reliability_q", "q_top_share", "q_identity", "q_info_gain", "q_prospective_score", "q_report_rule", "q_union_prob", "q_score_bundle", "q_sigma_select", "q_occ_scalar", "q_blend"]


@pytest.mark.parametrize("name", NAMES)
def test_saturated_forecasts(spark, dense, name):
    df = QUERIES[name](spark, dense)
    relation = views(dense).sql(ORACLES[name])
    # all windows tie for the top one, and the SQL leaves open which it names
    skip = {df.columns.index("top_window")} if name == "q_top_share" else ()
    theirs = [tuple(r[relation.columns.index(c)] for c in df.columns) for r in relation.fetchall()]
    assert _rows(map(tuple, df.collect()), skip) == _rows(theirs, skip) != []


def test_quotients_and_logarithms(spark):
    inf, nan = float("inf"), float("nan")
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (nan, 0.0), (None, 0.0), (1.0, nan)], "a double, b double")
    got = [r[0] for r in df.select(ratio(F.col("a"), F.col("b"))).collect()]
    assert str(got) == str([0.5, inf, -inf, nan, nan, None, nan])
    row = spark.range(1).select(ln(F.lit(0.0)), ln(F.lit(1.0)), fixed(F.lit(inf)), fixed(F.lit(nan)), fixed(F.lit(1e15)), fixed(F.lit(0.1234565))).first()
    assert str(tuple(row)) == str((-inf, 0.0, inf, nan, 1e15, 0.123457))
