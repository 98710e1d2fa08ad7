import random

import pytest
from pyspark.sql import functions as F

from rategrid.operators.isotonic import pool
from rategrid.plans.base import GRID, events
from rategrid.plans.contract import FEATURES
from rategrid.plans.model import _kernel, kde
from rategrid.operators.features import dense
from rategrid.__main__ import main
from rategrid.sources import params, tables, text

SF = "/root/testdata/sf0.001"


def test_columns_are_found_by_their_names(spark):
    df = spark.createDataFrame([("40.5", 27.1, 3.0, "2020-01-02", "03:04:05")], "Lat string, `Long` double, ML double, Date string, Time string")
    r = text.resolved(df).first()
    assert (r["lat"], r["lon"], r["mag"], r["depth"], str(r["time"])) == (40.5, 27.1, 3.0, None, "2020-01-02 03:04:05")
    with pytest.raises(ValueError):
        text.resolved(df.drop("ML"))
    with pytest.raises(TypeError):
        text.resolved(df.select("Lat", "Long", "ML", F.array(F.lit(1)).alias("time")))


def test_a_page_with_other_rows_than_it_announces_shows(spark):
    row = "\t".join(["1", "c", "2020.01.01", "00:00:00", "40", "27", "5", "3.1", "-.-", "3.1", "", "", "0.0", "Ke", "X"])
    page = f"<b>2 rows</b><pre>head\n{row}\nshort\trow\n</pre>"
    got = text.bulletin(spark.createDataFrame([(1, page), (2, None), (3, "")], "page_id int, html string")).collect()
    assert len(got) == 1 and (got[0]["announced"], got[0]["rows"]) == (2, 1)


def test_local_times_follow_the_zone(spark):
    df = spark.createDataFrame([("2015-01-15 12:00:00",), ("2015-07-15 12:00:00",), ("2020-01-15 12:00:00",)], "t string").select(F.col("t").cast("timestamp_ntz").alias("t"))
    assert [str(r[0])[11:16] for r in df.select(text.to_utc(F.col("t"))).collect()] == ["10:00", "09:00", "09:00"]


def test_absent_sources_are_said_to_be_absent(spark):
    assert tables.available(spark, f"{SF}/events.parquet", ("ts",)) == (True, "")
    assert not tables.available(spark, f"{SF}/events.parquet", ("nothing",))[0]
    assert not tables.available(spark, f"{SF}/no.parquet")[0]


def test_sources_look_only_before_their_window(spark):
    cells = dense(spark, GRID, 10, 12)
    for source in FEATURES[:2]:
        whole = source.add_columns(cells, spark, SF)
        cut = source.truncated(cells, spark, SF, 11)
        assert whole.columns == ["window", "ir", "ic", *source.columns] and whole.count() == 450
        same = lambda df: sorted(df.filter("window <= 11").collect())
        assert same(whole) == same(cut) and sorted(whole.collect()) != sorted(cut.collect())


def test_pooling_by_brute_force(spark):
    r = random.Random(7)
    rows = [(k, float(r.randrange(9)), float(r.randrange(1, 9))) for k in range(40)]
    got = {x["k"]: x["q"] for x in pool(spark.createDataFrame(rows, "k long, s double, w double"), "k", "s", "w").collect()}
    mean = lambda a, z: sum(x[1] for x in rows[a : z + 1]) / sum(x[2] for x in rows[a : z + 1])
    assert all(abs(got[k] - max(min(mean(a, z) for z in range(k, 40)) for a in range(k + 1))) < 1e-12 for k in range(40))


def test_background_sums_to_one(spark):
    assert abs(kde(spark, SF).agg(F.sum("u")).first()[0] - 1) < 1e-12 and _kernel("ir", "ic") is not None and events(spark, SF).count() > 0


def test_sources_do_not_see_past_a_cutoff_within_a_day(spark):
    """The cutoff lies in the middle of a day: windows that begin before it are the same, the later ones are not."""
    cells = dense(spark, GRID, 10, 12)
    for source in FEATURES[:3]:
        whole, cut = (sorted(df.collect()) for df in (source.add_columns(cells, spark, SF), source.truncated(cells, spark, SF, 11.5)))
        assert [r for r in whole if r["window"] <= 11] == [r for r in cut if r["window"] <= 11]
        assert whole != cut


def test_parameters_come_back(spark, tmp_path):
    path = str(tmp_path / "params")
    params.save(spark, path, "a", {"mu": 1.5, "k": 0.1})
    params.save(spark, path, "b", {"mu": 9.0})
    params.save(spark, path, "a", {"mu": 2.5, "k": 1e-17})
    assert params.load(spark, path, "a") == {"mu": 2.5, "k": 1e-17} and params.load(spark, path, "b") == {"mu": 9.0}
    with pytest.raises(KeyError):
        params.load(spark, path, "c")


def test_command_line(spark, tmp_path, capsys):
    assert main(["list"]) == 0 and "q_feature_cube" in capsys.readouterr().out.split()
    assert main(["run", "q_days", "--data", SF, "--out", str(tmp_path / "x"), "--format", "csv"], spark) == 0
    assert spark.read.csv(str(tmp_path / "x"), header=True).count() == events(spark, SF).count()
    assert main(["run", "nothing", "--data", SF], spark) == 2
