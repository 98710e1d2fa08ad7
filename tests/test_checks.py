"""Permutation importance, consistency tests and encoded files against hand-made cases."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rategrid.operators import consistency, importance
from rategrid.operators.resample import digits
from rategrid.sources import encoded, text


def test_a_permutation_within_groups(spark):
    r = random.Random(1)
    rows = [(w, i, r.random(), r.random(), i % 2) for w in (1, 2, None) for i in range(40)]
    df = spark.createDataFrame(rows, "w int, i int, a double, b double, y int")
    for by, buckets in ((["w"], 1), (["w"], 5), ([], 7)):
        got = importance.permuted(df, by, ["w", "i"], ["a", "b"], "s", buckets).collect()
        assert importance.permuted(df, by, ["w", "i"], ["a", "b"], "s", buckets).exceptAll(df.select("*").limit(0)).count() == 120
        own = {(x[0], x[1]): x for x in rows}
        assert Counter((x["w"], x["i"], x["y"]) for x in got) == Counter((x[0], x[1], x[4]) for x in rows)
        groups = Counter(((x["w"],) if by else ()) + (x["a"], x["b"]) for x in got)
        assert groups == Counter(((x[0],) if by else ()) + (x[2], x[3]) for x in rows)  # columns move together
        assert sum(own[x["w"], x["i"]][2] == x["a"] for x in got) < 15
        assert sorted(map(str, got)) == sorted(map(str, importance.permuted(df.repartition(3), by, ["w", "i"], ["a", "b"], "s", buckets).collect()))


def test_importance_by_hand(spark):
    """Four rows whose permutation is worked out from the hashes."""
    rows = [(0, 1.0, 1), (1, 2.0, 0), (2, 4.0, 1), (3, 8.0, 0)]
    df = spark.createDataFrame(rows, "i int, x double, y int")
    at = {s: {k["i"]: k["h"] for k in df.select("i", digits(F.concat_ws("-", F.lit(f"p-x{s}"), "i"), 1, 8).alias("h")).collect()} for s in "ab"}
    to, source = sorted(range(4), key=lambda i: at["a"][i]), sorted(range(4), key=lambda i: at["b"][i])
    moved = {i: rows[j][1] for i, j in zip(to, source)}
    score = lambda lam: F.sum(F.col("y") * F.log(lam) - lam)
    got = {k["name"]: (k["score"], k["loss"]) for k in importance.importance(df, {"x": ["x"]}, lambda: F.col("x"), score, [], ["i"]).collect()}
    whole = math.log(1) + math.log(4) - 15
    after = sum(y * math.log(moved[i]) - moved[i] for i, _, y in rows)
    assert got["all"] == pytest.approx((whole, 0)) and got["x"] == pytest.approx((after, whole - after))


def test_consistency_by_hand(spark):
    rates = spark.createDataFrame([("p", 3.0), ("q", 1.0), ("z", 0.0)], "cell string, lam double")
    counts = spark.createDataFrame([(0, "p", 2), (0, "q", 1), (1, "p", 4), (2, "q", 2), (3, "z", 1)], "catalog long, cell string, n long")
    scores = consistency.catalog_scores(counts, rates, spark.range(5).select(F.col("id").alias("catalog")), ["cell"])
    got = {x["catalog"]: (x["n"], x["s"], x["pl"]) for x in scores.collect()}
    s, pl = {"p": math.log(0.75), "q": math.log(0.25), "z": math.log(1e-12)}, {"p": math.log(3), "q": 0.0, "z": math.log(1e-12)}
    want = {0: (3, 2 * s["p"] + s["q"], 2 * pl["p"]), 1: (4, 4 * s["p"], 4 * pl["p"]), 2: (2, 2 * s["q"], 0.0), 3: (1, s["z"], pl["z"]), 4: (0, 0.0, 0.0)}
    assert {k: pytest.approx(v) for k, v in want.items()} == got
    v = consistency.verdicts(scores, 0).first()
    assert (v["catalogs"], v["delta1"], v["delta2"]) == (4, 0.25, 0.75)
    assert v["s"] == sum(want[k][1] <= want[0][1] for k in range(1, 5)) / 4 and v["pl"] == sum(want[k][2] <= want[0][2] for k in range(1, 5)) / 4
    assert v["n_passes"] and v["s_passes"] and v["pl_passes"]


@pytest.mark.parametrize("encoding, place", [("cp1254", "İZMİR KÖRFEZİ – Şile"), ("iso-8859-9", "ÇANAKKALE ığüş")])
def test_encoded_pages_come_back(spark, tmp_path, encoding, place):
    row = "\t".join(["1", "c", "2020.01.01", "00:00:00", "40", "27", "5", "3.1", "-.-", "3.1", "", "", "0.0", "Ke", place])
    pages = {1: ["<b>2 rows</b><pre>head", row, row, "</pre>"], 2: ["<b>1 rows</b><pre>head", row, row, "</pre>"], 3: ["<b>4 rows</b><pre>", "</pre>"], 4: ["<b>0 rows</b>"]}
    lines = spark.createDataFrame([(k, i, x) for k, some in pages.items() for i, x in enumerate(some)], "page_id int, i int, line string")
    folder = str(tmp_path / "pages")
    encoded.write_pages(lines, folder, "page_id", ["i"], encoding)
    raw = b"".join(p.read_bytes() for p in (tmp_path / "pages").rglob("*.csv"))
    assert place.encode(encoding) in raw and place.encode() not in raw
    back = encoded.read_pages(spark, folder, encoding, "*.csv")
    got = text.bulletin(back)
    assert {x["place"] for x in got.collect()} == {place, None}
    assert {tuple(x) for x in encoded.judged(back, got).collect()} == {(1, 2, 2, True), (2, 1, 2, False), (3, 4, 0, False), (4, 0, 0, True)}
    assert [(x["announced"], x["rows"], x["no"]) for x in got.collect() if x["page_id"] == 3] == [(4, 0, None)]
    bad = tmp_path / "bad"
    bad.mkdir()
    (bad / "x.html").write_bytes(b"<b>1 rows</b>\x81\xff")
    assert encoded.read_pages(spark, str(bad), "ascii").first()["html"].startswith("<b>1 rows</b>\ufffd")
