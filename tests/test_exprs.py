"""Scalar expressions (H1-H14, B8) on literal frames."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from wingspan import schemas as S
from wingspan.functions import exprs as X


def one(spark, col, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(col).collect()]


def test_haversine_vectors(spark):
    rows = [(40.7128, -74.0060, 34.0522, -118.2437), (10.0, 20.0, 10.0, 20.0), (0.0, 0.0, 0.0, 180.0)]
    out = one(spark, X.haversine_km("a", "b", "c", "d"), rows, "a double, b double, c double, d double")
    assert abs(out[0] - 3944) < 10  # documented as "approx 3944"
    assert out[1] == 0.0
    assert out[2] == pytest.approx(math.pi * S.EARTH_RADIUS_KM, abs=0.01)  # antipodal: asin stays defined


def test_quarter_of_month(spark):
    out = one(spark, X.quarter_of_month("m"), [(m,) for m in range(1, 13)], "m int")
    assert out == [1, 1, 1, 2, 2, 2, 3, 3, 3, 4, 4, 4]


def test_distance_band_edges(spark):
    vals = [(499.99,), (500.0,), (1499.99,), (1500.0,), (3999.99,), (4000.0,), (None,)]
    out = one(spark, X.distance_band("d"), vals, "d double")
    assert out == [S.BAND_SHORT, S.BAND_MEDIUM, S.BAND_MEDIUM, S.BAND_LONG, S.BAND_LONG, S.BAND_ULTRA, S.BAND_ULTRA]
    ranks = one(spark, X.band_rank(X.distance_band("d")), vals, "d double")
    assert ranks == [1, 2, 2, 3, 3, 4, 4]


def test_seat_estimate_ranges_and_determinism(spark):
    rows = [(d, k) for d in (100.0, 800.0, 2000.0, 9000.0, None) for k in range(0, 400, 7)]
    df = spark.createDataFrame(rows, "d double, k bigint").withColumn("s", X.seat_estimate("d", "k"))
    got = df.collect()
    bounds = {100.0: (100, 180), 800.0: (120, 220), 2000.0: (150, 300), 9000.0: (250, 550), None: (250, 550)}
    for r in got:
        lo, hi = bounds[r["d"]]
        assert lo <= r["s"] <= hi
    assert [r["s"] for r in df.collect()] == [r["s"] for r in got]
    # the whole inclusive range is reachable
    assert {r["s"] for r in spark.range(0, 81).select(X.seat_estimate(F.lit(1.0), "id").alias("s")).collect()} == set(range(100, 181))


def test_flight_number(spark):
    out = one(spark, X.flight_number("c", "k"), [("AA", 0), ("AA", 9899), ("AA", 9900), (None, 5)], "c string, k bigint")
    assert out == ["AA100", "AA9999", "AA100", None]


def test_first_token(spark):
    vals = [(None,), ("",), ("   ",), ("738",), ("320 738 77W",), ("\t738 320",), (" \t ",), ("738\n",)]
    out = one(spark, X.first_token("e"), vals, "e string")
    assert out == ["Unknown", "Unknown", "Unknown", "738", "320", "738", "Unknown", "738"]


def test_flag_and_default(spark):
    assert one(spark, X.flag_to_int("f"), [("Y",), ("N",), (None,), ("y",)], "f string") == [1, 0, 0, 0]
    assert one(spark, X.int_or_default("s"), [("2",), (None,), ("x",)], "s string") == [2, 0, 0]


def test_month_start_series(spark):
    rows = [(dt.date(2021, 1, 15), dt.date(2023, 1, 15)), (dt.date(2021, 1, 1), dt.date(2023, 1, 1)),
            (dt.date(2021, 1, 31), dt.date(2021, 3, 31)), (dt.date(2021, 3, 5), dt.date(2021, 3, 20)),
            (dt.date(2021, 4, 1), dt.date(2021, 3, 1))]
    out = one(spark, X.month_start_series("a", "b"), rows, "a date, b date")
    assert len(out[0]) == 25 and out[0][0] == dt.date(2021, 1, 15) and out[0][1] == dt.date(2021, 2, 1)
    assert len(out[1]) == 25
    assert out[2] == [dt.date(2021, 1, 31), dt.date(2021, 2, 1), dt.date(2021, 3, 1)]
    assert out[3] == [dt.date(2021, 3, 5)]
    assert out[4] == []


def test_day_series(spark):
    out = one(spark, X.day_series("a", "b"), [(dt.date(2020, 2, 27), dt.date(2020, 3, 1))], "a date, b date")
    assert out[0] == [dt.date(2020, 2, 27), dt.date(2020, 2, 28), dt.date(2020, 2, 29), dt.date(2020, 3, 1)]


def test_safe_ratio_and_mb(spark):
    out = one(spark, X.safe_ratio("a", "b"), [(10.0, 2.0), (5.0, 0.0)], "a double, b double")
    assert out == [5.0, float("inf")]
    out = one(spark, X.safe_ratio("a", "b", 0.0), [(5.0, 0.0)], "a double, b double")
    assert out == [0.0]
    assert one(spark, X.bytes_to_mb("n"), [(1048576,), (1572864,)], "n bigint") == [1.0, 1.5]


def test_month_start_date(spark):
    assert one(spark, X.month_start_date("y", "m"), [(2024, 2)], "y int, m int") == [dt.date(2024, 2, 1)]


def test_add_months_clamp():
    assert X.add_months(dt.date(2000, 3, 31), -1) == dt.date(2000, 2, 29)
    assert X.add_months(dt.date(2001, 3, 31), -1) == dt.date(2001, 2, 28)
    assert X.add_months(dt.date(2001, 8, 1), -24) == dt.date(1999, 8, 1)


def test_null_tokens(spark):
    vals = [(t,) for t in ["NA", "", "null", "N/A", "ok", None]]
    assert one(spark, X.null_tokens("s"), vals, "s string") == [None, None, None, None, "ok", None]


def test_mean_exact_half_up(spark):
    from decimal import Decimal

    # 1/32 = 0.03125 -> 0.0313 (a tie); 2/3 -> 0.6667; cents to 6 decimals
    rows = [(1, 0), (0, 0)] + [(0, 0)] * 30
    df = spark.createDataFrame(rows, "a int, g int")
    assert df.agg(X.mean("a").alias("m")).collect()[0]["m"] == 0.0313
    df = spark.createDataFrame([(1,), (1,), (0,)], "a int")
    assert df.agg(X.mean("a").alias("m")).collect()[0]["m"] == 0.6667
    df = spark.createDataFrame([(Decimal("0.01"),)] + [(Decimal("0.00"),)] * 31, "d decimal(10,2)")
    assert df.agg(X.mean("d", *X.DISTANCE_SCALE).alias("m")).collect()[0]["m"] == 0.000313  # 0.0003125 up
    df = spark.createDataFrame([(-1,), (0,)], "a int")
    assert df.agg(X.mean("a").alias("m")).collect()[0]["m"] == -0.5
    df = spark.createDataFrame([(None,)], "a int")
    assert df.agg(X.mean("a").alias("m")).collect()[0]["m"] is None
