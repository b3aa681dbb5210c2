"""Property tests: Spark expressions against plain-Python statements of the same rules."""

import datetime as dt
import math

from hypothesis import given, settings
from hypothesis import strategies as st

from wingspan import schemas as S
from wingspan.functions import exprs as X

coord = st.tuples(st.floats(-90, 90), st.floats(-180, 180), st.floats(-90, 90), st.floats(-180, 180))
dates = st.dates(min_value=dt.date(1990, 1, 1), max_value=dt.date(2030, 12, 31))


def py_haversine(lat1, lon1, lat2, lon2):
    p1, p2 = math.radians(lat1), math.radians(lat2)
    a = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(
        (math.radians(lon2) - math.radians(lon1)) / 2) ** 2
    return S.EARTH_RADIUS_KM * 2 * math.asin(math.sqrt(min(1.0, a)))


def py_month_starts(start, end):
    out, cur = [], start
    while cur <= end:
        out.append(cur)
        cur = dt.date(cur.year + (cur.month == 12), cur.month % 12 + 1, 1)
    return out


@settings(max_examples=1, deadline=None)
@given(st.lists(coord, min_size=50, max_size=50))
def test_haversine_matches_python(spark, pts):
    got = [r[0] for r in spark.createDataFrame(pts, "a double, b double, c double, d double")
           .select(X.haversine_km("a", "b", "c", "d")).collect()]
    for g, p in zip(got, pts):
        assert abs(g - py_haversine(*p)) <= 0.0051


@settings(max_examples=1, deadline=None)
@given(st.lists(st.tuples(dates, st.integers(0, 40)), min_size=40, max_size=40))
def test_month_series_matches_loop(spark, spans):
    rows = [(s, X.add_months(s, m)) for s, m in spans]
    got = [r[0] for r in spark.createDataFrame(rows, "a date, b date")
           .select(X.month_start_series("a", "b")).collect()]
    assert got == [py_month_starts(a, b) for a, b in rows]


@settings(max_examples=1, deadline=None)
@given(st.lists(st.one_of(st.none(), st.floats(0, 20000)), min_size=60, max_size=60),
       st.lists(st.integers(0, 10**9), min_size=60, max_size=60))
def test_band_and_seats(spark, dists, seeds):
    rows = list(zip(dists, seeds))
    out = spark.createDataFrame(rows, "d double, k bigint").select(
        X.distance_band("d").alias("band"), X.seat_estimate("d", "k").alias("seats")).collect()
    for (d, k), r in zip(rows, out):
        if d is None or d >= 4000:
            band, lo, hi = S.BAND_ULTRA, 250, 550
        elif d < 500:
            band, lo, hi = S.BAND_SHORT, 100, 180
        elif d < 1500:
            band, lo, hi = S.BAND_MEDIUM, 120, 220
        else:
            band, lo, hi = S.BAND_LONG, 150, 300
        assert r["band"] == band and r["seats"] == lo + k % (hi - lo + 1)


@given(dates, st.integers(-40, 40))
def test_add_months_clamps(day, n):
    got = X.add_months(day, n)
    months = (got.year - day.year) * 12 + got.month - day.month
    assert months == n and (got.day == day.day or got.day < day.day)
