"""Named queries (Q1-Q8, E3) on literal fact rows with the edges from FIXTURES.md."""

import datetime as dt
from decimal import Decimal

import pytest

from factfix import AS_OF, fact
from wingspan.plans import catalog as Q


def test_trailing_window_edges(spark):
    # as_of on the 31st: 12 months back clamps to 2023-03-31
    rows = [
        dict(flight_date=dt.date(2023, 3, 31), flight_number="edge"),
        dict(flight_date=dt.date(2023, 3, 30), flight_number="before"),
        dict(flight_date=dt.date(2024, 6, 1), flight_number="future"),
        dict(flight_date=None, flight_number="nodate"),
    ]
    out = Q.top_10_hubs(fact(spark, rows), AS_OF).collect()
    assert out[0]["num_routes"] == 2  # edge + future; one day before and null drop
    assert out[0]["total_seats"] == 400


def test_top_hubs_tie_order_and_distinct(spark):
    rows = []
    for i in range(12):
        rows.append(dict(origin_airport=f"H{i:02d}", seats=100 + (i // 2) * 10, flight_number=f"F{i}"))
    rows += [dict(origin_airport="H11", flight_number="F11", seats=0),
             dict(origin_airport="H11", flight_number=None, seats=0)]
    out = Q.top_10_hubs(fact(spark, rows), AS_OF).collect()
    assert len(out) == 10
    names = [r["origin_airport"] for r in out]
    # equal seats -> ascending key
    assert names[:2] == ["H10", "H11"]
    h11 = [r for r in out if r["origin_airport"] == "H11"][0]
    assert h11["num_routes"] == 1  # repeated and null flight numbers
    assert h11["avg_seats_per_flight"] == pytest.approx(150 / 3, abs=1e-4)


def test_underserved_having_edges(spark):
    base = dict(flight_date=dt.date(2024, 2, 1))
    rows = [dict(base, origin_airport="A", seats=300) for _ in range(4)]          # 4 flights: kept by count
    rows += [dict(base, origin_airport="B", seats=300) for _ in range(5)]         # 5 flights, big: dropped
    rows += [dict(base, origin_airport="C", seats=s) for s in (149, 150, 151, 149, 150, 150, 150)]  # avg 149.857
    rows += [dict(base, origin_airport="D", seats=150) for _ in range(5)]         # avg exactly 150: dropped
    out = {r["origin_airport"]: r for r in Q.underserved_routes(fact(spark, rows), AS_OF).collect()}
    assert set(out) == {"A", "C"}
    assert out["A"]["flights_per_month"] == 4 and out["A"]["monthly_capacity"] == 1200


def test_regional_capacity_types(spark):
    rows = [dict(seats=100, distance_km=Decimal("1000.50")), dict(seats=200, distance_km=Decimal("999.50"))]
    r = Q.regional_capacity(fact(spark, rows), AS_OF).collect()[0]
    assert r["route_count"] == 2 and r["total_capacity"] == 300
    assert r["avg_distance"] == 1000.0
    assert r["capacity_kilometers"] == pytest.approx(100 * 1000.5 + 200 * 999.5)


def test_distance_bands_and_null(spark):
    dists = [Decimal("499.99"), Decimal("500.00"), Decimal("1499.99"), Decimal("1500.00"),
             Decimal("3999.99"), Decimal("4000.00"), None]
    rows = [dict(distance_km=d) for d in dists]
    out = Q.distance_analysis(fact(spark, rows), AS_OF).collect()
    assert [r["distance_category"] for r in out] == [
        "Short-haul (<500km)", "Medium-haul (500-1500km)", "Long-haul (1500-4000km)", "Ultra-long-haul (>4000km)"]
    assert [r["num_routes"] for r in out] == [1, 2, 2, 2]


def test_capacity_trends_and_mom(spark):
    rows = [dict(flight_date=dt.date(2024, 1, 5), airline_code="A"), dict(flight_date=dt.date(2024, 1, 9), airline_code="B"),
            dict(flight_date=dt.date(2024, 2, 5), airline_code="A", seats=500)]
    out = Q.capacity_trends(fact(spark, rows), AS_OF).collect()
    assert [(r["flight_month"], r["num_airlines"], r["num_flights"]) for r in out] == [(1, 2, 2), (2, 1, 1)]
    mom = Q.month_over_month(fact(spark, rows), AS_OF).collect()
    assert mom[0]["prev_total_seats"] is None and mom[1]["seat_change"] == 500 - 400
    series = Q.capacity_trend_series(fact(spark, rows), AS_OF).collect()
    assert series[0]["date"] == dt.date(2024, 1, 1)


def test_hub_concentration(spark):
    rows = [dict(origin_airport=f"H{i}", seats=s) for i, s in enumerate([500, 300, 100, 100])]
    out = Q.hub_concentration(fact(spark, rows), AS_OF, top=None).collect()
    assert [r["origin_airport"] for r in out] == ["H0", "H1", "H2", "H3"]
    assert [r["cumulative_pct"] for r in out] == [50.0, 80.0, 90.0, 100.0]
    assert [r["hub_rank"] for r in out] == [1, 2, 3, 4]
    assert len(Q.hub_concentration(fact(spark, rows), AS_OF, top=2).collect()) == 2


def test_flow_matrix_missing_pair(spark):
    rows = [dict(origin_region="Europe", destination_region="Asia", seats=10),
            dict(origin_region="Asia", destination_region="Europe", seats=20)]
    out = {r["origin_region"]: r for r in Q.regional_flow_matrix(fact(spark, rows), AS_OF).collect()}
    assert out["Europe"]["Asia"] == 10 and out["Europe"]["Europe"] == 0 and out["Asia"]["Europe"] == 20


def test_registry_accessors():
    assert Q.list_queries()[:5] == ["top_10_hubs", "regional_capacity", "underserved_routes", "capacity_trends",
                                    "distance_analysis"]
    assert Q.get_query_info("top_10_hubs")["category"] == "Hub Analysis"
    assert "Hub Analysis" in Q.list_queries_by_category()
    with pytest.raises(KeyError):
        Q.get_query("nope")


def test_sql_text_equals_dataframe(spark):
    from conftest import SF_SMALL
    from wingspan.operators import reconcile as G
    from wingspan.plans.fixture import flights

    f = flights(spark, SF_SMALL)
    f.createOrReplaceTempView("flights_sql_text")
    as_of = dt.date(2001, 8, 1)
    for key in ["top_10_hubs", "regional_capacity", "underserved_routes", "capacity_trends", "distance_analysis",
                "hub_concentration", "capacity_trend_series", "month_over_month"]:
        sql_df = spark.sql(Q.get_query_sql(key, "flights_sql_text", as_of))
        api_df = Q.run(key, f, as_of)
        sql_df = sql_df.select(*[sql_df[c].cast(api_df.schema[c].dataType).alias(c) for c in api_df.columns])
        assert sql_df.collect() == api_df.collect(), key  # same rows in the same order
        assert G.compare(api_df, sql_df).collect()[0]["equal"], key
    regions = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
    matrix = Q.regional_flow_matrix(f, as_of, regions=regions)
    text = spark.sql(Q.get_query_sql("regional_flow_matrix", "flights_sql_text", as_of, regions=regions))
    assert text.columns == matrix.columns and text.collect() == matrix.collect()
    with pytest.raises(KeyError):
        Q.get_query_sql("nope", "t")


def test_underserved_compares_rounded_average(spark):
    base = dict(flight_date=dt.date(2024, 2, 1))
    # 19,999 x 150 + 1 x 149: mean 149.99995 -> 150.0000 after rounding: not kept
    rows = [dict(base, origin_airport="T", seats=150) for _ in range(19999)] + [dict(base, origin_airport="T", seats=149)]
    # 19,998 x 150 + 2 x 149: mean 149.9999: kept
    rows += [dict(base, origin_airport="K", seats=150) for _ in range(19998)]
    rows += [dict(base, origin_airport="K", seats=149) for _ in range(2)]
    out = {r["origin_airport"]: r["avg_seats"] for r in Q.underserved_routes(fact(spark, rows), AS_OF).collect()}
    assert out == {"K": 149.9999}


def test_flow_matrix_discovers_regions(spark):
    rows = [dict(origin_region="X", destination_region="Y", seats=7), dict(origin_region="Y", destination_region="Z", seats=3)]
    out = Q.regional_flow_matrix(fact(spark, rows), AS_OF)
    assert out.columns == ["origin_region", "Y", "Z"]
    got = {r["origin_region"]: (r["Y"], r["Z"]) for r in out.collect()}
    assert got == {"X": (7, 0), "Y": (0, 3)}
    fixed = Q.regional_flow_matrix(fact(spark, rows), AS_OF, regions=["Y", "Z", "W"])
    assert fixed.columns == ["origin_region", "Y", "Z", "W"]


def test_trailing_window_ignores_date_parts(spark, workdir):
    """A row's own year and month may be null or wrong: only its date counts, before and after a round trip."""
    from wingspan.plans.fixture import read_fact
    from wingspan.operators import filters as B
    from wingspan.sources import sinks

    rows = [dict(flight_date=dt.date(2024, 3, 1), flight_year=None, flight_month=None),
            dict(flight_date=dt.date(2024, 3, 1), flight_year=1999, flight_month=1),
            dict(flight_date=dt.date(2020, 3, 1), flight_year=2024, flight_month=3), dict(flight_date=None)]
    f = fact(spark, rows)
    sinks.write_fact_parquet(f, workdir + "/f")
    for frame in (f, read_fact(spark, workdir + "/f")):
        kept = B.trailing_months(frame, 12, AS_OF).select("flight_year").collect()
        assert sorted(kept, key=str) == [(1999,), (None,)]


def test_underserved_groups_are_not_capped(spark):
    rows = [dict(origin_airport=f"A{i}", flight_date=dt.date(2024, 2, 1)) for i in range(120)]
    groups = Q.underserved_groups(fact(spark, rows), AS_OF)
    assert groups.count() == 120
    assert "TakeOrdered" not in groups._jdf.queryExecution().executedPlan().toString()
