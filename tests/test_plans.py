"""Physical-plan properties: pruning, pushdown, broadcast, no Python in the hot path."""

import datetime as dt

import pytest

from conftest import SF_SMALL
from wingspan.plans import catalog as Q
from wingspan.plans.fixture import flights, flights_frame


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def fact(spark):
    return flights(spark, SF_SMALL)


def test_scan_prunes_months_and_columns(fact):
    p = plan(Q.top_10_hubs(fact, dt.date(2001, 8, 1)))
    assert "PartitionFilters: [" in p and "part_year" in p.split("PartitionFilters: [")[1].split("]")[0]
    assert "GreaterThanOrEqual(flight_date,2000-08-01)" in p
    read = p.split("ReadSchema: ")[1].split("\n")[0]
    assert "airline_name" not in read and "aircraft_type" not in read
    assert "TakeOrderedAndProject" in p


def test_no_python_in_named_queries(fact):
    for key in Q.list_queries():
        params = {"regions": ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]} if key == "regional_flow_matrix" else {}
        p = plan(Q.run(key, fact, dt.date(2001, 8, 1), **params))
        assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p and "FlatMapGroupsInPandas" not in p, key


def test_dimensions_are_broadcast(spark):
    p = plan(flights_frame(spark, SF_SMALL))
    assert "BroadcastHashJoin" in p
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_building_joins_starts_no_job(spark):
    from wingspan.operators import enrich as C
    from wingspan.plans import raw_fixture as R

    airports, airlines, routes = R.raw_frames(spark, SF_SMALL)  # reading Parquet schemas takes a job each
    sc = spark.sparkContext
    sc.setJobGroup("no-jobs", "plans only")
    try:
        joined = C.join_airline(C.join_destination(C.join_origin(routes, airports), airports), C.dedupe_airlines(airlines))
        C.with_region(joined, "o_country", "origin_region", C.region_lookup_frame(spark))
        C.unmatched_routes(routes, airports)
        assert len(sc.statusTracker().getJobIdsForGroup("no-jobs")) == 0
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)


def test_no_single_task_over_an_aggregate(fact):
    for key in Q.list_queries():
        params = {"regions": ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]} if key == "regional_flow_matrix" else {}
        assert "Coalesce 1" not in plan(Q.run(key, fact, dt.date(2001, 8, 1), **params)), key


def test_hub_concentration_scans_once(spark, fact):
    df = Q.hub_concentration(fact, dt.date(2001, 8, 1))
    df.collect()
    final = plan(df).split("== Initial Plan ==")[0]
    assert final.count("FileScan") == 1 and "ReusedExchange" in final


def test_partial_aggregation(fact):
    p = plan(Q.regional_capacity(fact, dt.date(2001, 8, 1)))
    assert p.count("HashAggregate") >= 2  # partial (map-side) + final


def test_fact_build_plan_at_scale(spark):
    """With lookups too large to broadcast (as at 100 TB), the large joins
    shuffle (sort-merge) and only the bounded geography is broadcast."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    aqe = spark.conf.get("spark.sql.adaptive.enabled")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        p = plan(flights_frame(spark, SF_SMALL))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.conf.set("spark.sql.adaptive.enabled", aqe)
    assert p.count("SortMergeJoin") == 4  # lineitem-orders, orders-customer, supplier, part
    broadcasts = [ln for ln in p.split("\n") if "BroadcastExchange" in ln and "ReusedExchange" not in ln]
    assert 1 <= len(broadcasts) <= 2 and "ReusedExchange" in p  # geography (+ region), reused for both sides
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p
