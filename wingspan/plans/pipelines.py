"""Pipelines: enrichment (P1), calendar expansion (P2), the full run
and the arrivals-from-sample insert (P5).

One lazy plan from three scans to a partitioned write; nothing is collected
except the duplicate-key check's single offending row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wingspan import schemas as S
from wingspan.functions import exprs as X
from wingspan.operators import enrich as C
from wingspan.operators import filters as B
from wingspan.operators import ordering as O
from wingspan.session import FREED, scratch_path, settings
from wingspan.sources import raw, sinks

DATE_COLUMNS = ["flight_date", "flight_year", "flight_month", "flight_quarter"]
ENRICHED_COLUMNS = [c for c in S.FACT_COLUMNS if c not in DATE_COLUMNS]


def route_seed():
    """Integer route key from the raw ids (drives the seat estimate)."""
    ids = [F.coalesce(F.col(c).cast("bigint"), F.lit(0)) for c in
           ("airline_id", "origin_airport_id", "destination_airport_id")]
    return ids[0] * 31 + ids[1] * 17 + ids[2] * 13


def number_seed():
    """A second mix of the raw ids (drives the flight number)."""
    ids = [F.coalesce(F.col(c).cast("bigint"), F.lit(0)) for c in
           ("airline_id", "origin_airport_id", "destination_airport_id")]
    return ids[1] * 131 + ids[2] * 7 + ids[0]


# P1 ---------------------------------------------------------------------------------
def enrich_routes(
    routes: DataFrame,
    airports: DataFrame,
    airlines: DataFrame,
    region_lookup: DataFrame | None = None,
    check_unique: bool = True,
) -> DataFrame:
    """Routes joined to both airports (inner), the airline (left, default
    ``Unknown``) and regions; distance, seats, flight number and the route
    attributes computed as column expressions.

    ``airports`` and ``airlines`` are the filtered frames (A1, A2)."""
    spark = routes.sparkSession
    if check_unique:
        C.assert_unique(airports, "iata_code", "airports")
    lookup = region_lookup if region_lookup is not None else C.region_lookup_frame(spark)
    firsts = C.dedupe_airlines(airlines)
    j = C.join_destination(C.join_origin(routes, airports), airports)
    j = C.join_airline(j, firsts)
    j = C.with_region(j, "o_country", "origin_region", lookup)
    j = C.with_region(j, "d_country", "destination_region", lookup)
    distance = X.haversine_km("o_latitude", "o_longitude", "d_latitude", "d_longitude")
    cols = {
        "airline_code": F.col("airline_code"),
        "airline_name": F.col("airline_name"),
        "flight_number": X.flight_number("airline_code", number_seed()),
        "origin_airport": F.col("origin_airport"),
        "origin_city": F.col("o_city"),
        "origin_country": F.col("o_country"),
        "origin_region": F.col("origin_region"),
        "origin_latitude": F.col("o_latitude").cast("decimal(10,6)"),
        "origin_longitude": F.col("o_longitude").cast("decimal(10,6)"),
        "destination_airport": F.col("destination_airport"),
        "destination_city": F.col("d_city"),
        "destination_country": F.col("d_country"),
        "destination_region": F.col("destination_region"),
        "destination_latitude": F.col("d_latitude").cast("decimal(10,6)"),
        "destination_longitude": F.col("d_longitude").cast("decimal(10,6)"),
        "distance_km": distance.cast("decimal(10,2)"),
        "seats": X.seat_estimate(distance, route_seed()),
        "aircraft_type": X.first_token("equipment"),
        "codeshare": X.flag_to_int("codeshare") == 1,
        "stops": X.int_or_default("stops"),
    }
    return j.select(*[cols[c].alias(c) for c in ENRICHED_COLUMNS])


# P2 ---------------------------------------------------------------------------------
def expand_calendar(enriched: DataFrame, as_of=None, months: int = S.HISTORY_MONTHS) -> DataFrame:
    end = X.as_date(as_of)
    start = X.add_months(end, -months)
    return C.expand_calendar(enriched, start, end).select(*S.FACT_COLUMNS)


# P3 ---------------------------------------------------------------------------------
def run(
    spark: SparkSession,
    airports_path: str,
    airlines_path: str,
    routes_path: str,
    out_path: str,
    as_of=None,
    mode: str = "errorifexists",
) -> DataFrame:
    """Raw files -> enriched fact -> partitioned Parquet at ``out_path``.

    The enriched routes are staged, then each task writes its rows for every date of the calendar, which is the same for
    all routes, into that date's month: the expanded rows, 25 times as many, are neither shuffled nor sorted. Where Arrow
    can't write, every date is a pass of its own over the staged rows. These stand in order of their codes, which
    Parquet packs well. For a full refresh that readers may be using, publish with
    ``sinks.publish_version`` instead of ``mode="overwrite"``."""
    enriched = enrich_routes(
        raw.read_routes(spark, routes_path),
        raw.read_airports(spark, airports_path),
        raw.read_airlines(spark, airlines_path),
    )
    staged = scratch_path(spark, "enriched")
    with settings(spark, FREED):
        enriched.sortWithinPartitions("origin_airport", "destination_airport", "airline_code").write.parquet(staged)
    rows = spark.read.schema(enriched.schema).parquet(staged)
    if sinks.writes_calendar(spark, out_path):
        one = spark.createDataFrame([(None,) * len(rows.columns)], rows.schema)
        sinks.write_fact_calendar(rows, expand_calendar(one, as_of).select(*DATE_COLUMNS), out_path)
    else:
        by_date = [expand_calendar(rows, day, months=0) for day in X.month_starts(X.as_date(as_of), S.HISTORY_MONTHS)]
        sinks.write_fact_by_date(reduce(DataFrame.unionByName, by_date), out_path, mode=mode)
    sinks.remove(spark, staged)
    return spark.read.schema(S.FACT).parquet(out_path)


# P5 ---------------------------------------------------------------------------------
def arrivals_from_sample(fact: DataFrame, n: int = 100, as_of=None, seed: int = 17) -> DataFrame:
    """``n`` random existing flights re-dated to ``as_of`` (new arrivals)."""
    return B.override_dates(O.sample_n(fact, n, seed), as_of)
