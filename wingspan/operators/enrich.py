"""Enrichment joins (C1-C6) and the airline dedupe.

Airport and airline lookups carry no hint: Spark broadcasts them when their
real size is under its threshold, else it shuffles and AQE splits skewed keys.
The region list is a constant and is hinted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wingspan import schemas as S
from wingspan.functions import exprs as X
from wingspan.operators.joins import lookup_left_with_default
from wingspan.operators.windows import keep_first

AIRPORT_ATTRS = ["iata_code", "city", "country", "latitude", "longitude"]


class DuplicateKeyError(ValueError):
    pass


def assert_unique(df: DataFrame, key: str, what: str) -> None:
    """Fail on a duplicated lookup key instead of fanning out rows."""
    dup = df.filter(F.col(key).isNotNull()).groupBy(key).count().filter("count > 1").limit(1).collect()
    if dup:
        raise DuplicateKeyError(f"{what}: key {key}={dup[0][0]!r} appears {dup[0][1]} times")


# E1 ---------------------------------------------------------------------------------
def dedupe_airlines(airlines: DataFrame, ordinal: str | None = None) -> DataFrame:
    """First airline per IATA code among the given rows: by file position when
    the frame carries ``file_order`` (see ``sources.raw.with_file_order``),
    else by ``airline_id``, or by the ``ordinal`` column given."""
    if ordinal is None:
        ordinal = "file_order" if "file_order" in airlines.columns else "airline_id"
    return keep_first(airlines, "iata_code", [ordinal])


# C5 ---------------------------------------------------------------------------------
def region_lookup_frame(spark: SparkSession, mapping: dict[str, list[str]] | None = None) -> DataFrame:
    """(country, region), first region per country."""
    seen: dict[str, str] = {}
    for region, countries in (mapping or S.REGION_MAPPING).items():
        for c in countries:
            seen.setdefault(c, region)
    return spark.createDataFrame(list(seen.items()), "country string, region string")


def with_region(df: DataFrame, country_col: str, out_col: str, lookup: DataFrame) -> DataFrame:
    lk = F.broadcast(lookup.select(F.col("country").alias("__ck"), F.col("region").alias("__rg")))
    return (
        df.join(lk, F.col(country_col) == F.col("__ck"), "left")
        .withColumn(out_col, F.coalesce(F.col("__rg"), F.lit(S.OTHER_REGION)))
        .drop("__ck", "__rg")
    )


def _airport_side(airports: DataFrame, prefix: str) -> DataFrame:
    return airports.select(*[F.col(c).alias(f"{prefix}_{c}") for c in AIRPORT_ATTRS])


# C1 ---------------------------------------------------------------------------------
def join_origin(routes: DataFrame, airports: DataFrame) -> DataFrame:
    side = _airport_side(airports, "o")
    return routes.join(side, F.col("origin_airport") == F.col("o_iata_code"), "inner")


# C2 ---------------------------------------------------------------------------------
def join_destination(routes: DataFrame, airports: DataFrame) -> DataFrame:
    side = _airport_side(airports, "d")
    return routes.join(side, F.col("destination_airport") == F.col("d_iata_code"), "inner")


# C3 ---------------------------------------------------------------------------------
def join_airline(routes: DataFrame, airlines: DataFrame) -> DataFrame:
    side = airlines.select("iata_code", "name")
    return lookup_left_with_default(routes, side, "airline_code", "iata_code", "name", "airline_name", "Unknown")


# C4 ---------------------------------------------------------------------------------
def unmatched_routes(routes: DataFrame, airports: DataFrame) -> DataFrame:
    """Routes dropped by C1 or C2, one per route, in one pass: both codes are
    looked up with a hit flag and routes that miss either stay."""
    codes = airports.select("iata_code").filter(F.col("iata_code").isNotNull()).distinct()
    out = routes
    for i, side in enumerate(("origin_airport", "destination_airport")):
        hits = codes.select(F.col("iata_code").alias(f"__c{i}"), F.lit(True).alias(f"__h{i}"))
        out = out.join(hits, F.col(side) == F.col(f"__c{i}"), "left")
    return out.filter("__h0 IS NULL OR __h1 IS NULL").drop("__c0", "__c1", "__h0", "__h1")


# C6 ---------------------------------------------------------------------------------
def expand_calendar(routes: DataFrame, start, end) -> DataFrame:
    """Every route once per generated month date (``start`` itself, then each
    following 1st up to ``end``). A generator on each row, not a join."""
    return (
        routes.withColumn("flight_date", F.explode(X.month_start_series(F.lit(start), F.lit(end))))
        .withColumn("flight_year", F.year("flight_date"))
        .withColumn("flight_month", F.month("flight_date"))
        .withColumn("flight_quarter", X.quarter_of_month(F.col("flight_month")))
    )
