"""Raw-shaped airports / airlines / routes derived from the provided tables.

The provided data has no airline files, so the enrichment path is exercised
on frames derived by Spark from tables that grow with the scale factor:

* airports <- supplier x nation: negative balance -> no code, balance over
  9000 -> a station (both filtered out by A1);
* airlines <- customer: one code per nation, so codes repeat (keep-first);
  nation 24 gets the code ``NA``, which the reader's token list turns null;
  negative balance -> inactive; balance over 9900 -> null name;
* routes <- lineitem: airline by line number (some codes unknown), origin =
  the supplier's airport, destination = the airport numbered by quantity;
  null / blank / multi-code equipment, null codeshare and stops.

``SQL_*`` hold the same derivations for the DuckDB oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wingspan import schemas as S
from wingspan.plans.fixture import table

# Fixed test values: a two-letter country code per nation key 0..24.
COUNTRY_CODES = ["US", "CA", "BR", "AR", "GB", "FR", "DE", "IT", "CN", "JP", "IN", "KR", "AE",
                 "SA", "ZA", "EG", "NG", "AU", "NZ", "RU", "MX", "XX", "ES", "TH", "QQ"]


def airports_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    n = F.broadcast(table(spark, sf_dir, "nation"))  # 25 rows by definition
    nk, bal, key = F.col("n_nationkey"), F.col("s_acctbal"), F.col("s_suppkey")
    codes = F.array(*[F.lit(c) for c in COUNTRY_CODES])
    return s.join(n, F.col("s_nationkey") == nk).select(
        key.cast("int").alias("airport_id"),
        F.col("s_name").alias("name"),
        F.col("n_name").alias("city"),
        F.element_at(codes, nk + 1).alias("country"),
        F.when(bal < 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit("A"), key.cast("string"))).alias("iata_code"),
        F.concat(F.lit("K"), key.cast("string")).alias("icao_code"),
        ((nk * 3.0 - 36) + bal / 10000.0).alias("latitude"),
        ((nk * 5.0 - 60) - bal / 20000.0).alias("longitude"),
        (nk * 100).cast("int").alias("altitude"),
        F.col("n_regionkey").cast("decimal(4,2)").alias("timezone"),
        F.lit("U").alias("dst"),
        F.lit(None).cast("string").alias("tz_database"),
        F.when(bal > 9000, "station").otherwise("airport").alias("type"),
        F.lit("OurAirports").alias("source"),
    )


def airlines_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    bal, nk = F.col("c_acctbal"), F.col("c_nationkey")
    return c.select(
        F.col("c_custkey").cast("int").alias("airline_id"),
        F.when(bal > 9900, F.lit(None).cast("string")).otherwise(F.col("c_name")).alias("name"),
        F.lit(None).cast("string").alias("alias"),
        F.when(nk == 24, "NA").otherwise(F.concat(F.lit("L"), nk.cast("string"))).alias("iata_code"),
        F.lit(None).cast("string").alias("icao_code"),
        F.col("c_mktsegment").alias("callsign"),
        F.col("c_mktsegment").alias("country"),
        F.when(bal >= 0, "Y").otherwise("N").alias("active"),
    )


def routes_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    ln, q = F.col("l_linenumber"), F.col("l_quantity")
    return li.select(
        F.concat(F.lit("L"), (ln * 4).cast("string")).alias("airline_code"),
        ln.cast("int").alias("airline_id"),
        F.concat(F.lit("A"), F.col("l_suppkey").cast("string")).alias("origin_airport"),
        F.col("l_suppkey").cast("int").alias("origin_airport_id"),
        F.concat(F.lit("A"), q.cast("bigint").cast("string")).alias("destination_airport"),
        q.cast("int").alias("destination_airport_id"),
        F.when(F.col("l_returnflag") == "R", "Y")
        .when(F.col("l_returnflag") == "A", F.lit(None).cast("string"))
        .otherwise("N").alias("codeshare"),
        F.when(F.col("l_linestatus") == "O", F.lit(None).cast("int")).otherwise(ln - 1).cast("int").alias("stops"),
        F.when(ln == 1, F.lit(None).cast("string"))
        .when(ln == 2, "738")
        .when(ln == 3, "")
        .otherwise(F.concat(F.lit("3"), ln.cast("string"), F.lit("0 738"))).alias("equipment"),
    )


def raw_frames(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return airports_raw(spark, sf_dir), airlines_raw(spark, sf_dir), routes_raw(spark, sf_dir)


def _country_sql() -> str:
    arr = ", ".join(f"'{c}'" for c in COUNTRY_CODES)
    return f"[{arr}][n.n_nationkey + 1]"


def _tokens_sql(col: str) -> str:
    toks = ", ".join("'" + t.replace("'", "''") + "'" for t in S.PANDAS_NULL_TOKENS)
    return f"CASE WHEN {col} IN ({toks}) THEN NULL ELSE {col} END"


SQL_AIRPORTS = f"""airports_raw AS (
  SELECT CAST(s.s_suppkey AS INTEGER) AS airport_id, s.s_name AS name, n.n_name AS city,
         {_country_sql()} AS country,
         CASE WHEN s.s_acctbal < 0 THEN NULL ELSE 'A' || CAST(s.s_suppkey AS VARCHAR) END AS iata_code,
         'K' || CAST(s.s_suppkey AS VARCHAR) AS icao_code,
         CAST(n.n_nationkey * 3.0 - 36 AS DOUBLE) + s.s_acctbal / 10000.0 AS latitude,
         CAST(n.n_nationkey * 5.0 - 60 AS DOUBLE) - s.s_acctbal / 20000.0 AS longitude,
         CAST(n.n_nationkey * 100 AS INTEGER) AS altitude,
         CAST(n.n_regionkey AS DECIMAL(4,2)) AS timezone, 'U' AS dst, CAST(NULL AS VARCHAR) AS tz_database,
         CASE WHEN s.s_acctbal > 9000 THEN 'station' ELSE 'airport' END AS type,
         'OurAirports' AS source
  FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey
)"""

SQL_AIRLINES_RAW = """airlines_raw AS (
  SELECT CAST(c_custkey AS INTEGER) AS airline_id,
         CASE WHEN c_acctbal > 9900 THEN NULL ELSE c_name END AS name,
         CAST(NULL AS VARCHAR) AS alias,
         CASE WHEN c_nationkey = 24 THEN 'NA' ELSE 'L' || CAST(c_nationkey AS VARCHAR) END AS iata_code,
         CAST(NULL AS VARCHAR) AS icao_code, c_mktsegment AS callsign, c_mktsegment AS country,
         CASE WHEN c_acctbal >= 0 THEN 'Y' ELSE 'N' END AS active
  FROM customer
)"""

SQL_ROUTES_RAW = """routes_raw AS (
  SELECT 'L' || CAST(l_linenumber * 4 AS VARCHAR) AS airline_code,
         CAST(l_linenumber AS INTEGER) AS airline_id,
         'A' || CAST(l_suppkey AS VARCHAR) AS origin_airport,
         CAST(l_suppkey AS INTEGER) AS origin_airport_id,
         'A' || CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS destination_airport,
         CAST(l_quantity AS INTEGER) AS destination_airport_id,
         CASE WHEN l_returnflag = 'R' THEN 'Y' WHEN l_returnflag = 'A' THEN NULL ELSE 'N' END AS codeshare,
         CASE WHEN l_linestatus = 'O' THEN NULL ELSE CAST(l_linenumber - 1 AS INTEGER) END AS stops,
         CASE WHEN l_linenumber = 1 THEN NULL WHEN l_linenumber = 2 THEN '738' WHEN l_linenumber = 3 THEN ''
              ELSE '3' || CAST(l_linenumber AS VARCHAR) || '0 738' END AS equipment
  FROM lineitem
)"""

# After a trip through the raw file format the reader nulls the NA tokens.
SQL_AIRLINES_READ = f"""airlines_read AS (
  SELECT airline_id, {_tokens_sql('name')} AS name, alias, {_tokens_sql('iata_code')} AS iata_code,
         icao_code, callsign, country, active FROM airlines_raw
)"""

SQL_ROUTES_READ = f"""routes_read AS (
  SELECT airline_code, airline_id, origin_airport, origin_airport_id, destination_airport,
         destination_airport_id, codeshare, stops, {_tokens_sql('equipment')} AS equipment FROM routes_raw
)"""

SQL_AIRPORTS_OK = """airports_ok AS (
  SELECT * FROM airports_raw WHERE iata_code IS NOT NULL AND type = 'airport'
)"""


def sql_airlines_first(source: str) -> str:
    return f"""airlines_first AS (
  SELECT airline_id, name, iata_code FROM (
    SELECT *, ROW_NUMBER() OVER (PARTITION BY iata_code ORDER BY airline_id) AS rn
    FROM {source} WHERE active = 'Y') t WHERE rn = 1
)"""


def sql_region_lookup() -> str:
    seen: dict[str, str] = {}
    for region, countries in S.REGION_MAPPING.items():
        for c in countries:
            seen.setdefault(c, region)
    values = ", ".join(f"('{c}', '{r}')" for c, r in seen.items())
    return f"region_lookup AS (SELECT * FROM (VALUES {values}) t(country, region))"
