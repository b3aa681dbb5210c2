"""DuckDB SQL twins of the registered queries (the correctness gate).

Each text runs on the provided tables (registered as views) and must give
the same rows, column names and plain types as ``checks.REGISTRY[name]``.
The fact is rebuilt inline as a CTE from the same tables.
"""

from __future__ import annotations

AS_OF = "DATE '2001-08-01'"


def cutoff(months: int) -> str:
    return f"CAST({AS_OF} - INTERVAL {months} MONTH AS DATE)"


def _hav(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    la1, lo1, la2, lo2 = (f"CAST({x} AS DOUBLE)" for x in (lat1, lon1, lat2, lon2))
    return (
        f"round(6371.0 * 2 * asin(sqrt(least(1.0, pow(sin((radians({la2}) - radians({la1})) / 2), 2)"
        f" + cos(radians({la1})) * cos(radians({la2})) * pow(sin((radians({lo2}) - radians({lo1})) / 2), 2)))), 2)"
    )


GEO = """geo AS (
  SELECT n.n_nationkey AS nk, n.n_name AS name, r.r_name AS region,
         CAST(n.n_nationkey * 3.0 - 36 AS DECIMAL(10,6)) AS lat,
         CAST(n.n_nationkey * 5.0 - 60 AS DECIMAL(10,6)) AS lon
  FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey
)"""

FLIGHTS = f"""flights AS (
  SELECT
    'S' || lpad(CAST(l.l_suppkey AS VARCHAR), 6, '0') AS airline_code,
    s.s_name AS airline_name,
    'S' || CAST(l.l_suppkey AS VARCHAR) || '-' || CAST(l.l_partkey AS VARCHAR) AS flight_number,
    'A' || lpad(CAST(l.l_suppkey AS VARCHAR), 6, '0') AS origin_airport,
    og.name AS origin_city, og.name AS origin_country, og.region AS origin_region,
    og.lat AS origin_latitude, og.lon AS origin_longitude,
    'C' || lpad(CAST(c.c_custkey AS VARCHAR), 6, '0') AS destination_airport,
    dg.name AS destination_city, dg.name AS destination_country, dg.region AS destination_region,
    dg.lat AS destination_latitude, dg.lon AS destination_longitude,
    CAST({_hav('og.lat', 'og.lon', 'dg.lat', 'dg.lon')} AS DECIMAL(10,2)) AS distance_km,
    CAST(l.l_quantity * 10 AS INTEGER) AS seats,
    p.p_type AS aircraft_type,
    l.l_returnflag = 'R' AS codeshare,
    l.l_linenumber - 1 AS stops,
    CAST(l.l_shipdate AS DATE) AS flight_date,
    CAST(year(l.l_shipdate) AS INTEGER) AS flight_year,
    CAST(month(l.l_shipdate) AS INTEGER) AS flight_month,
    CAST(quarter(l.l_shipdate) AS INTEGER) AS flight_quarter
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN supplier s ON l.l_suppkey = s.s_suppkey
  JOIN part p ON l.l_partkey = p.p_partkey
  JOIN geo og ON s.s_nationkey = og.nk
  JOIN geo dg ON c.c_nationkey = dg.nk
)"""

WITH_FLIGHTS = f"WITH {GEO},\n{FLIGHTS}"


def mean(col: str) -> str:
    """Average to 4 decimals for ints, 6 for distance_km: whole quotient, plus one where the remainder is half or more."""
    in_scale, out_scale = (2, 6) if col == "distance_km" else (0, 4)
    total = f"CAST(SUM({col}) * {10 ** in_scale} AS HUGEINT) * {10 ** (out_scale - in_scale)}"
    n = f"COUNT({col})"
    return (f"CAST(CASE WHEN SUM({col}) < 0 THEN -1 ELSE 1 END * (abs({total}) // {n}"
            f" + CASE WHEN abs({total}) % {n} >= {n} - abs({total}) % {n} THEN 1 ELSE 0 END) AS DOUBLE)"
            f" / {float(10 ** out_scale)}")


SQL: dict[str, str] = {}

# Q1 ------------------------------------------------------------------------------
SQL["top_10_hubs"] = f"""{WITH_FLIGHTS}
SELECT origin_airport, origin_city, origin_country,
       CAST(COUNT(DISTINCT flight_number) AS BIGINT) AS num_routes,
       CAST(SUM(seats) AS BIGINT) AS total_seats,
       {mean('seats')} AS avg_seats_per_flight
FROM flights
WHERE flight_date >= {cutoff(12)}
GROUP BY origin_airport, origin_city, origin_country
ORDER BY total_seats DESC, origin_airport, origin_city, origin_country
LIMIT 10"""

# Q2 ------------------------------------------------------------------------------
Q2_BODY = f"""SELECT origin_region, destination_region,
       CAST(COUNT(*) AS BIGINT) AS route_count,
       CAST(SUM(seats) AS BIGINT) AS total_capacity,
       {mean('distance_km')} AS avg_distance,
       CAST(SUM(seats * distance_km) AS DOUBLE) AS capacity_kilometers
FROM flights
WHERE flight_date >= {cutoff(6)}
GROUP BY origin_region, destination_region"""

SQL["regional_capacity"] = f"""{WITH_FLIGHTS}
{Q2_BODY}
ORDER BY total_capacity DESC, origin_region, destination_region"""

# Q3 ------------------------------------------------------------------------------
SQL["underserved_routes"] = f"""{WITH_FLIGHTS}
SELECT origin_airport, destination_airport, CAST(distance_km AS DOUBLE) AS distance_km,
       CAST(COUNT(*) AS BIGINT) AS flights_per_month,
       {mean('seats')} AS avg_seats,
       CAST(SUM(seats) AS BIGINT) AS monthly_capacity
FROM flights
WHERE flight_date >= {cutoff(3)}
GROUP BY origin_airport, destination_airport, flights.distance_km
HAVING COUNT(*) < 5 OR {mean('seats')} < 150
ORDER BY flights.distance_km DESC, origin_airport, destination_airport
LIMIT 50"""

# Q4 ------------------------------------------------------------------------------
Q4_BODY = f"""SELECT CAST(flight_year AS BIGINT) AS flight_year, CAST(flight_month AS BIGINT) AS flight_month,
       origin_region,
       CAST(COUNT(DISTINCT airline_code) AS BIGINT) AS num_airlines,
       CAST(COUNT(*) AS BIGINT) AS num_flights,
       CAST(SUM(seats) AS BIGINT) AS total_seats,
       {mean('distance_km')} AS avg_distance
FROM flights
WHERE flight_date >= {cutoff(24)}
GROUP BY flights.flight_year, flights.flight_month, origin_region"""

SQL["capacity_trends"] = f"""{WITH_FLIGHTS}
{Q4_BODY}
ORDER BY flight_year NULLS FIRST, flight_month NULLS FIRST, origin_region NULLS FIRST"""

# Q5 ------------------------------------------------------------------------------
BAND = """CASE WHEN distance_km < 500 THEN 'Short-haul (<500km)'
            WHEN distance_km < 1500 THEN 'Medium-haul (500-1500km)'
            WHEN distance_km < 4000 THEN 'Long-haul (1500-4000km)'
            ELSE 'Ultra-long-haul (>4000km)' END"""

SQL["distance_analysis"] = f"""{WITH_FLIGHTS}
SELECT {BAND} AS distance_category,
       CAST(COUNT(*) AS BIGINT) AS num_routes,
       {mean('seats')} AS avg_seats,
       CAST(SUM(seats) AS BIGINT) AS total_seats,
       {mean('distance_km')} AS avg_distance
FROM flights
WHERE flight_date >= {cutoff(12)}
GROUP BY 1"""

# Q6 ------------------------------------------------------------------------------
SQL["hub_concentration"] = f"""{WITH_FLIGHTS},
hubs AS (
  SELECT origin_airport, CAST(SUM(seats) AS BIGINT) AS hub_seats
  FROM flights WHERE flight_date >= {cutoff(12)} GROUP BY origin_airport
),
ranked AS (
  SELECT origin_airport, hub_seats,
         round(100.0 * CAST(SUM(hub_seats) OVER (ORDER BY hub_seats DESC, origin_airport
                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE)
               / CAST(SUM(hub_seats) OVER () AS DOUBLE), 2) AS cumulative_pct,
         CAST(ROW_NUMBER() OVER (ORDER BY hub_seats DESC, origin_airport) AS BIGINT) AS hub_rank
  FROM hubs
)
SELECT * FROM ranked WHERE hub_rank <= 10"""

# Q7 ------------------------------------------------------------------------------
_REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
_PIVOT = ",\n       ".join(
    f"CAST(COALESCE(SUM(CASE WHEN destination_region = '{r}' THEN total_capacity END), 0) AS BIGINT) AS \"{r}\""
    for r in _REGIONS
)
SQL["regional_flow_matrix"] = f"""{WITH_FLIGHTS},
q2 AS ({Q2_BODY})
SELECT origin_region,
       {_PIVOT}
FROM q2 GROUP BY origin_region"""

# Q8 ------------------------------------------------------------------------------
SQL["capacity_trend_series"] = f"""{WITH_FLIGHTS},
q4 AS ({Q4_BODY})
SELECT *, strftime(make_date(CAST(flight_year AS INTEGER), CAST(flight_month AS INTEGER), 1), '%Y-%m-%d') AS date
FROM q4"""

# E3 ------------------------------------------------------------------------------
SQL["month_over_month"] = f"""{WITH_FLIGHTS},
q4 AS ({Q4_BODY})
SELECT *,
       LAG(total_seats) OVER (PARTITION BY origin_region ORDER BY flight_year, flight_month) AS prev_total_seats,
       total_seats - LAG(total_seats) OVER (PARTITION BY origin_region ORDER BY flight_year, flight_month) AS seat_change
FROM q4"""


# ---------------------------------------------------------------------------------
# Operator-level twins
# ---------------------------------------------------------------------------------
from wingspan.plans import raw_fixture as _R  # noqa: E402


def d(col: str) -> str:
    return f"strftime({col}, '%Y-%m-%d')"


def ts(col: str) -> str:
    return f"strftime({col}, '%Y-%m-%d %H:%M:%S.%f')"


EVENTS_PLAIN = f"event_id, {ts('ts')} AS ts, user_id, event_type, value, props"
CHANGE_MARK = "TIMESTAMP '2024-01-15 00:00:00'"
CHANGE_AS_OF = "TIMESTAMP '2024-01-20 12:00:00'"
FACT_PLAIN = {
    "origin_latitude": "CAST(origin_latitude AS DOUBLE) AS origin_latitude",
    "origin_longitude": "CAST(origin_longitude AS DOUBLE) AS origin_longitude",
    "destination_latitude": "CAST(destination_latitude AS DOUBLE) AS destination_latitude",
    "destination_longitude": "CAST(destination_longitude AS DOUBLE) AS destination_longitude",
    "distance_km": "CAST(distance_km AS DOUBLE) AS distance_km",
    "seats": "CAST(seats AS BIGINT) AS seats",
    "stops": "CAST(stops AS BIGINT) AS stops",
    "flight_date": f"{d('flight_date')} AS flight_date",
    "flight_year": "CAST(flight_year AS BIGINT) AS flight_year",
    "flight_month": "CAST(flight_month AS BIGINT) AS flight_month",
    "flight_quarter": "CAST(flight_quarter AS BIGINT) AS flight_quarter",
}
_FACT_COLS = ["airline_code", "airline_name", "flight_number", "origin_airport", "origin_city",
              "origin_country", "origin_region", "origin_latitude", "origin_longitude",
              "destination_airport", "destination_city", "destination_country", "destination_region",
              "destination_latitude", "destination_longitude", "distance_km", "seats", "aircraft_type",
              "codeshare", "stops", "flight_date", "flight_year", "flight_month", "flight_quarter"]
FACT_SELECT = ", ".join(FACT_PLAIN.get(c, c) for c in _FACT_COLS)

SQL["trailing_months"] = f"""{WITH_FLIGHTS}
SELECT airline_code, flight_number, origin_airport, destination_airport, {d('flight_date')} AS flight_date,
       CAST(seats AS BIGINT) AS seats
FROM flights WHERE flight_date >= {cutoff(12)}"""

SQL["null_equality_filter"] = f"""WITH {_R.SQL_AIRPORTS}
SELECT CAST(airport_id AS BIGINT) AS airport_id, name, city, country, iata_code, icao_code, latitude, longitude,
       CAST(altitude AS BIGINT) AS altitude, CAST(timezone AS DOUBLE) AS timezone, dst, tz_database, type, source
FROM airports_raw WHERE iata_code IS NOT NULL AND type = 'airport'"""

SQL["flag_filter"] = f"""WITH {_R.SQL_AIRLINES_RAW}
SELECT CAST(airline_id AS BIGINT) AS airline_id, name, alias, iata_code, icao_code, callsign, country, active
FROM airlines_raw WHERE active = 'Y'"""

SQL["having_or"] = f"""{WITH_FLIGHTS}
SELECT origin_airport, destination_airport, CAST(distance_km AS DOUBLE) AS distance_km,
       CAST(COUNT(*) AS BIGINT) AS flights_per_month, {mean('seats')} AS avg_seats,
       CAST(SUM(seats) AS BIGINT) AS monthly_capacity
FROM flights WHERE flight_date >= {cutoff(3)}
GROUP BY origin_airport, destination_airport, flights.distance_km
HAVING COUNT(*) < 5 OR {mean('seats')} < 150"""

SQL["project_alias"] = f"""{WITH_FLIGHTS}
SELECT origin_airport AS hub, origin_city AS hub_city, CAST(seats AS BIGINT) AS capacity,
       CAST(distance_km AS DOUBLE) AS km FROM flights"""

SQL["distance_band"] = f"""{WITH_FLIGHTS}
SELECT flight_number, CAST(distance_km AS DOUBLE) AS distance_km, {BAND} AS distance_category,
       CAST(CASE {BAND} WHEN 'Short-haul (<500km)' THEN 1 WHEN 'Medium-haul (500-1500km)' THEN 2
            WHEN 'Long-haul (1500-4000km)' THEN 3 ELSE 4 END AS BIGINT) AS band_rank
FROM flights"""

SQL["date_parts"] = f"""SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,
       {d('CAST(l_shipdate AS DATE)')} AS ship_date,
       CAST(year(l_shipdate) AS BIGINT) AS ship_year, CAST(month(l_shipdate) AS BIGINT) AS ship_month,
       CAST(quarter(l_shipdate) AS BIGINT) AS ship_quarter,
       CAST((month(l_shipdate) - 1) // 3 + 1 AS BIGINT) AS quarter_from_month
FROM lineitem"""

SQL["override_projection"] = f"""{WITH_FLIGHTS}
SELECT flight_number, origin_airport, destination_airport, CAST(seats AS BIGINT) AS seats,
       '2001-08-01' AS flight_date, CAST(2001 AS BIGINT) AS flight_year, CAST(8 AS BIGINT) AS flight_month,
       CAST(3 AS BIGINT) AS flight_quarter
FROM flights"""

SQL["named_projection"] = f"""{WITH_FLIGHTS}
SELECT {FACT_SELECT} FROM flights"""

SQL["agg_count"] = f"""{WITH_FLIGHTS}
SELECT origin_region, CAST(COUNT(*) AS BIGINT) AS flights FROM flights GROUP BY origin_region"""

SQL["agg_count_distinct"] = f"""{WITH_FLIGHTS}
SELECT origin_region, CAST(COUNT(DISTINCT flight_number) AS BIGINT) AS distinct_flight_numbers,
       CAST(COUNT(DISTINCT airline_code) AS BIGINT) AS distinct_airlines
FROM flights GROUP BY origin_region"""

SQL["agg_sum"] = f"""{WITH_FLIGHTS}
SELECT destination_region, CAST(SUM(seats) AS BIGINT) AS total_seats FROM flights GROUP BY destination_region"""

SQL["agg_avg"] = f"""{WITH_FLIGHTS}
SELECT origin_airport, {mean('seats')} AS avg_seats, {mean('distance_km')} AS avg_distance
FROM flights GROUP BY origin_airport"""

SQL["agg_sum_product"] = f"""{WITH_FLIGHTS}
SELECT origin_airport, destination_region, CAST(SUM(seats * distance_km) AS DOUBLE) AS capacity_kilometers
FROM flights GROUP BY origin_airport, destination_region"""

SQL["agg_min_max"] = f"""{WITH_FLIGHTS}
SELECT CAST(COUNT(*) AS BIGINT) AS flights, {d('MIN(flight_date)')} AS earliest, {d('MAX(flight_date)')} AS latest,
       CAST(MIN(seats) AS BIGINT) AS min_seats, CAST(MAX(seats) AS BIGINT) AS max_seats FROM flights"""

SQL["group_multi"] = f"""{WITH_FLIGHTS}
SELECT origin_region, destination_region, aircraft_type, CAST(COUNT(*) AS BIGINT) AS flights,
       CAST(SUM(seats) AS BIGINT) AS total_seats
FROM flights GROUP BY origin_region, destination_region, aircraft_type"""

SQL["group_alias"] = f"""{WITH_FLIGHTS}
SELECT {BAND} AS distance_category, CAST(COUNT(*) AS BIGINT) AS flights, CAST(SUM(seats) AS BIGINT) AS total_seats
FROM flights GROUP BY distance_category"""

SQL["global_count"] = f"""{WITH_FLIGHTS}
SELECT CAST(COUNT(*) AS BIGINT) AS row_count FROM flights"""

SQL["dedupe_first"] = f"""WITH {_R.SQL_AIRLINES_RAW}
SELECT CAST(airline_id AS BIGINT) AS airline_id, iata_code, name, country, active FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY iata_code ORDER BY airline_id) AS rn
  FROM airlines_raw WHERE active = 'Y') t WHERE rn = 1"""

SQL["latest_per_key"] = f"""SELECT user_id, event_id, {ts('ts')} AS ts, event_type, value, props FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) t
WHERE rn = 1"""

SQL["sort_desc"] = f"""{WITH_FLIGHTS},
q2 AS ({Q2_BODY})
SELECT *, CAST(ROW_NUMBER() OVER (ORDER BY total_capacity DESC, origin_region, destination_region) AS BIGINT)
       AS position FROM q2"""

SQL["sort_multi"] = f"""{WITH_FLIGHTS},
q4 AS ({Q4_BODY})
SELECT *, CAST(ROW_NUMBER() OVER (ORDER BY flight_year, flight_month, origin_region) AS BIGINT) AS position
FROM q4"""

SQL["sort_by_rank"] = f"""{WITH_FLIGHTS},
q5 AS (
  SELECT {BAND} AS distance_category, CAST(COUNT(*) AS BIGINT) AS num_routes, {mean('seats')} AS avg_seats,
         CAST(SUM(seats) AS BIGINT) AS total_seats, {mean('distance_km')} AS avg_distance
  FROM flights WHERE flight_date >= {cutoff(12)} GROUP BY 1)
SELECT *, CAST(ROW_NUMBER() OVER (ORDER BY CASE distance_category WHEN 'Short-haul (<500km)' THEN 1
       WHEN 'Medium-haul (500-1500km)' THEN 2 WHEN 'Long-haul (1500-4000km)' THEN 3 ELSE 4 END) AS BIGINT)
       AS position FROM q5"""

SQL["top_k"] = f"""{WITH_FLIGHTS},
per_airline AS (SELECT airline_code, CAST(SUM(seats) AS BIGINT) AS total_seats FROM flights GROUP BY airline_code)
SELECT *, CAST(ROW_NUMBER() OVER (ORDER BY total_seats DESC, airline_code) AS BIGINT) AS position
FROM per_airline ORDER BY total_seats DESC, airline_code LIMIT 10"""

SQL["recent_n"] = f"""SELECT {EVENTS_PLAIN},
       CAST(ROW_NUMBER() OVER (ORDER BY ts DESC, event_id DESC) AS BIGINT) AS position
FROM events ORDER BY ts DESC, event_id DESC LIMIT 1000"""

SQL["ordered_changes"] = f"""SELECT {EVENTS_PLAIN},
       CAST(ROW_NUMBER() OVER (ORDER BY ts, event_id) AS BIGINT) AS position
FROM events WHERE ts > {CHANGE_MARK}"""

SQL["incremental_since"] = f"""SELECT {EVENTS_PLAIN} FROM events WHERE ts > {CHANGE_MARK}"""

SQL["recent_changes"] = f"""SELECT {EVENTS_PLAIN} FROM events
WHERE ts >= {CHANGE_AS_OF} - INTERVAL 1 MINUTE"""

SQL["change_window_report"] = f"""SELECT CAST(COUNT(*) AS BIGINT) AS new_records, {ts('MIN(ts)')} AS earliest,
       {ts('MAX(ts)')} AS latest
FROM events WHERE ts >= {CHANGE_AS_OF} - INTERVAL 1 MINUTE"""

SQL["append_union"] = f"""{WITH_FLIGHTS},
recent AS (SELECT * FROM flights)
SELECT flight_number, origin_airport, CAST(seats AS BIGINT) AS seats, {d('flight_date')} AS flight_date FROM recent
UNION ALL
SELECT flight_number, origin_airport, CAST(seats AS BIGINT) AS seats, '2001-08-01' AS flight_date FROM recent"""

SQL["reconcile_equal"] = f"""{WITH_FLIGHTS},
q2 AS ({Q2_BODY})
SELECT CAST(COUNT(*) AS BIGINT) AS rows_left, CAST(COUNT(*) AS BIGINT) AS rows_right,
       CAST(0 AS BIGINT) AS only_left, CAST(0 AS BIGINT) AS only_right, CAST(COUNT(*) AS BIGINT) AS matched,
       TRUE AS equal FROM q2"""

SQL["reconcile_diff"] = f"""{WITH_FLIGHTS},
q2 AS ({Q2_BODY})
SELECT CAST(COUNT(*) AS BIGINT) AS rows_left, CAST(COUNT(*) AS BIGINT) AS rows_right,
       CAST(COUNT(*) FILTER (WHERE destination_region = 'ASIA') AS BIGINT) AS only_left,
       CAST(COUNT(*) FILTER (WHERE destination_region = 'ASIA') AS BIGINT) AS only_right,
       CAST(COUNT(*) FILTER (WHERE destination_region <> 'ASIA') AS BIGINT) AS matched,
       COUNT(*) FILTER (WHERE destination_region = 'ASIA') = 0 AS equal FROM q2"""

SQL["sync_check"] = f"""{WITH_FLIGHTS}
SELECT s.n AS source_rows, t.n AS target_rows, s.n - t.n AS difference, s.n = t.n AS in_sync
FROM (SELECT CAST(COUNT(*) AS BIGINT) AS n FROM lineitem) s, (SELECT CAST(COUNT(*) AS BIGINT) AS n FROM flights) t"""

SQL["validate_count"] = f"""{WITH_FLIGHTS}
SELECT s.n AS expected_count, t.n AS actual_count, s.n = t.n AS matches
FROM (SELECT CAST(COUNT(*) AS BIGINT) AS n FROM lineitem) s, (SELECT CAST(COUNT(*) AS BIGINT) AS n FROM flights) t"""

_MATCHED = f"""WITH {_R.SQL_AIRPORTS}, {_R.SQL_ROUTES_RAW}, {_R.SQL_AIRPORTS_OK},
matched AS (
  SELECT r.*, o.city AS o_city, o.country AS o_country, o.latitude AS o_latitude, o.longitude AS o_longitude,
         de.city AS d_city, de.country AS d_country, de.latitude AS d_latitude, de.longitude AS d_longitude,
         {_hav('o.latitude', 'o.longitude', 'de.latitude', 'de.longitude')} AS distance
  FROM routes_raw r JOIN airports_ok o ON r.origin_airport = o.iata_code
  JOIN airports_ok de ON r.destination_airport = de.iata_code
)"""

SQL["haversine_pairs"] = f"""{_MATCHED}
SELECT DISTINCT origin_airport, destination_airport, distance AS distance_km FROM matched"""

SQL["day_range"] = """SELECT o_orderkey, strftime(CAST(dd AS DATE), '%Y-%m-%d') AS day
FROM orders, LATERAL (SELECT unnest(generate_series(CAST(o_orderdate AS DATE),
     CAST(o_orderdate AS DATE) + CAST(substr(o_orderpriority, 1, 1) AS INTEGER) - 1, INTERVAL 1 DAY)) AS dd)"""

SQL["month_range"] = """WITH b AS (
  SELECT o_orderkey, CAST(o_orderdate AS DATE) AS s,
         CAST(CAST(o_orderdate AS DATE) + INTERVAL 3 MONTH AS DATE) AS e,
         CAST(date_trunc('month', CAST(o_orderdate AS DATE) + INTERVAL 1 MONTH) AS DATE) AS f
  FROM orders)
SELECT o_orderkey, strftime(s, '%Y-%m-%d') AS month_date FROM b
UNION ALL
SELECT o_orderkey, strftime(CAST(m AS DATE), '%Y-%m-%d') AS month_date
FROM b, LATERAL (SELECT unnest(generate_series(f, e, INTERVAL 1 MONTH)) AS m) WHERE f <= e"""


def _pmod(x: str, n: int) -> str:
    return f"((({x}) % {n}) + {n}) % {n}"


_SEED = ("(COALESCE(CAST(airline_id AS BIGINT), 0) * 31 + COALESCE(CAST(origin_airport_id AS BIGINT), 0) * 17"
         " + COALESCE(CAST(destination_airport_id AS BIGINT), 0) * 13)")
_NUM_SEED = ("(COALESCE(CAST(origin_airport_id AS BIGINT), 0) * 131"
             " + COALESCE(CAST(destination_airport_id AS BIGINT), 0) * 7 + COALESCE(CAST(airline_id AS BIGINT), 0))")


def _seats(dist: str) -> str:
    return (f"CAST(CASE WHEN {dist} < 500 THEN 100 + {_pmod(_SEED, 81)}"
            f" WHEN {dist} < 1500 THEN 120 + {_pmod(_SEED, 101)}"
            f" WHEN {dist} < 4000 THEN 150 + {_pmod(_SEED, 151)}"
            f" ELSE 250 + {_pmod(_SEED, 301)} END AS BIGINT)")


_FIRST_TOKEN = ("COALESCE(string_split_regex(NULLIF(regexp_replace(equipment, '^\\s+', ''), ''), '\\s+')[1],"
                " 'Unknown')")
_AIRCRAFT = ", ".join(f"('{k}', {v})" for k, v in __import__("wingspan.schemas", fromlist=["x"]).AIRCRAFT_SEAT_MAPPING.items())

SQL["seat_estimate"] = f"""{_MATCHED}
SELECT CAST(airline_id AS BIGINT) AS airline_id, CAST(origin_airport_id AS BIGINT) AS origin_airport_id,
       CAST(destination_airport_id AS BIGINT) AS destination_airport_id, distance, {_seats('distance')} AS seats
FROM matched"""

SQL["seat_estimate_aircraft"] = f"""{_MATCHED},
aircraft AS (SELECT * FROM (VALUES {_AIRCRAFT}) t(code, seats))
SELECT CAST(airline_id AS BIGINT) AS airline_id, CAST(origin_airport_id AS BIGINT) AS origin_airport_id,
       CAST(destination_airport_id AS BIGINT) AS destination_airport_id, {_FIRST_TOKEN} AS aircraft_type,
       CAST(COALESCE(a.seats, {_seats('distance')}) AS BIGINT) AS seats
FROM matched LEFT JOIN aircraft a ON a.code = {_FIRST_TOKEN}"""

SQL["flight_number"] = f"""WITH {_R.SQL_ROUTES_RAW}
SELECT airline_code, CAST(airline_id AS BIGINT) AS airline_id, CAST(origin_airport_id AS BIGINT) AS origin_airport_id,
       CAST(destination_airport_id AS BIGINT) AS destination_airport_id,
       airline_code || CAST(100 + {_pmod(_NUM_SEED, 9900)} AS VARCHAR) AS flight_number
FROM routes_raw"""

SQL["first_token"] = f"""WITH {_R.SQL_ROUTES_RAW}
SELECT airline_code, origin_airport, equipment, {_FIRST_TOKEN} AS aircraft_type FROM routes_raw"""

SQL["flag_to_int"] = f"""WITH {_R.SQL_ROUTES_RAW}
SELECT airline_code, origin_airport, codeshare,
       CAST(CASE WHEN codeshare IS NOT DISTINCT FROM 'Y' THEN 1 ELSE 0 END AS BIGINT) AS codeshare_flag
FROM routes_raw"""

SQL["null_default"] = f"""WITH {_R.SQL_ROUTES_RAW}
SELECT airline_code, origin_airport, CAST(stops AS BIGINT) AS stops, CAST(COALESCE(stops, 0) AS BIGINT) AS stops_or_zero
FROM routes_raw"""

SQL["safe_ratio"] = f"""{WITH_FLIGHTS},
g AS (SELECT origin_airport, stops,
             SUM(CASE WHEN codeshare THEN seats ELSE 0 END) AS codeshare_seats,
             SUM(CASE WHEN NOT codeshare THEN seats ELSE 0 END) AS own_seats
      FROM flights GROUP BY origin_airport, stops)
SELECT origin_airport, CAST(stops AS BIGINT) AS stops, CAST(codeshare_seats AS BIGINT) AS codeshare_seats,
       CAST(own_seats AS BIGINT) AS own_seats,
       CASE WHEN own_seats = 0 THEN CAST('inf' AS DOUBLE) ELSE CAST(codeshare_seats AS DOUBLE) / CAST(own_seats AS DOUBLE) END AS ratio
FROM g"""

SQL["size_mb"] = f"""{WITH_FLIGHTS},
g AS (SELECT flight_year, SUM(length(airline_name) + length(flight_number) + length(origin_airport)
             + length(destination_airport) + length(aircraft_type)) AS text_bytes FROM flights GROUP BY flight_year)
SELECT CAST(flight_year AS BIGINT) AS flight_year, CAST(text_bytes AS BIGINT) AS text_bytes,
       round(CAST(text_bytes AS DOUBLE) / 1048576, 2) AS text_mb FROM g"""

SQL["origin_join"] = f"""WITH {_R.SQL_AIRPORTS}, {_R.SQL_ROUTES_RAW}, {_R.SQL_AIRPORTS_OK}
SELECT r.airline_code, r.origin_airport, r.destination_airport, o.city AS o_city, o.country AS o_country,
       o.latitude AS o_latitude, o.longitude AS o_longitude
FROM routes_raw r JOIN airports_ok o ON r.origin_airport = o.iata_code"""

SQL["destination_join"] = f"""WITH {_R.SQL_AIRPORTS}, {_R.SQL_ROUTES_RAW}, {_R.SQL_AIRPORTS_OK}
SELECT r.airline_code, r.origin_airport, r.destination_airport, o.city AS d_city, o.country AS d_country,
       o.latitude AS d_latitude, o.longitude AS d_longitude
FROM routes_raw r JOIN airports_ok o ON r.destination_airport = o.iata_code"""

SQL["airline_left_default"] = f"""WITH {_R.SQL_AIRLINES_RAW}, {_R.SQL_ROUTES_RAW}, {_R.sql_airlines_first('airlines_raw')}
SELECT r.airline_code, CAST(r.airline_id AS BIGINT) AS airline_id, r.origin_airport, r.destination_airport,
       CASE WHEN a.iata_code IS NOT NULL THEN a.name ELSE 'Unknown' END AS airline_name
FROM routes_raw r LEFT JOIN airlines_first a ON r.airline_code = a.iata_code"""

SQL["unmatched_audit"] = f"""WITH {_R.SQL_AIRPORTS}, {_R.SQL_ROUTES_RAW}, {_R.SQL_AIRPORTS_OK}
SELECT CAST(COUNT(*) AS BIGINT) AS unmatched_routes FROM routes_raw r
WHERE r.origin_airport IS NULL OR r.destination_airport IS NULL
   OR NOT EXISTS (SELECT 1 FROM airports_ok o WHERE o.iata_code = r.origin_airport)
   OR NOT EXISTS (SELECT 1 FROM airports_ok o WHERE o.iata_code = r.destination_airport)"""

SQL["region_lookup"] = f"""WITH {_R.SQL_AIRPORTS}, {_R.sql_region_lookup()}
SELECT CAST(a.airport_id AS BIGINT) AS airport_id, a.country, COALESCE(l.region, 'Other') AS region
FROM airports_raw a LEFT JOIN region_lookup l ON a.country = l.country"""

SQL["calendar_expand"] = f"""WITH {_R.SQL_ROUTES_RAW},
routes AS (SELECT DISTINCT airline_code, origin_airport, destination_airport FROM routes_raw),
dates AS (SELECT CAST(m AS DATE) AS flight_date
          FROM generate_series(TIMESTAMP '1999-08-01', TIMESTAMP '2001-08-01', INTERVAL 1 MONTH) t(m))
SELECT r.*, strftime(flight_date, '%Y-%m-%d') AS flight_date, CAST(year(flight_date) AS BIGINT) AS flight_year,
       CAST(month(flight_date) AS BIGINT) AS flight_month, CAST(quarter(flight_date) AS BIGINT) AS flight_quarter
FROM routes r, dates"""

_ENRICHED = f"""WITH {_R.SQL_AIRPORTS}, {_R.SQL_AIRLINES_RAW}, {_R.SQL_ROUTES_RAW}, {_R.SQL_AIRLINES_READ},
{_R.SQL_ROUTES_READ}, {_R.SQL_AIRPORTS_OK}, {_R.sql_airlines_first('airlines_read')}, {_R.sql_region_lookup()},
j AS (
  SELECT r.*, o.city AS o_city, o.country AS o_country, o.latitude AS o_lat, o.longitude AS o_lon,
         de.city AS d_city, de.country AS d_country, de.latitude AS d_lat, de.longitude AS d_lon,
         a.iata_code AS a_code, a.name AS a_name,
         {_hav('o.latitude', 'o.longitude', 'de.latitude', 'de.longitude')} AS distance
  FROM routes_read r JOIN airports_ok o ON r.origin_airport = o.iata_code
  JOIN airports_ok de ON r.destination_airport = de.iata_code
  LEFT JOIN airlines_first a ON r.airline_code = a.iata_code
),
enriched AS (
  SELECT airline_code, CASE WHEN a_code IS NOT NULL THEN a_name ELSE 'Unknown' END AS airline_name,
         airline_code || CAST(100 + {_pmod(_NUM_SEED, 9900)} AS VARCHAR) AS flight_number,
         origin_airport, o_city AS origin_city, o_country AS origin_country,
         COALESCE(ro.region, 'Other') AS origin_region,
         CAST(CAST(o_lat AS DECIMAL(10,6)) AS DOUBLE) AS origin_latitude,
         CAST(CAST(o_lon AS DECIMAL(10,6)) AS DOUBLE) AS origin_longitude,
         destination_airport, d_city AS destination_city, d_country AS destination_country,
         COALESCE(rd.region, 'Other') AS destination_region,
         CAST(CAST(d_lat AS DECIMAL(10,6)) AS DOUBLE) AS destination_latitude,
         CAST(CAST(d_lon AS DECIMAL(10,6)) AS DOUBLE) AS destination_longitude,
         CAST(CAST(distance AS DECIMAL(10,2)) AS DOUBLE) AS distance_km,
         {_seats('distance')} AS seats,
         {_FIRST_TOKEN} AS aircraft_type,
         codeshare IS NOT DISTINCT FROM 'Y' AS codeshare,
         CAST(COALESCE(stops, 0) AS BIGINT) AS stops
  FROM j LEFT JOIN region_lookup ro ON j.o_country = ro.country
  LEFT JOIN region_lookup rd ON j.d_country = rd.country
)"""

SQL["enrich_routes"] = f"""{_ENRICHED}
SELECT * FROM enriched"""

SQL["enriched_fact"] = f"""{_ENRICHED},
dates AS (SELECT CAST(m AS DATE) AS flight_date
          FROM generate_series(TIMESTAMP '1999-08-01', TIMESTAMP '2001-08-01', INTERVAL 1 MONTH) t(m)),
fact AS (SELECT e.*, flight_date FROM enriched e, dates)
SELECT CAST(year(flight_date) AS BIGINT) AS flight_year, CAST(month(flight_date) AS BIGINT) AS flight_month,
       CAST(quarter(flight_date) AS BIGINT) AS flight_quarter, origin_region,
       CAST(COUNT(*) AS BIGINT) AS flights, CAST(SUM(seats) AS BIGINT) AS total_seats,
       CAST(SUM(CAST(distance_km AS DECIMAL(10,2))) AS DOUBLE) AS total_distance,
       CAST(COUNT(DISTINCT flight_number) AS BIGINT) AS flight_numbers,
       strftime(MIN(flight_date), '%Y-%m-%d') AS first_date
FROM fact GROUP BY 1, 2, 3, 4"""

SQL["fact_roundtrip_csv"] = f"""{WITH_FLIGHTS}
SELECT {FACT_SELECT} FROM flights"""

SQL["fact_roundtrip_parquet"] = SQL["fact_roundtrip_csv"]
SQL["load_overwrite"] = SQL["fact_roundtrip_csv"]
SQL["load_append"] = SQL["fact_roundtrip_csv"]

SQL["csv_append"] = f"""SELECT {EVENTS_PLAIN} FROM events"""

SQL["insert_select"] = f"""{WITH_FLIGHTS}
SELECT CAST(COUNT(*) AS BIGINT) AS rows_before, CAST(COUNT(*) + 100 AS BIGINT) AS rows_after,
       CAST(100 AS BIGINT) AS rows_inserted, CAST(100 AS BIGINT) AS inserted_on_as_of FROM flights"""

SQL["sync_current_state"] = SQL["latest_per_key"]

SQL["sync_counters"] = """SELECT CAST(1 AS BIGINT) AS batches, CAST(COUNT(*) AS BIGINT) AS rows_synced FROM events"""

SQL["hub_concentration_all"] = SQL["hub_concentration"].replace("SELECT * FROM ranked WHERE hub_rank <= 10",
                                                              "SELECT * FROM ranked")

SQL["change_window_stream"] = f"""SELECT {ts('time_bucket(INTERVAL 1 MINUTE, ts)')} AS window_start,
       {ts('time_bucket(INTERVAL 1 MINUTE, ts) + INTERVAL 1 MINUTE')} AS window_end,
       CAST(COUNT(*) AS BIGINT) AS new_records, {ts('MIN(ts)')} AS earliest, {ts('MAX(ts)')} AS latest
FROM events GROUP BY time_bucket(INTERVAL 1 MINUTE, ts)"""


def _body(key: str) -> str:
    text = SQL[key]
    assert text.startswith(WITH_FLIGHTS)
    return text[len(WITH_FLIGHTS):].strip()


_CORE = ["top_10_hubs", "regional_capacity", "underserved_routes", "capacity_trends", "distance_analysis"]
SQL["layouts_agree"] = f"""{WITH_FLIGHTS},
""" + ",\n".join(f"r_{k} AS ({_body(k)})" for k in _CORE) + "\n" + "\nUNION ALL\n".join(
    f"SELECT '{k}' AS query, CAST(COUNT(*) AS BIGINT) AS rows_left, CAST(COUNT(*) AS BIGINT) AS rows_right, "
    f"CAST(0 AS BIGINT) AS only_left, CAST(0 AS BIGINT) AS only_right, CAST(COUNT(*) AS BIGINT) AS matched, "
    f"TRUE AS equal FROM r_{k}" for k in _CORE)

SQL["sample_n"] = "SELECT CAST(100 AS BIGINT) AS sample_rows, CAST(0 AS BIGINT) AS not_in_fact"

SQL["table_profile"] = """SELECT 'columnar' AS layout, CAST(COUNT(*) AS BIGINT) AS row_count, TRUE AS has_files,
       TRUE AS has_size, TRUE AS times_in_order FROM lineitem"""

SQL["compare_storage"] = """SELECT CAST(COUNT(*) AS BIGINT) AS row_row_count, CAST(COUNT(*) AS BIGINT) AS col_row_count,
       TRUE AS columnar_smaller FROM lineitem"""

SQL["change_window_files"] = SQL["change_window_stream"]
SQL["change_window_partials"] = SQL["change_window_stream"]
SQL["sync_continuous"] = SQL["latest_per_key"]
SQL["sync_empty_batch"] = """SELECT CAST(0 AS BIGINT) AS batches, CAST(0 AS BIGINT) AS rows_synced,
       CAST(0 AS BIGINT) AS state_rows, CAST(COUNT(*) AS BIGINT) AS feed_rows_in_table
FROM events WHERE event_id IS NOT NULL"""

# The fact in its table form
_TABLE_FORM = WITH_FLIGHTS.replace("flights AS (\n  SELECT\n", """flights AS (
  SELECT
    l.l_orderkey * 8 + l.l_linenumber AS flight_id,
    CAST(CAST(l.l_shipdate AS DATE) AS TIMESTAMP) AS created_at,
    CAST(CAST(l.l_shipdate AS DATE) AS TIMESTAMP) + to_seconds(l.l_partkey % 1440 * 60 + l.l_linenumber) AS updated_at,
""")
_FACT_MARK = "TIMESTAMP '2001-07-01 00:00:00'"
_TABLE_SELECT = f"CAST(flight_id AS BIGINT) AS flight_id, {FACT_SELECT}, {ts('created_at')} AS created_at, {ts('updated_at')} AS updated_at"
SQL["fact_table_projection"] = f"{_TABLE_FORM}\nSELECT {_TABLE_SELECT} FROM flights"
SQL["fact_incremental"] = f"{_TABLE_FORM}\nSELECT {_TABLE_SELECT} FROM flights WHERE updated_at > {_FACT_MARK}"
SQL["fact_csv_append"] = SQL["fact_incremental"]
SQL["reconcile_tree"] = f"""{_TABLE_FORM},
a AS (SELECT {_TABLE_SELECT} FROM flights),
b AS (SELECT * REPLACE (CASE WHEN flight_id % 1000 = 7 THEN seats + 1 ELSE seats END AS seats) FROM a
      WHERE coalesce(flight_id % 1000 <> 8, TRUE)),
n AS (SELECT (SELECT COUNT(*) FROM a) AS l, (SELECT COUNT(*) FROM b) AS r,
             (SELECT COUNT(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) x) AS lo,
             (SELECT COUNT(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a) y) AS ro)
SELECT l AS rows_left, r AS rows_right, lo AS only_left, ro AS only_right, l - lo AS matched, lo = 0 AND ro = 0 AS equal FROM n"""
SQL["fact_sync"] = f"""{_TABLE_FORM},
now AS (
  SELECT flight_id, flight_number, codeshare, created_at,
         CASE WHEN updated_at > {_FACT_MARK} THEN seats + 1 ELSE seats END AS seats,
         CASE WHEN updated_at > {_FACT_MARK} THEN updated_at + INTERVAL 1 MINUTE ELSE updated_at END AS updated_at
  FROM flights
)
SELECT CAST(flight_id AS BIGINT) AS flight_id, flight_number, CAST(seats AS BIGINT) AS seats, codeshare,
       {ts('created_at')} AS created_at, {ts('updated_at')} AS updated_at
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY flight_id
        ORDER BY updated_at DESC, flight_number DESC, seats DESC, created_at DESC, codeshare DESC) AS rn FROM now) t
WHERE rn = 1"""

SQL["top_10_hubs_rollup"] = SQL["top_10_hubs"]
SQL["capacity_trends_rollup"] = SQL["capacity_trends"]
SQL["table_feed_sync"] = SQL["fact_sync"]
SQL["fact_sync_merged"] = SQL["fact_sync"]
SQL["sample_n_rows"] = """SELECT CAST(l_orderkey AS BIGINT) AS l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,
       CAST(l_partkey AS BIGINT) AS l_partkey, CAST(l_suppkey AS BIGINT) AS l_suppkey, l_returnflag FROM lineitem
ORDER BY md5('17|' || coalesce(l_orderkey::VARCHAR, 'null') || '|' || coalesce(l_linenumber::VARCHAR, 'null') || '|' ||
  coalesce(l_partkey::VARCHAR, 'null') || '|' || coalesce(l_suppkey::VARCHAR, 'null') || '|' || coalesce(l_returnflag, 'null')) LIMIT 100"""
