"""Table schemas and fixed values.

Strings group and compare with Spark's binary collation: every grouped
string is a code, a name from one source, or a constant label.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Raw files: headerless, comma separated, ``\N`` for null, doubled quotes.
# ---------------------------------------------------------------------------

AIRPORTS = T.StructType(
    [
        T.StructField("airport_id", T.IntegerType()),
        T.StructField("name", T.StringType()),
        T.StructField("city", T.StringType()),
        T.StructField("country", T.StringType()),
        T.StructField("iata_code", T.StringType()),
        T.StructField("icao_code", T.StringType()),
        # read at full precision; decimal(10,6) only when the fact is written
        T.StructField("latitude", T.DoubleType()),
        T.StructField("longitude", T.DoubleType()),
        T.StructField("altitude", T.IntegerType()),
        T.StructField("timezone", T.DecimalType(4, 2)),
        T.StructField("dst", T.StringType()),
        T.StructField("tz_database", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("source", T.StringType()),
    ]
)

AIRLINES = T.StructType(
    [
        T.StructField("airline_id", T.IntegerType()),
        T.StructField("name", T.StringType()),
        T.StructField("alias", T.StringType()),
        T.StructField("iata_code", T.StringType()),
        T.StructField("icao_code", T.StringType()),
        T.StructField("callsign", T.StringType()),
        T.StructField("country", T.StringType()),
        T.StructField("active", T.StringType()),
    ]
)

ROUTES = T.StructType(
    [
        T.StructField("airline_code", T.StringType()),
        T.StructField("airline_id", T.IntegerType()),
        T.StructField("origin_airport", T.StringType()),
        T.StructField("origin_airport_id", T.IntegerType()),
        T.StructField("destination_airport", T.StringType()),
        T.StructField("destination_airport_id", T.IntegerType()),
        T.StructField("codeshare", T.StringType()),
        T.StructField("stops", T.IntegerType()),
        T.StructField("equipment", T.StringType()),
    ]
)

# ---------------------------------------------------------------------------
# The wide flight fact, in the column order of the enriched CSV file.
# ---------------------------------------------------------------------------

_LATLON = T.DecimalType(10, 6)

FACT = T.StructType(
    [
        T.StructField("airline_code", T.StringType()),
        T.StructField("airline_name", T.StringType()),
        T.StructField("flight_number", T.StringType()),
        T.StructField("origin_airport", T.StringType()),
        T.StructField("origin_city", T.StringType()),
        T.StructField("origin_country", T.StringType()),
        T.StructField("origin_region", T.StringType()),
        T.StructField("origin_latitude", _LATLON),
        T.StructField("origin_longitude", _LATLON),
        T.StructField("destination_airport", T.StringType()),
        T.StructField("destination_city", T.StringType()),
        T.StructField("destination_country", T.StringType()),
        T.StructField("destination_region", T.StringType()),
        T.StructField("destination_latitude", _LATLON),
        T.StructField("destination_longitude", _LATLON),
        T.StructField("distance_km", T.DecimalType(10, 2)),
        T.StructField("seats", T.IntegerType()),
        T.StructField("aircraft_type", T.StringType()),
        T.StructField("codeshare", T.BooleanType()),
        T.StructField("stops", T.IntegerType()),
        T.StructField("flight_date", T.DateType()),
        T.StructField("flight_year", T.IntegerType()),
        T.StructField("flight_month", T.IntegerType()),
        T.StructField("flight_quarter", T.IntegerType()),
    ]
)

FACT_COLUMNS = [f.name for f in FACT.fields]

# CSV form of the fact: the flag is written and read as 0/1.
FACT_CSV = T.StructType(
    [T.StructField(f.name, T.IntegerType()) if f.name == "codeshare" else f for f in FACT.fields]
)

# Writing: blanks at the ends of text are data.
CSV_KEEP_BLANKS = {"ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}

# Column order of the analytical table (key first, audit columns last).
FACT_TABLE_ORDER = [
    "airline_code", "airline_name", "flight_number",
    "origin_airport", "origin_city", "origin_country", "origin_region",
    "origin_latitude", "origin_longitude",
    "destination_airport", "destination_city", "destination_country", "destination_region",
    "destination_latitude", "destination_longitude",
    "distance_km", "seats", "aircraft_type",
    "flight_date", "flight_year", "flight_month", "flight_quarter",
    "codeshare", "stops",
]

FACT_WITH_AUDIT = T.StructType(
    [T.StructField("flight_id", T.LongType())]
    + [FACT[name] for name in FACT_TABLE_ORDER]
    + [
        T.StructField("created_at", T.TimestampType()),
        T.StructField("updated_at", T.TimestampType()),
    ]
)

# Partition folders of a written fact: always derived from flight_date by the
# writer, so pruning on them can never lose a row; flight_year / flight_month
# stay ordinary data columns.
FACT_PARTITION_COLUMNS = ["part_year", "part_month"]

# ---------------------------------------------------------------------------
# Fixed values that results depend on.
# ---------------------------------------------------------------------------

# Tokens that the pandas CSV reader turns into null by default.
PANDAS_NULL_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]

# Region of each two-letter country code; the first region whose
# list holds the value wins, anything else is "Other".
REGION_MAPPING = {
    "North America": ["US", "CA", "MX", "CU", "DO", "HT", "JM", "PR", "TT", "BS", "BB"],
    "South America": ["BR", "AR", "CL", "CO", "PE", "VE", "EC", "BO", "PY", "UY", "GY", "SR", "GF"],
    "Europe": ["GB", "FR", "DE", "IT", "ES", "NL", "BE", "CH", "AT", "SE", "NO", "DK", "FI", "PL",
               "CZ", "PT", "GR", "HU", "RO", "IE", "UA", "RU"],
    "Asia": ["CN", "JP", "IN", "KR", "TH", "MY", "SG", "ID", "PH", "VN", "TW", "HK", "PK", "BD",
             "KZ", "UZ", "MM", "KH", "LA", "MN", "NP", "LK"],
    "Middle East": ["AE", "SA", "QA", "KW", "OM", "BH", "JO", "LB", "IL", "IQ", "IR", "YE", "SY"],
    "Africa": ["ZA", "EG", "NG", "KE", "MA", "ET", "TZ", "GH", "UG", "AO", "MZ", "MG", "CM", "CI",
               "NE", "BF", "ML", "MW", "ZM", "SN", "SO", "ZW", "RW", "BJ", "TN", "SS", "LY"],
    "Oceania": ["AU", "NZ", "FJ", "PG", "NC", "PF", "GU", "AS", "TO", "VU", "WS", "KI", "FM"],
}
OTHER_REGION = "Other"
REGIONS = list(REGION_MAPPING) + [OTHER_REGION]

# Distance band labels, upper bounds in km, and sort rank.
BAND_SHORT = "Short-haul (<500km)"
BAND_MEDIUM = "Medium-haul (500-1500km)"
BAND_LONG = "Long-haul (1500-4000km)"
BAND_ULTRA = "Ultra-long-haul (>4000km)"
DISTANCE_BANDS = [(500, BAND_SHORT), (1500, BAND_MEDIUM), (4000, BAND_LONG)]
BAND_ORDER = [BAND_SHORT, BAND_MEDIUM, BAND_LONG, BAND_ULTRA]

# Inclusive seat range per distance band (upper bound in km).
SEAT_RANGES = [(500, 100, 180), (1500, 120, 220), (4000, 150, 300)]
ULTRA_MIN_SEATS = 250
MAX_SEATS = 550

# Flight numbers are the airline code plus an integer in 100..9999.
FLIGHT_NUMBER_MIN = 100
FLIGHT_NUMBER_MAX = 9999

EARTH_RADIUS_KM = 6371.0
HISTORY_MONTHS = 24
CHUNK_ROWS = 10000
SYNC_INTERVAL_SECONDS = 300
FIRST_SYNC_ROWS = 1000

# Optional aircraft code -> seats lookup (not used by the default
# enrichment, which estimates seats from distance).
AIRCRAFT_SEAT_MAPPING = {
    "737": 180, "738": 189, "73G": 168, "320": 180, "321": 220, "319": 156,
    "77W": 350, "777": 350, "787": 296, "788": 242, "789": 290, "380": 550,
    "359": 325, "350": 315, "E90": 100, "E95": 120, "CRJ": 76, "CR7": 70,
    "DH4": 78, "AT7": 72,
}
