"""Literal flight-fact rows for query tests (FIXTURES.md section 2)."""

import datetime as dt
from decimal import Decimal

from wingspan import schemas as S

AS_OF = dt.date(2024, 3, 31)

DEFAULTS = dict(
    airline_code="AA", airline_name="Air A", flight_number="AA100",
    origin_airport="JFK", origin_city="New York", origin_country="US", origin_region="North America",
    origin_latitude=Decimal("40.639801"), origin_longitude=Decimal("-73.778900"),
    destination_airport="LHR", destination_city="London", destination_country="GB", destination_region="Europe",
    destination_latitude=Decimal("51.470600"), destination_longitude=Decimal("-0.461941"),
    distance_km=Decimal("5539.00"), seats=200, aircraft_type="777", codeshare=False, stops=0,
    flight_date=dt.date(2024, 3, 1),
)


def row(**kw):
    r = dict(DEFAULTS, **kw)
    d = r["flight_date"]
    r.setdefault("flight_year", d.year if d else None)
    r.setdefault("flight_month", d.month if d else None)
    r.setdefault("flight_quarter", (d.month - 1) // 3 + 1 if d else None)
    return tuple(r[c] for c in S.FACT_COLUMNS)


def fact(spark, rows):
    return spark.createDataFrame([row(**r) for r in rows], S.FACT)
