"""Scalar helpers as Column expressions (JVM-side, inside whole-stage codegen).

None of these is a Python UDF; each returns a ``Column`` built from
``pyspark.sql.functions``.
"""

from __future__ import annotations

import calendar
import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from wingspan import schemas as S


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


# H1 ------------------------------------------------------------------------
def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance in km, rounded to 2 decimals.

    ``least(1, a)`` keeps ``asin`` defined when rounding pushes ``a`` past 1.
    """
    lat1, lon1, lat2, lon2 = (_c(x).cast("double") for x in (lat1, lon1, lat2, lon2))
    dlat = F.radians(lat2) - F.radians(lat1)
    dlon = F.radians(lon2) - F.radians(lon1)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(
        F.sin(dlon / 2), 2
    )
    return F.round(F.lit(S.EARTH_RADIUS_KM) * 2 * F.asin(F.sqrt(F.least(F.lit(1.0), a))), 2)


# H2 ------------------------------------------------------------------------
def quarter_of_month(month) -> Column:
    return (F.floor((_c(month) - 1) / 3) + 1).cast("int")


# H3 / H4 -------------------------------------------------------------------
def month_start_series(start, end) -> Column:
    """Array of dates: ``start`` itself, then every following 1st up to ``end``.

    Without the guard ``sequence`` fails when the first 1st is past ``end``.
    """
    start, end = _c(start).cast("date"), _c(end).cast("date")
    first = F.trunc(F.add_months(start, 1), "MM")
    rest = F.when(
        first <= end, F.sequence(first, end, F.expr("INTERVAL 1 MONTH"))
    ).otherwise(F.array().cast("array<date>"))
    return F.when(start <= end, F.concat(F.array(start), rest)).otherwise(
        F.array().cast("array<date>")
    )


def day_series(start, end) -> Column:
    start, end = _c(start).cast("date"), _c(end).cast("date")
    return F.when(start <= end, F.sequence(start, end, F.expr("INTERVAL 1 DAY"))).otherwise(
        F.array().cast("array<date>")
    )


# B8 / H5 -------------------------------------------------------------------
def distance_band(distance) -> Column:
    """Searched CASE: null and exactly 4000 fall into the last band."""
    d = _c(distance)
    expr = None
    for upper, label in S.DISTANCE_BANDS:
        expr = F.when(d < upper, label) if expr is None else expr.when(d < upper, label)
    return expr.otherwise(S.BAND_ULTRA)


def band_rank(label) -> Column:
    lab = _c(label)
    expr = None
    for rank, name in enumerate(S.BAND_ORDER[:-1], start=1):
        expr = F.when(lab == name, rank) if expr is None else expr.when(lab == name, rank)
    return expr.otherwise(len(S.BAND_ORDER))


# H6 ------------------------------------------------------------------------
def seat_estimate(distance, seed, max_seats: int = S.MAX_SEATS) -> Column:
    """Deterministic seat count in the band's inclusive range.

    ``seed`` is an integer column (a route key); ``pmod`` spreads it over the
    range so the value is stable across reruns and executors.
    """
    d = _c(distance)
    lo = F.lit(S.ULTRA_MIN_SEATS)
    width = F.lit(max_seats - S.ULTRA_MIN_SEATS + 1)
    for upper, low, high in reversed(S.SEAT_RANGES):
        lo = F.when(d < upper, F.lit(low)).otherwise(lo)
        width = F.when(d < upper, F.lit(high - low + 1)).otherwise(width)
    return (lo + F.pmod(F.coalesce(_c(seed).cast("bigint"), F.lit(0)), width)).cast("int")


# H6b -----------------------------------------------------------------------
def aircraft_seats_map() -> Column:
    return F.create_map(*[x for k, v in S.AIRCRAFT_SEAT_MAPPING.items() for x in (F.lit(k), F.lit(v))])


# H7 ------------------------------------------------------------------------
def flight_number(airline_code, seed) -> Column:
    """Airline code followed by an integer in 100..9999; null code gives null."""
    span = S.FLIGHT_NUMBER_MAX - S.FLIGHT_NUMBER_MIN + 1
    num = F.lit(S.FLIGHT_NUMBER_MIN) + F.pmod(F.coalesce(_c(seed).cast("bigint"), F.lit(0)), F.lit(span))
    return F.concat(_c(airline_code), num.cast("string"))


# H8 ------------------------------------------------------------------------
def first_token(text, default: str = "Unknown") -> Column:
    """First whitespace-separated token (tabs count as whitespace); null or
    blank gives ``default``."""
    stripped = F.regexp_replace(_c(text), r"^\s+", "")
    tokens = F.split(F.nullif(stripped, F.lit("")), r"\s+")
    return F.coalesce(F.get(tokens, 0), F.lit(default))


# H9 ------------------------------------------------------------------------
def flag_to_int(flag, true_value: str = "Y") -> Column:
    return F.when(_c(flag).eqNullSafe(true_value), 1).otherwise(0)


# H10 -----------------------------------------------------------------------
def int_or_default(value, default: int = 0) -> Column:
    return F.coalesce(_c(value).try_cast("int"), F.lit(default))


# H12 -----------------------------------------------------------------------
def month_start_date(year, month) -> Column:
    return F.make_date(_c(year), _c(month), F.lit(1))


# H13 -----------------------------------------------------------------------
def safe_ratio(numerator, denominator, when_zero=None) -> Column:
    """``a / b`` as double; ``when_zero`` (default +inf) where ``b`` is 0."""
    num, den = _c(numerator).cast("double"), _c(denominator).cast("double")
    zero = F.lit(float("inf")) if when_zero is None else F.lit(when_zero).cast("double")
    return F.when(den == 0, zero).otherwise(num / den)


# H14 -----------------------------------------------------------------------
def bytes_to_mb(size) -> Column:
    return F.round(_c(size).cast("double") / 1048576, 2)


# aggregates ------------------------------------------------------------------
def mean(col, in_scale: int = 0, out_scale: int = 4) -> Column:
    """Exact average, rounded half away from zero to ``out_scale`` decimals.

    The reference's engine averages ``int`` to 4 decimals and
    ``decimal(10,2)`` to 6 (input scale + 4). The sum is exact (bigint or
    decimal), rescaled to an integer count ``u`` of input units (10^-in_scale);
    with ``m = 10^(out_scale - in_scale)``, ``sign(u) * ((2|u|m + n) div 2n)``
    is the rounded mean in units of 10^-out_scale, computed in integers, so
    the result does not depend on row order or floating-point ties. One exact
    conversion to double at the end.
    """
    c = _c(col)
    return mean_of(F.sum(c), F.count(c), in_scale, out_scale)


def mean_of(total: Column, n: Column, in_scale: int = 0, out_scale: int = 4) -> Column:
    """``mean`` from an exact sum and count; null for a count of 0."""
    units = (total * F.lit(10 ** in_scale)).cast("decimal(38,0)")
    num = F.abs(units) * F.lit(2 * 10 ** (out_scale - in_scale)) + n
    q = F.call_function("div", num, F.nullif(n * 2, F.lit(0)))
    signed = F.when(units < 0, -q).otherwise(q)
    return signed.cast("double") / F.lit(float(10 ** out_scale))


SEATS_SCALE = (0, 4)      # avg(int): 4 decimals
DISTANCE_SCALE = (2, 6)   # avg(decimal(10,2)): 6 decimals


# null tokens -----------------------------------------------------------------
def null_tokens(col, tokens=S.PANDAS_NULL_TOKENS) -> Column:
    c = _c(col)
    return F.when(c.isin(list(tokens)), F.lit(None).cast("string")).otherwise(c)


# literals --------------------------------------------------------------------------
def ts_literal(value, data_type) -> Column:
    """A timestamp literal typed like the column it is compared with.

    Built from ISO text, so a ``timestamp_ntz`` literal never passes through
    the Python process or session time zone."""
    if isinstance(value, Column):
        return value
    text = value.isoformat(sep=" ") if isinstance(value, dt.datetime) else str(value)
    return F.lit(text).cast(data_type)


# calendar helpers (driver-side constants) ----------------------------------------
def add_months(day: dt.date, months: int) -> dt.date:
    """Month arithmetic with end-of-month clamp (03-31 minus 1 month = 02-28/29)."""
    index = day.year * 12 + (day.month - 1) + months
    year, month = divmod(index, 12)
    month += 1
    return dt.date(year, month, min(day.day, calendar.monthrange(year, month)[1]))


def month_starts(end: dt.date, months: int) -> list[dt.date]:
    """``month_start_series`` from ``months`` before ``end``: that day, then each following 1st up to ``end``."""
    start = add_months(end, -months)
    firsts = [add_months(start.replace(day=1), k) for k in range(1, months + 2)]
    return [start, *(d for d in firsts if d <= end)]


def as_date(value) -> dt.date:
    if value is None:
        return dt.date.today()
    if isinstance(value, dt.datetime):
        return value.date()
    if isinstance(value, dt.date):
        return value
    return dt.date.fromisoformat(str(value))
