"""Row filters (B1-B6) and projections."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wingspan import schemas as S
from wingspan.functions import exprs as X


def trailing_cutoff(as_of=None, months: int = 12) -> dt.date:
    return X.add_months(X.as_date(as_of), -months)


def month_floor_predicate(cutoff: dt.date, year_col="part_year", month_col="part_month") -> Column:
    """Implied by ``date >= cutoff``; stated on the partition columns so the
    scan skips whole month directories."""
    y, m = F.col(year_col), F.col(month_col)
    return (y > cutoff.year) | ((y == cutoff.year) & (m >= cutoff.month))


# B1 / H11 --------------------------------------------------------------------
def trailing_months(
    df: DataFrame,
    months: int,
    as_of=None,
    date_col: str = "flight_date",
) -> DataFrame:
    """``date >= as_of - n months``: no upper bound, null dates drop.

    A fact read from its files carries the partition columns that its writer
    derived from the date; the implied predicate on them skips month folders.
    The date parts that rows carry as data are never consulted."""
    cutoff = trailing_cutoff(as_of, months)
    cond = F.col(date_col) >= F.lit(cutoff)
    if date_col == "flight_date" and set(S.FACT_PARTITION_COLUMNS) <= set(df.columns):
        cond = cond & month_floor_predicate(cutoff)
    return df.filter(cond)  # one filter: one analysis round-trip


# B2 ---------------------------------------------------------------------------
def not_null_and_equal(df: DataFrame, not_null_col: str, eq_col: str, value) -> DataFrame:
    return df.filter(F.col(not_null_col).isNotNull() & (F.col(eq_col) == F.lit(value)))


# B3 ---------------------------------------------------------------------------
def flag_filter(df: DataFrame, col: str, value: str = "Y") -> DataFrame:
    return df.filter(F.col(col) == F.lit(value))


# B4 ---------------------------------------------------------------------------
def changed_since(df: DataFrame, col: str, mark, inclusive: bool = False) -> DataFrame:
    m = X.ts_literal(mark, df.schema[col].dataType)
    return df.filter(F.col(col) >= m if inclusive else F.col(col) > m)


def unchanged_since(df: DataFrame, col: str, mark, inclusive: bool = False) -> DataFrame:
    """The rows that ``changed_since`` leaves out, those without a time included."""
    m = X.ts_literal(mark, df.schema[col].dataType)
    changed = F.col(col) >= m if inclusive else F.col(col) > m
    return df.filter(~F.coalesce(changed, F.lit(False)))


# B5 ---------------------------------------------------------------------------
def recent_window(df: DataFrame, col: str, as_of_ts, minutes: int = 1) -> DataFrame:
    start = X.ts_literal(as_of_ts, df.schema[col].dataType) - F.expr(f"INTERVAL {int(minutes)} MINUTES")
    return df.filter(F.col(col) >= start)


# B9 ---------------------------------------------------------------------------
def with_date_parts(df: DataFrame, date_col: str = "flight_date", prefix: str = "flight_") -> DataFrame:
    d = F.col(date_col)
    return df.withColumns(
        {
            f"{prefix}year": F.year(d),
            f"{prefix}month": F.month(d),
            f"{prefix}quarter": F.quarter(d),
        }
    )


# B10 --------------------------------------------------------------------------
def override_dates(df: DataFrame, as_of=None) -> DataFrame:
    """Copy rows with the flight date and its parts replaced by ``as_of``."""
    day = X.as_date(as_of)
    return df.drop(*S.FACT_PARTITION_COLUMNS).withColumns(
        {
            "flight_date": F.lit(day),
            "flight_year": F.lit(day.year),
            "flight_month": F.lit(day.month),
            "flight_quarter": F.lit((day.month - 1) // 3 + 1),
        }
    )


# B11 --------------------------------------------------------------------------
def named_projection(df: DataFrame, names: list[str]) -> DataFrame:
    """Select by name, in the given order (never by position)."""
    return df.select(*[F.col(n) for n in names])
