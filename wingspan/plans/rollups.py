"""Monthly rollups of the fact from which Q1 and Q4 are answered exactly.

A rollup is a folder with the codes of one column and the bitmaps and sums of every month, partitioned like the fact. A
trailing window takes whole months from the rollup; the month that the window's first day cuts is read from the fact's own
partition and reduced in the same way, so the answer equals the one on the fact for every day.

``refresh`` replaces the months it is given and no others: codes of new values are added and never change, each month's
folder is replaced by a dynamic partition overwrite.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wingspan import schemas as S
from wingspan.functions import exprs as X
from wingspan.operators import distinct as D
from wingspan.operators import filters as B
from wingspan.operators import ordering as O
from wingspan.plans import catalog as Q
from wingspan.session import FREED, settings
from wingspan.sources.sinks import _fs, publish_version, read_current

#: Rows of the fact whose bitmaps are made at a time: one month's at least.
SLICE_ROWS = 32_000_000


@dataclass(frozen=True)
class Rollup:
    keys: tuple[str, ...]
    column: str
    distinct: str
    months: int  # of the trailing window

    def sums(self) -> dict[str, Column]:
        return {
            "__rows": F.count(F.lit(1)),
            "__seats": F.sum("seats").cast("bigint"),
            "__seats_n": F.count("seats"),
            "__km": F.sum("distance_km"),
            "__km_n": F.count("distance_km"),
        }


HUBS = Rollup(("origin_airport", "origin_city", "origin_country"), "flight_number", "num_routes", 12)
TRENDS = Rollup(tuple(Q.TREND_KEYS), "airline_code", "num_airlines", 24)


def _month() -> Column:
    year, month = S.FACT_PARTITION_COLUMNS
    return F.col(year) * 12 + F.col(month) - 1


def build(fact: DataFrame, rollup: Rollup, base: str) -> None:
    """Codes and months of the whole fact, as read from its files, below ``base``. Rows without a date are in no month."""
    dated = fact.filter(F.col("flight_date").isNotNull())
    with settings(fact.sparkSession, FREED):
        publish_version(D.dense_codes(dated, rollup.column), f"{base}/codes")
    _write_months(dated, rollup, base)


def refresh(fact: DataFrame, rollup: Rollup, base: str, months: list[tuple[int, int]]) -> None:
    """Replace the given (year, month) by what the fact now holds; a month without rows goes."""
    spark = fact.sparkSession
    year, month = S.FACT_PARTITION_COLUMNS
    touched = fact.filter(F.col("flight_date").isNotNull()).filter(_month().isin([y * 12 + m - 1 for y, m in months]))
    known = read_current(spark, f"{base}/codes")
    publish_version(D.dense_codes(touched, rollup.column, known), f"{base}/codes")
    held = _write_months(touched, rollup, base)
    for y, m in months:
        if (y, m) not in held:
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/months/{year}={y}/{month}={m}")
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _write_months(rows: DataFrame, rollup: Rollup, base: str) -> set[tuple[int, int]]:
    """Months are written some at a time, ``SLICE_ROWS`` of their rows: what these shuffle goes before the next ones begin.

    The file that tells that all is written comes last."""
    spark = rows.sparkSession
    codes = read_current(spark, f"{base}/codes")
    counts = {(r[0], r[1]): r[2] for r in rows.groupBy(*S.FACT_PARTITION_COLUMNS).count().collect()}  # a row for each month
    groups = _some_months(counts) or [[]]
    for months in groups:
        some = rows if len(groups) == 1 else rows.filter(_month().isin([y * 12 + m - 1 for y, m in months]))
        bitmaps = D.month_bitmaps(some, codes, list(rollup.keys), rollup.column, rollup.sums())
        # the bitmaps come clustered and sorted by month: they are written where they were made
        out = bitmaps.sortWithinPartitions(*S.FACT_PARTITION_COLUMNS, *rollup.keys).write.mode("overwrite")
        out = out.options(compression="zstd", partitionOverwriteMode="dynamic")  # bitmaps are zeros for the most part
        out = out.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", False)
        with settings(spark, FREED):
            out.partitionBy(*S.FACT_PARTITION_COLUMNS).parquet(f"{base}/months")
    done, fs = _fs(spark, f"{base}/months/_SUCCESS")
    fs.create(done).close()
    return set(counts)


def _some_months(counts: dict[tuple[int, int], int]) -> list[list[tuple[int, int]]]:
    """The months in groups of at most ``SLICE_ROWS`` rows, or of one month."""
    out, held = [], 0
    for month, n in sorted(counts.items()):
        if not out or held + n > SLICE_ROWS:
            out.append([])
            held = 0
        out[-1].append(month)
        held += n
    return out


def exists(spark: SparkSession, base: str) -> bool:
    """Whether the months below ``base`` were written to the end."""
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/months/_SUCCESS")
    return done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done)


def read_months(fact: DataFrame, rollup: Rollup, base: str) -> DataFrame:
    """The rollup's months, with their declared schema (no inference job)."""
    km = T.DecimalType(fact.schema["distance_km"].dataType.precision + 10, fact.schema["distance_km"].dataType.scale)  # as Spark's sum
    own = [T.StructField(k, fact.schema[k].dataType) for k in rollup.keys]
    own += [T.StructField(D.BUCKET, T.LongType()), T.StructField(D.BITS, T.BinaryType())]
    own += [T.StructField(n, km if n == "__km" else T.LongType()) for n in rollup.sums()]
    parts = [T.StructField(c, T.IntegerType()) for c in S.FACT_PARTITION_COLUMNS]
    return fact.sparkSession.read.schema(T.StructType(own + parts)).parquet(f"{base}/months")


def window(fact: DataFrame, rollup: Rollup, base: str, as_of=None) -> DataFrame:
    """The rollup's keys over its trailing window: exact distinct values and sums."""
    spark = fact.sparkSession
    cutoff = B.trailing_cutoff(as_of, rollup.months)
    parts = read_months(fact, rollup, base)
    first = cutoff.year * 12 + cutoff.month - 1 + (cutoff.day > 1)
    whole = parts.filter(B.month_floor_predicate(cutoff) & (_month() >= first))
    if cutoff.day > 1:  # the month that the window cuts
        cut = fact.filter((_month() == first - 1) & (F.col("flight_date") >= F.lit(cutoff)))
        own = D.month_bitmaps(cut, read_current(spark, f"{base}/codes"), list(rollup.keys), rollup.column, rollup.sums())
        whole = whole.unionByName(own.select(*whole.columns))
    return D.merged(whole, list(rollup.keys), rollup.distinct, list(rollup.sums()))


def top_10_hubs(fact: DataFrame, base: str, as_of=None, k: int = 10) -> DataFrame:
    """Q1 from the rollup ``HUBS``."""
    totals = window(fact, HUBS, base, as_of).select(
        *HUBS.keys, HUBS.distinct, F.col("__seats").alias("total_seats"), X.mean_of(F.col("__seats"), F.col("__seats_n"), *X.SEATS_SCALE).alias("avg_seats_per_flight")
    )
    return O.top_k(totals, k, [F.col("total_seats").desc(), *HUBS.keys])


def capacity_trends(fact: DataFrame, base: str, as_of=None) -> DataFrame:
    """Q4 from the rollup ``TRENDS``."""
    totals = window(fact, TRENDS, base, as_of).select(
        *TRENDS.keys, TRENDS.distinct, F.col("__rows").alias("num_flights"), F.col("__seats").alias("total_seats"),
        X.mean_of(F.col("__km"), F.col("__km_n"), *X.DISTANCE_SCALE).alias("avg_distance"),
    )
    return totals.orderBy(*(F.col(k).asc_nulls_first() for k in TRENDS.keys))
