"""Exact distinct counts that merge (D2, for Q1 and Q4).

``COUNT(DISTINCT)`` of a window can't be put together from the counts of its months. Bitmaps can: the distinct values of a
column get a dense code, each group of a month keeps one bit for every code it has seen, 32,768 codes to a bucket, and the
bits of several months are or-ed. Sums and counts are kept beside them by bucket, so they add up too.

Null values get no bit, as ``COUNT(DISTINCT)`` passes over them, but their rows' sums are kept (bucket -1).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wingspan import schemas as S
from wingspan.operators.windows import with_position

CODE = "__code"
BITS = "__bits"
BUCKET = "__bucket"
#: Tasks over which the rows of one month are dealt.
PIECES = 8


def dense_codes(values: DataFrame, column: str, known: DataFrame | None = None) -> DataFrame:
    """(column, code) for every distinct value that is not null: codes from 1 on, without gaps, in order of the values.

    Neighbouring values share buckets, so a group whose values stand close together needs few of them. With ``known``
    codes those stay as they are, and new values are numbered after them.
    """
    fresh = values.select(column).filter(F.col(column).isNotNull()).distinct()
    if known is None:
        return with_position(fresh, [F.col(column).asc()], CODE)
    most = known.agg(F.coalesce(F.max(CODE), F.lit(0))).first()[0]
    new = with_position(fresh.join(known, column, "left_anti"), [F.col(column).asc()], CODE)
    return known.unionByName(new.withColumn(CODE, F.col(CODE) + most))


def month_bitmaps(rows: DataFrame, codes: DataFrame, keys: list[str], column: str, sums: dict[str, Column]) -> DataFrame:
    """By month of the rows' partition columns, ``keys`` and bucket: the bits of ``column``'s codes, and each of ``sums``.

    A value of ``rows`` that ``codes`` lacks fails the job, as its bit would be lost.

    Rows meet by month and a hash of their keys before any bitmap is made: narrow rows are shuffled and sorted, not their
    4 KB bitmaps. The result stands in order of month and keys within its tasks, a month in ``PIECES`` tasks at most.
    """
    own = rows.join(codes, column, "left")
    lost = F.raise_error(F.concat(F.lit(f"no code for {column} "), F.col(column).cast("string"))).cast("long")
    code = F.when(F.col(column).isNotNull() & F.col(CODE).isNull(), lost).otherwise(F.col(CODE))
    own = own.withColumns({CODE: code, "__piece": F.pmod(F.xxhash64(*keys), F.lit(PIECES))})
    own = own.repartition(*S.FACT_PARTITION_COLUMNS, "__piece")
    bucket = F.coalesce(F.bitmap_bucket_number(F.col(CODE)), F.lit(-1).cast("long")).alias(BUCKET)
    bits = F.bitmap_construct_agg(F.bitmap_bit_position(F.col(CODE))).alias(BITS)
    grouped = own.groupBy(*S.FACT_PARTITION_COLUMNS, *keys, bucket, "__piece")
    return grouped.agg(bits, *(c.alias(n) for n, c in sums.items())).drop("__piece")


def merged(parts: DataFrame, keys: list[str], distinct: str, sums: list[str]) -> DataFrame:
    """Of any months' bitmaps: by ``keys`` the exact number of distinct values, and the totals of ``sums``."""
    in_bucket = parts.groupBy(*keys, BUCKET).agg(F.bitmap_or_agg(BITS).alias(BITS), *(F.sum(s).alias(s) for s in sums))
    return in_bucket.groupBy(*keys).agg(F.sum(F.bitmap_count(BITS)).cast("bigint").alias(distinct), *(F.sum(s).alias(s) for s in sums))
