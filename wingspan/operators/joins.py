"""Join helpers: lookup joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tasks over which the rows of one key are dealt.
SPREAD = 16


def lookup_left_with_default(
    left: DataFrame,
    right: DataFrame,
    left_key: str,
    right_key: str,
    value_col: str,
    out_col: str,
    default,
) -> DataFrame:
    """Left lookup; ``default`` only where no row matched (a matched null stays null).

    Few keys may hold most rows, or all of them: where Spark shuffles this join, each key's rows are dealt over ``SPREAD``
    tasks by a hash of the row, and the lookup's rows, which are as many more, meet them there."""
    r = right.select(
        F.col(right_key).alias("__lk"), F.col(value_col).alias("__lv"), F.lit(True).alias("__hit"),
        F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("__ls"),
    )
    salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in left.columns]), F.lit(SPREAD)).cast("int")
    joined = left.join(r, (F.col(left_key) == F.col("__lk")) & (salt == F.col("__ls")), "left")
    return joined.withColumn(
        out_col, F.when(F.col("__hit"), F.col("__lv")).otherwise(F.lit(default))
    ).drop("__lk", "__lv", "__hit", "__ls")
