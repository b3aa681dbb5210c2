"""Result reconciliation (G2), copy-count check (G3) and load count (A10).

``compare`` is a distributed, null-safe bag comparison: no sorting of whole
results on the driver. Non-float columns must match exactly; float / double
columns within an absolute tolerance (decimals compare exactly).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wingspan.operators.windows import running_sums

FLOAT_TYPES = (T.FloatType, T.DoubleType)
_COUNTS = ["rows_left", "rows_right", "only_left", "only_right"]


def _float_cols(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, FLOAT_TYPES)]


def compare(left: DataFrame, right: DataFrame, tolerance: float = 0.001) -> DataFrame:
    """One row: rows_left, rows_right, only_left, only_right, matched, equal.

    Within equal non-float values (the key) both sides are sorted by their
    float columns and paired rank by rank, as two sorted lists are zipped; a
    pair whose floats all lie within ``tolerance`` matches (null matches null
    only). Different column sets -> nothing matches.

    Each input is evaluated once: the union, weighted by side, is grouped by
    all columns, which reduces repeated rows within each task. With float
    columns the distinct rows get running ranks in blocks of the global order
    (``windows.running_sums``), so a key that holds most rows is spread over
    many tasks, and ranks meet in a grouping by key and rank.
    """
    if [f.name for f in left.schema.fields] != [f.name for f in right.schema.fields]:
        a, b = left.count(), right.count()
        return left.sparkSession.createDataFrame(
            [(a, b, a, b, 0, False)],
            "rows_left bigint, rows_right bigint, only_left bigint, only_right bigint, matched bigint, equal boolean",
        )
    columns, floats = left.columns, _float_cols(left)
    plain = {c: f"__c{i}" for i, c in enumerate(columns)}
    keys, values = [plain[c] for c in columns if c not in floats], [plain[c] for c in floats]

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(*[F.col(f"`{c}`").alias(plain[c]) for c in columns],
                         *[F.lit(int(n == name)).cast("bigint").alias(n) for n in ("__l", "__r")])

    both = side(left, "__l").unionByName(side(right, "__r"))
    rows = both.groupBy(*keys, *values).agg(F.sum("__l").alias("__l"), F.sum("__r").alias("__r"))
    if not floats:
        flags = rows.select(
            F.col("__l").alias("rows_left"), F.col("__r").alias("rows_right"),
            F.greatest(F.col("__l") - F.col("__r"), F.lit(0)).alias("only_left"),
            F.greatest(F.col("__r") - F.col("__l"), F.lit(0)).alias("only_right"),
        )
    else:
        ranked = running_sums(rows, [*keys, *values], {"__lr": "__l", "__rr": "__r"})
        key = [F.xxhash64(F.lit(0), *keys).alias("__k0"), F.xxhash64(F.lit(1), *keys).alias("__k1")]
        ranked = ranked.select(*key, *values, "__l", "__r", "__lr", "__rr")
        first = ranked.groupBy("__k0", "__k1").agg(F.min(F.col("__lr") - F.col("__l")).alias("__l0"),
                                                   F.min(F.col("__rr") - F.col("__r")).alias("__r0"))
        ranked = ranked.join(first, ["__k0", "__k1"])
        places = []
        for n, run, start in (("__l", "__lr", "__l0"), ("__r", "__rr", "__r0")):
            at = F.explode(F.sequence(F.col(run) - F.col(n) - F.col(start) + 1, F.col(run) - F.col(start)))
            places.append(ranked.filter(F.col(n) > 0).select("__k0", "__k1", at.alias("__rank"), F.lit(n).alias("__side"),
                                                             F.struct(*values).alias("__v")))
        paired = places[0].unionByName(places[1]).groupBy("__k0", "__k1", "__rank").agg(
            *[F.max(F.when(F.col("__side") == n, F.col("__v"))).alias(n) for n in ("__l", "__r")])
        there = [F.col(n).isNotNull() for n in ("__l", "__r")]
        close = there[0] & there[1]
        for v in values:
            a, b = F.col("__l")[v], F.col("__r")[v]
            close = close & (a.eqNullSafe(b) | F.coalesce(F.abs(a - b) <= F.lit(tolerance), F.lit(False)))
        flags = paired.select(
            there[0].cast("bigint").alias("rows_left"), there[1].cast("bigint").alias("rows_right"),
            (there[0] & ~close).cast("bigint").alias("only_left"), (there[1] & ~close).cast("bigint").alias("only_right"),
        )
    out = flags.agg(*[F.sum(c).cast("bigint").alias(c) for c in _COUNTS]).na.fill(0)
    return out.select(
        *_COUNTS,
        (F.col("rows_left") - F.col("only_left")).alias("matched"),
        ((F.col("only_left") == 0) & (F.col("only_right") == 0)).alias("equal"),
    )


def results_match(left: DataFrame, right: DataFrame, tolerance: float = 0.001) -> bool:
    """Boolean form of ``compare`` (the reference's comparator contract)."""
    if left is None or right is None:
        return False
    return bool(compare(left, right, tolerance).first()["equal"])


# G3 -----------------------------------------------------------------------------------
def copy_counts(source: DataFrame, target: DataFrame) -> DataFrame:
    """One row: rows in the source copy, in the target copy, and the gap."""
    both = source.select(F.lit(1).alias("s"), F.lit(0).alias("t")).unionByName(
        target.select(F.lit(0).alias("s"), F.lit(1).alias("t"))
    )
    counts = both.agg(
        F.coalesce(F.sum("s"), F.lit(0)).cast("bigint").alias("source_rows"),
        F.coalesce(F.sum("t"), F.lit(0)).cast("bigint").alias("target_rows"),
    )
    diff = F.col("source_rows") - F.col("target_rows")
    return counts.select("source_rows", "target_rows", diff.alias("difference"), (diff == 0).alias("in_sync"))


# A10 ----------------------------------------------------------------------------------
def validate_count(table: DataFrame, expected: DataFrame | int) -> DataFrame:
    """One row: expected, actual and whether they match."""
    if isinstance(expected, int):
        counts = table.agg(F.lit(expected).cast("bigint").alias("expected_count"),
                           F.count(F.lit(1)).alias("actual_count"))
    else:
        c = copy_counts(expected, table)
        counts = c.select(F.col("source_rows").alias("expected_count"), F.col("target_rows").alias("actual_count"))
    return counts.withColumn("matches", F.col("expected_count") == F.col("actual_count"))
