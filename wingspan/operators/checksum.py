"""Reconciliation of two copies by a checksum tree.

Rows fall into ranges of the hash of their key. A summary holds, for every range of a level, the number of rows and
order-free sums, modulo 2 ** 64, of two 64-bit hashes of the whole row, so repeated rows count and their order does not. One level has
``2 ** BITS`` ranges; a range that differs is cut into as many on the next level, whose summary reads the rows of
differing ranges only. Rows are compared one by one only in ranges that differ on the last level, so equal copies cost
one narrow aggregate each, combined within every task before the shuffle. On deeper levels ranges hold few rows, and a
summary shuffles nearly a narrow row for each: the copies are summarised one after the other, and what one shuffles goes
before the next begins.

Answers equal those of ``reconcile.compare``: floats may differ within the tolerance, and such rows make their range
differ, so they are looked at. Two ranges of other rows with the same sums would need a collision of 128 bits.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wingspan.operators.reconcile import FLOAT_TYPES, compare
from wingspan.session import FREED, scratch_path, settings
from wingspan.sources.sinks import STAGED_FILES, remove

#: Bits of the key's hash that a level adds: 4,096 ranges on the first one.
BITS = 12
#: Differing ranges (8 bytes each) up to which every task gets their list: whole rows of both copies are not shuffled to it.
LISTED = 1 << 20
#: Sums wrap around instead of failing.
_WRAP = {"spark.sql.ansi.enabled": "false"}


def _range_of(keys: list[str], level: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.lit("range"), *keys), 64 - BITS * level)


def _sums(columns: list[str]) -> dict[str, Column]:
    hashes = [F.xxhash64(F.lit(seed), *[x for c in columns for x in (F.col(c).isNull(), F.col(c))]) for seed in (0, 1)]
    return {"rows": F.count(F.lit(1))} | {f"s{seed}": F.sum(h) for seed, h in enumerate(hashes)}


def summary(df: DataFrame, keys: list[str], level: int = 1) -> DataFrame:
    """A row for each range of ``level`` that holds rows: the range, its rows and its sums.

    Null keys hash like any value. An empty frame gives no row. The first level has at most ``2 ** BITS`` rows.
    """
    plain = df.select(*[F.col(f"`{c}`").alias(f"__c{i}") for i, c in enumerate(df.columns)])
    at = [f"__c{df.columns.index(k)}" for k in keys]
    with settings(df.sparkSession, _WRAP):  # a sum keeps the mode it was planned with
        return plain.groupBy(_range_of(at, level).alias("range")).agg(*[v.alias(k) for k, v in _sums(plain.columns).items()])


def _staged(df: DataFrame, path: str) -> DataFrame:
    """``df`` written to files and read from there; its shuffle files are gone."""
    spark = df.sparkSession
    with settings(spark, FREED):
        df.write.options(**STAGED_FILES).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def differing(left: DataFrame, right: DataFrame) -> DataFrame:
    """(range, rows_left, rows_right, same) for every range of two summaries."""
    names = [c for c in left.columns if c != "range"]
    a = left.select(F.col("range").alias("a"), *[F.col(c).alias(f"l_{c}") for c in names])
    b = right.select(F.col("range").alias("b"), *[F.col(c).alias(f"r_{c}") for c in names])
    unlike = reduce(or_, [~F.col(f"l_{c}").eqNullSafe(F.col(f"r_{c}")) for c in names])
    return a.join(b, F.col("a") == F.col("b"), "full").select(
        F.coalesce("a", "b").alias("range"), F.coalesce("l_rows", F.lit(0)).cast("bigint").alias("rows_left"),
        F.coalesce("r_rows", F.lit(0)).cast("bigint").alias("rows_right"), (~unlike).alias("same"),
    )


def _within(df: DataFrame, keys: list[str], level: int, ranges: DataFrame) -> DataFrame:
    """The rows of ``df`` whose range of ``level`` is listed."""
    at = _range_of([f"`{k}`" for k in keys], level)
    listed = ranges.select(F.col("range").alias("__range"))
    # ranges of the first level are 2 ** BITS at most; over LISTED of those below Spark's own size rule decides
    listed = F.broadcast(listed) if level == 1 or ranges.limit(LISTED + 1).count() <= LISTED else listed
    return df.join(listed, at == F.col("__range"), "left_semi")


def compare_by_tree(left: DataFrame, right: DataFrame, keys: list[str], tolerance: float = 0.001, levels: int = 2) -> DataFrame:
    """One row as ``reconcile.compare`` gives it: rows_left, rows_right, only_left, only_right, matched, equal.

    ``keys`` are columns that tell rows apart well (the table's key); they may be null and may repeat, but must not be
    floats, as rows that match within the tolerance would part. A key that most rows share stays one range, which
    ``compare`` then spreads by itself. ``levels`` (1 to 5) bounds the depth. Copies of other columns match nowhere.
    """
    if [f.name for f in left.schema.fields] != [f.name for f in right.schema.fields]:
        return compare(left, right, tolerance)
    floats = [f.name for f in [*left.schema.fields, *right.schema.fields] if isinstance(f.dataType, FLOAT_TYPES)]
    if not keys or set(keys) & set(floats) or not 1 <= levels <= 5:
        raise ValueError("keys must be given and hold no float columns; levels must be 1 to 5")
    path = scratch_path(left.sparkSession, "checksums")
    a, b, settled = left, right, []
    for level in range(1, levels + 1):
        sums = [_staged(summary(x, keys, level), f"{path}/{level}-{n}") for n, x in enumerate((a, b))]
        met = _staged(differing(*sums), f"{path}/{level}-met")
        for n in range(2):
            remove(left.sparkSession, f"{path}/{level}-{n}")
        # ranges that are the same are settled on this level, with all their rows
        settled.append(met.filter("same").agg(F.sum("rows_left").alias("n")))
        unlike = met.filter(~F.col("same"))
        if unlike.isEmpty():
            a = b = None
            break
        a, b = _within(left, keys, level, unlike), _within(right, keys, level, unlike)
    same = reduce(DataFrame.unionByName, settled).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n")).first()["n"]
    if a is None:
        return left.sparkSession.createDataFrame(
            [(same, same, 0, 0, same, True)],
            "rows_left bigint, rows_right bigint, only_left bigint, only_right bigint, matched bigint, equal boolean",
        )
    more = [(F.col(c) + same).alias(c) if c in ("rows_left", "rows_right", "matched") else F.col(c) for c in
            ("rows_left", "rows_right", "only_left", "only_right", "matched", "equal")]
    return compare(a, b, tolerance).select(*more)
