"""Window-shaped operators (E1-E4) written to stay distributed.

* keep-first / latest-per-key use an aggregate of a struct instead of
  ``row_number`` over a partition: the aggregate combines map-side, so a key
  that holds a third of all rows is reduced before the shuffle instead of
  landing in one task.
* running totals over a global order never use an unpartitioned window on
  the rows: rows are range-partitioned into blocks, summed within a block,
  and shifted by the totals of the blocks before it (one row per block).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wingspan.session import shuffle_partitions


def _cols(cols) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cols]


# E1 ------------------------------------------------------------------------------
def keep_first(df: DataFrame, key: str, order_by: list[str]) -> DataFrame:
    """One row per ``key``: the smallest by ``order_by`` (ascending, total)."""
    rest = [c for c in df.columns if c != key]
    packed = F.struct(*[F.col(c).alias(f"__o{i}") for i, c in enumerate(order_by)], *rest)
    return df.groupBy(key).agg(F.min(packed).alias("__r")).select(key, *[f"__r.{c}" for c in rest])


# E4 ------------------------------------------------------------------------------
def latest_per_key(df: DataFrame, keys: list[str], order_by: list[str]) -> DataFrame:
    """One row per key: the largest by ``order_by`` (e.g. updated_at, tie-break).

    A column stands in the packed row once, so shuffles move no value twice."""
    rest = [c for c in df.columns if c not in keys]
    at = {c: f"__o{i}" for i, c in enumerate(dict.fromkeys(order_by))}
    packed = F.struct(*[F.col(c).alias(name) for c, name in at.items()], *[c for c in rest if c not in at])
    out = [F.col(f"__r.{at.get(c, c)}").alias(c) for c in rest]
    return df.groupBy(*keys).agg(F.max(packed).alias("__r")).select(*keys, *out)


# E2 building block ---------------------------------------------------------------
def running_sums(
    df: DataFrame,
    order_by: list,
    values: dict,
    totals: dict | None = None,
    blocks: int | None = None,
) -> DataFrame:
    """Running sums (rows unbounded preceding .. current row) in the total
    order ``order_by``: ``values`` maps output name -> value column; ``totals``
    maps output name -> a name in ``values`` whose grand total to attach.

    ``order_by`` must be a total order (append a unique key). The ranged frame
    is checkpointed so each row's block is fixed once, even if tasks re-run;
    only block totals (``blocks`` rows) are broadcast.
    """
    spark = df.sparkSession
    n = blocks or shuffle_partitions(spark)
    names = list(values)
    tmp = {name: f"__v{i}" for i, name in enumerate(names)}
    staged = df.withColumns({tmp[k]: (F.col(v) if isinstance(v, str) else v) for k, v in values.items()})
    ranged = (
        staged.repartitionByRange(n, *_cols(order_by))
        .withColumn("__blk", F.spark_partition_id())
        .checkpoint(eager=True)
    )
    within = Window.partitionBy("__blk").orderBy(*_cols(order_by)).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    local = ranged.withColumns({f"{tmp[k]}r": F.sum(tmp[k]).over(within) for k in names})
    # one row per block: bounded by the number of blocks, never by the data
    per_block = ranged.groupBy("__blk").agg(*[F.sum(tmp[k]).alias(f"{tmp[k]}b") for k in names])
    before = Window.orderBy("__blk").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    offsets = per_block.select(
        "__blk",
        *[F.coalesce(F.sum(f"{tmp[k]}b").over(before), F.lit(0)).alias(f"{tmp[k]}o") for k in names],
        *[F.sum(f"{tmp[src]}b").over(everything).alias(f"__t_{out}") for out, src in (totals or {}).items()],
    )
    res = local.join(F.broadcast(offsets), "__blk")
    res = res.withColumns({k: F.col(f"{tmp[k]}o") + F.col(f"{tmp[k]}r") for k in names})
    res = res.withColumns({out: F.col(f"__t_{out}") for out in (totals or {})})
    drop = ["__blk"] + [c for k in names for c in (tmp[k], f"{tmp[k]}r", f"{tmp[k]}o")]
    drop += [f"__t_{out}" for out in (totals or {})]
    return res.drop(*drop)


def with_position(df: DataFrame, order_by: list, out: str = "position") -> DataFrame:
    """1-based position in a total order, computed block-wise (see running_sums)."""
    return running_sums(df, order_by, {out: F.lit(1).cast("bigint")})


def position_in_limited(df: DataFrame, order_by: list, out: str = "position") -> DataFrame:
    """1-based position for a frame that came out of ``limit(k)``: at most k
    rows, so one ordered window partition is bounded by k."""
    return df.withColumn(out, F.row_number().over(Window.orderBy(*_cols(order_by))).cast("bigint"))


def top_k_share(
    df: DataFrame, value: str, key: str, k: int, out: str = "cumulative_pct", rank_out: str = "rank"
) -> DataFrame:
    """The k largest rows by ``value`` (ties by ``key``) with their running
    share of the grand total of *all* rows.

    The running sum of the i-th row only involves rows 1..i, which are all
    among the top k; so the work is a bounded top-k (TakeOrderedAndProject),
    one global sum (partial aggregates), and a window over k + 1 rows.
    """
    order = [F.col(value).desc(), F.col(key).asc()]
    top = df.orderBy(*order).limit(k).select(key, value, F.lit(False).alias("__total"))
    total = df.agg(F.sum(value).alias(value)).select(
        F.lit(None).cast(df.schema[key].dataType).alias(key), value, F.lit(True).alias("__total")
    )
    both = top.unionByName(total)
    # k + 1 rows: the total row sorts last by the flag
    w = Window.orderBy(F.col("__total").asc(), *order)
    run = F.sum(F.when(~F.col("__total"), F.col(value))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    grand = F.max(F.when(F.col("__total"), F.col(value))).over(Window.partitionBy())
    res = both.select(
        "*",
        F.round(F.lit(100.0) * run.cast("double") / grand.cast("double"), 2).alias(out),
        F.row_number().over(w).cast("bigint").alias(rank_out),
    )
    return res.filter(~F.col("__total")).drop("__total")


# E2 ------------------------------------------------------------------------------
def cumulative_share(
    df: DataFrame, value: str, key: str, out: str = "cumulative_pct", rank_out: str | None = None
) -> DataFrame:
    """Rows by ``value`` desc (ties by ``key``) with the running share of the
    total in percent, rounded to 2, and optionally the 1-based rank."""
    order = [F.col(value).desc(), F.col(key).asc()]
    sums = {"__cum": F.col(value)}
    if rank_out:
        sums[rank_out] = F.lit(1).cast("bigint")
    res = running_sums(df, order, sums, {"__all": "__cum"})
    res = res.withColumn(
        out, F.round(F.lit(100.0) * F.col("__cum").cast("double") / F.col("__all").cast("double"), 2)
    )
    return res.drop("__cum", "__all")


# E3 ------------------------------------------------------------------------------
def period_change(
    df: DataFrame, partition_by: list[str], order_by: list[str], value: str, prev_out: str, change_out: str
) -> DataFrame:
    w = Window.partitionBy(*partition_by).orderBy(*order_by)
    prev = F.lag(value).over(w)
    return df.withColumn(prev_out, prev).withColumn(change_out, F.col(value) - F.col(prev_out))
