"""Sort, top-k, recent-N and sampling (F1-F8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _cols(cols) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def top_k(df: DataFrame, k: int, order_by: list) -> DataFrame:
    """``ORDER BY ... LIMIT k``; planned as TakeOrderedAndProject, which keeps
    k rows per partition and merges, so memory is bounded by k."""
    return df.orderBy(*_cols(order_by)).limit(k)


def recent_n(df: DataFrame, n: int, ts_col: str, tiebreak: str) -> DataFrame:
    return top_k(df, n, [F.col(ts_col).desc(), F.col(tiebreak).desc()])


def draw(columns: list[str], seed: int = 17) -> Column:
    """A row's place in the draw: the MD5 of the seed and its values as text, so it depends on nothing else."""
    told = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("null")) for c in columns]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *told).cast("binary"))


def sample_n(df: DataFrame, n: int, seed: int = 17) -> DataFrame:
    """Exactly ``n`` rows (all rows if fewer), drawn by the seed: those of the smallest ``draw``.

    The same rows however they are dealt to partitions, on every run and retry; samples of parts can be merged by
    drawing again from their union. Rows equal in every column have one place, and come together. Bounded by n a task."""
    return df.withColumn("__r", draw(df.columns, seed)).orderBy("__r").limit(n).drop("__r")
