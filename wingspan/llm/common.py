"""Helpers shared by the operators: table access, checkpoints, Arrow streams, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wingspan.session import shared_dir

#: Rows of a batch that are turned into Python objects at a time.
SLICE_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def texts(batch: pa.RecordBatch, name: str = "text") -> Iterator[str | bytes | None]:
    """The values of a column, a bounded number of them as Python objects at a time."""
    column = batch.column(batch.schema.get_field_index(name))
    for at in range(0, len(column), SLICE_ROWS):
        yield from column.slice(at, SLICE_ROWS).to_pylist()


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str], least: int = 1) -> Iterator[dict[str, np.ndarray]]:
    """Groups of equal keys in a stream whose equal keys stand together, as arrays by column.

    Columns hold no nulls. Groups under ``least`` rows are passed over. Only the group that the end of a
    batch cuts is carried to the next one.
    """
    rest: dict[str, np.ndarray] | None = None
    for batch in batches:
        part = {n: batch.column(i).to_numpy(zero_copy_only=False) for i, n in enumerate(batch.schema.names)}
        if rest is not None:
            part = {n: np.concatenate([rest[n], v]) for n, v in part.items()}
        size = len(part[keys[0]])
        if not size:
            continue
        new = np.zeros(size, bool)
        for k in keys:
            new[1:] |= part[k][1:] != part[k][:-1]
        starts = np.flatnonzero(np.r_[True, new[1:]])
        ends = np.r_[starts[1:], size]
        full = np.flatnonzero(ends[:-1] - starts[:-1] >= least)
        for a, b in zip(starts[full].tolist(), ends[full].tolist(), strict=True):
            yield {n: v[a:b] for n, v in part.items()}
        rest = {n: v[starts[-1] :].copy() for n, v in part.items()}
    if rest is not None and len(rest[keys[0]]) >= least:
        yield rest


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected edges (a, b), both long and not null.

    Returns (node, root) for every node of an edge; root is the smallest node of its component. Alternates
    large-star and small-star steps: every node is tied to the smallest node it sees until nothing changes, so
    the edge set never grows past its first size plus the nodes. Each round is checkpointed in the shared folder.
    """
    star = cut(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    print_of = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    mark = print_of(star)
    while mark[0]:
        both = star.union(star.select("b", "a"))
        # the least neighbours are written out, so that each join stands right on two shuffles and Spark can split a hot node
        low = cut(both.groupBy("a").agg(F.least("a", F.min("b")).alias("low")))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        large = cut(large)
        low = cut(large.groupBy("a").agg(F.min("b").alias("low")))
        star = cut(
            large.join(low, "a")
            .select(F.explode(F.array(F.struct(F.col("a"), F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b")))).alias("e"))
            .select("e.a", "e.b")
            .filter("a <> b")
            .distinct()
        )
        if (now := print_of(star)) == mark:
            break
        mark = now
    return star.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        star.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
