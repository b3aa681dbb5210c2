"""Change counts by window without a state store.

Each micro-batch is reduced to one row for each window that it touches (count, earliest, latest) and written to its own
folder, in overwrite mode, so a replayed batch replaces itself. Counts add up and the ends take the least and the
largest, so readers merge the partial rows of all batches: no row is late, nothing stays in memory between batches, and
the answer does not depend on how the feed was cut.

Changes without a time belong to no window. A feed that brought nothing gives no window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wingspan.sources.sinks import publish_version, read_current
from wingspan.streaming import sync

PARTIAL = "window struct<start: timestamp, end: timestamp>, new_records bigint, earliest timestamp, latest timestamp"


def partial_counts(changes: DataFrame, updated_at: str, minutes: int = 1) -> DataFrame:
    """(window, new_records, earliest, latest) of the rows at hand."""
    at = F.col(f"`{updated_at}`").cast("timestamp").alias("__at")
    return changes.select(at).groupBy(F.window("__at", f"{int(minutes)} minutes")).agg(
        F.count(F.lit(1)).alias("new_records"), F.min("__at").alias("earliest"), F.max("__at").alias("latest")
    )


def merged_counts(partials: DataFrame) -> DataFrame:
    """One row for each window out of partial rows."""
    return partials.groupBy("window").agg(
        F.sum("new_records").cast("bigint").alias("new_records"), F.min("earliest").alias("earliest"), F.max("latest").alias("latest")
    )


def start(
    changes: DataFrame, updated_at: str, target: str, checkpoint: str, minutes: int = 1, interval_seconds: int | None = None
) -> StreamingQuery:
    """Write the partial counts of every micro-batch: once over what is there, or every ``interval_seconds``.

    The stream itself has no stateful operator. A target that holds batches needs their own checkpoint."""
    spark = changes.sparkSession
    if sync._exists(spark, f"{target}/{sync.CHANGES}") and not sync._exists(spark, checkpoint):
        raise ValueError(f"{target} holds batches of another checkpoint than {checkpoint}")
    spark.createDataFrame([], PARTIAL).write.mode("overwrite").parquet(f"{target}/{sync.SCHEMA}")
    put = sync.batch_writer(target)

    def write(batch: DataFrame, batch_id: int) -> None:
        put(partial_counts(batch, updated_at, minutes), batch_id)

    writer = changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if interval_seconds is None else writer.trigger(processingTime=f"{int(interval_seconds)} seconds")
    return writer.start()


def _partials(spark: SparkSession, target: str) -> DataFrame:
    """The folded partial rows, if any, and those of later batches."""
    rows, upto = sync.synced_changes(spark, target), sync.compacted_upto(spark, target)
    if upto is None:
        return rows.drop("batch_id")
    folded = read_current(spark, f"{target}/{sync.COMPACTED}")
    return folded.unionByName(rows.filter(F.col("batch_id") > upto).drop("batch_id"))


def counts(spark: SparkSession, target: str) -> DataFrame:
    """(window_start, window_end, new_records, earliest, latest) over all batches written so far."""
    return merged_counts(_partials(spark, target)).select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "new_records", "earliest", "latest"
    )


def fold(spark: SparkSession, target: str) -> str:
    """Merge the batches so far into one row for each window, so that readers need the later batches only."""
    upto = sync.synced_changes(spark, target).agg(F.max("batch_id")).first()[0]
    if upto is None:
        raise ValueError("nothing to fold")
    rows, prior = sync.synced_changes(spark, target).filter(F.col("batch_id") <= upto), sync.compacted_upto(spark, target)
    if prior is not None:
        rows = read_current(spark, f"{target}/{sync.COMPACTED}").unionByName(rows.filter(F.col("batch_id") > prior).drop("batch_id"))
    return publish_version(merged_counts(rows), f"{target}/{sync.COMPACTED}", suffix=f"upto-{int(upto)}")
