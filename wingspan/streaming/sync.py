"""Incremental sync of an analytical copy from a change feed.

The feed is a folder of change files (Parquet or CSV). A Structured
Streaming file source tracks which files were consumed in its checkpoint,
so no clock-based high-water mark is kept in memory and nothing is skipped
or reloaded after a restart. Each micro-batch is written by ``foreachBatch``
to its own folder ``changes/batch_id=<id>`` in overwrite mode: a replayed
batch rewrites exactly its own folder, so the sink is idempotent.

Readers see the current state: the latest row per key over all batches
(E4), ordered by ``updated_at``, then batch id, then a tie-break column.
Updates never become duplicates; ``compact`` rewrites the current state to
a new version folder and points at it. A feed that brought nothing gives an
empty state and counters of zero.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from wingspan import schemas as S
from wingspan.functions.exprs import ts_literal
from wingspan.operators.windows import latest_per_key
from wingspan.session import FREED, settings
from wingspan.sources.sinks import STAGED_FILES, _fs, current_version, publish_version, read_current

CHANGES = "changes"
METRICS = "metrics"
SCHEMA = "schema"
COMPACTED = "compacted"


def change_stream(
    spark: SparkSession,
    source: str,
    schema: StructType,
    fmt: str = "parquet",
    glob: str | None = None,
    max_files_per_trigger: int | None = 1000,
    options: dict | None = None,
) -> DataFrame:
    """The change feed as a streaming DataFrame (declared schema). A
    backlog is taken in micro-batches of at most ``max_files_per_trigger`` files."""
    reader = spark.readStream.format(fmt).schema(schema).options(**(options or {}))
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if max_files_per_trigger:
        # I4: paced backfill, a bounded number of files per micro-batch
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return reader.load(source)


def batch_writer(target: str):
    """foreachBatch sink: one overwrite folder per batch id, plus a metrics row."""

    def write(batch: DataFrame, batch_id: int) -> None:
        # written once, in one pass; the row count comes from Parquet footers
        spark = batch.sparkSession
        folder = f"{target}/{CHANGES}/batch_id={batch_id}"
        with settings(spark, FREED):
            batch.write.mode("overwrite").options(**STAGED_FILES).parquet(folder)
        rows = spark.read.schema(batch.schema).parquet(folder).count()
        if not rows:  # I5: an empty batch leaves nothing behind
            path, fs = _fs(spark, folder)
            fs.delete(path, True)
            parent = path.getParent()
            if not fs.listStatus(parent):
                fs.delete(parent, True)
            return
        spark.createDataFrame([(int(batch_id), int(rows))], "batch bigint, rows bigint").coalesce(1).write.mode(
            "overwrite"
        ).parquet(f"{target}/{METRICS}/batch_id={batch_id}")

    return write


def start_sync(
    changes: DataFrame,
    target: str,
    checkpoint: str,
    interval_seconds: int | None = None,
    query_name: str | None = None,
) -> StreamingQuery:
    """Start the sync: ``interval_seconds=None`` runs once over everything
    available and stops (I2); a number runs continuously on that trigger (I3).
    A target that holds batches needs the checkpoint they were written with:
    another one would count batches from 0 again and overwrite them."""
    spark = changes.sparkSession
    if _exists(spark, f"{target}/{CHANGES}") and not _exists(spark, checkpoint):
        raise ValueError(f"{target} holds batches of another checkpoint than {checkpoint}")
    spark.createDataFrame([], changes.schema).write.mode("overwrite").parquet(f"{target}/{SCHEMA}")
    writer = changes.writeStream.foreachBatch(batch_writer(target)).option("checkpointLocation", checkpoint)
    if query_name:
        writer = writer.queryName(query_name)
    if interval_seconds is None:
        writer = writer.trigger(availableNow=True)
    else:
        writer = writer.trigger(processingTime=f"{int(interval_seconds)} seconds")
    return writer.start()


def run_continuous(changes: DataFrame, target: str, checkpoint: str,
                   interval_seconds: int = S.SYNC_INTERVAL_SECONDS) -> StreamingQuery:
    """Keep syncing every ``interval_seconds`` (default 300, as the reference)."""
    return start_sync(changes, target, checkpoint, interval_seconds=interval_seconds)


def sync_once(changes: DataFrame, target: str, checkpoint: str) -> None:
    q = start_sync(changes, target, checkpoint)
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))


def synced_changes(spark: SparkSession, target: str) -> DataFrame:
    """All synced change rows with their ``batch_id``."""
    if _exists(spark, f"{target}/{CHANGES}"):
        return spark.read.parquet(f"{target}/{CHANGES}")
    return spark.read.parquet(f"{target}/{SCHEMA}").withColumn("batch_id", F.lit(0)).filter("false")


def _exists(spark: SparkSession, path: str) -> bool:
    p, fs = _fs(spark, path)
    return fs.exists(p)


def current_state(
    spark: SparkSession, target: str, keys: list[str], updated_at: str, tiebreak: list[str] | None = None,
    columns: list[str] | None = None,
) -> DataFrame:
    """Latest row per key over the compacted snapshot (if any) and the
    batches written after it; a reader never rescans compacted batches.

    With ``columns`` (keys, ``updated_at`` or tie-break columns) the others are
    neither read nor shuffled: they decide no row that these would tell apart."""
    order = [updated_at, "batch_id", *(tiebreak or [])]
    upto = compacted_upto(spark, target)
    rows = synced_changes(spark, target)
    if upto is not None:
        snapshot = read_current(spark, f"{target}/{COMPACTED}")
        rows = snapshot.unionByName(rows.filter(F.col("batch_id") > upto))
    if columns is not None:
        if other := set(columns) - {*keys, *order}:
            raise ValueError(f"neither keys nor in the order: {sorted(other)}")
        rows = rows.select(*dict.fromkeys([*keys, *order]))
        return latest_per_key(rows, keys, order).select(*columns)
    return latest_per_key(rows, keys, order).drop("batch_id")


def sync_counters(spark: SparkSession, target: str) -> DataFrame:
    """One row: batches written and rows synced in total."""
    if not _exists(spark, f"{target}/{METRICS}"):
        return spark.createDataFrame([(0, 0)], "batches bigint, rows_synced bigint")
    m = spark.read.parquet(f"{target}/{METRICS}")
    return m.agg(
        F.countDistinct("batch").alias("batches"),
        F.coalesce(F.sum("rows"), F.lit(0)).cast("bigint").alias("rows_synced"),
    )


def compacted_upto(spark: SparkSession, target: str) -> int | None:
    """Highest batch id folded into the current compacted snapshot."""
    version = current_version(spark, f"{target}/{COMPACTED}")
    return int(version.rsplit("-upto-", 1)[1]) if version else None


def compact(spark: SparkSession, target: str, keys: list[str], updated_at: str,
            tiebreak: list[str] | None = None) -> str:
    """Fold all batches written so far into a new snapshot version (keeping
    each row's batch id for later ordering) and switch the pointer."""
    upto = synced_changes(spark, target).agg(F.max("batch_id")).first()[0]
    if upto is None:
        raise ValueError("nothing to compact")
    order = [updated_at, "batch_id", *(tiebreak or [])]
    rows = synced_changes(spark, target).filter(F.col("batch_id") <= upto)
    prior = compacted_upto(spark, target)
    if prior is not None:
        rows = read_current(spark, f"{target}/{COMPACTED}").unionByName(rows.filter(F.col("batch_id") > prior))
    state = latest_per_key(rows, keys, order)
    return publish_version(state, f"{target}/{COMPACTED}", suffix=f"upto-{int(upto)}")


def read_compacted(spark: SparkSession, target: str) -> DataFrame:
    return read_current(spark, f"{target}/{COMPACTED}").drop("batch_id")


# I7 --------------------------------------------------------------------------------------
def change_window_report(changes: DataFrame, updated_at: str, as_of_ts, minutes: int = 1) -> DataFrame:
    """Count, earliest and latest change time since ``as_of_ts - minutes``."""
    start = ts_literal(as_of_ts, changes.schema[updated_at].dataType) - F.expr(f"INTERVAL {int(minutes)} MINUTES")
    recent = changes.filter(F.col(updated_at) >= start)
    return recent.agg(
        F.count(F.lit(1)).alias("new_records"),
        F.min(updated_at).alias("earliest"),
        F.max(updated_at).alias("latest"),
    )


def windowed_change_counts(changes: DataFrame, updated_at: str, minutes: int = 1,
                           watermark_minutes: int | None = None) -> DataFrame:
    """Streaming form of I7: changes per event-time window.

    By default every row counts, however late: the result is the same for any
    split of the feed, and the state is one small row per window. With a
    watermark Spark drops the state of old windows, and rows that come later.

    Watermarks need an instant type: a ``timestamp_ntz`` column is read as a
    session-time-zone instant (minute windows and printed values unchanged)."""
    if changes.schema[updated_at].dataType.typeName() == "timestamp_ntz":
        changes = changes.withColumn(updated_at, F.col(updated_at).cast("timestamp"))
    if watermark_minutes is not None:
        changes = changes.withWatermark(updated_at, f"{int(watermark_minutes)} minutes")
    return (
        changes.groupBy(F.window(updated_at, f"{int(minutes)} minutes"))
        .agg(F.count(F.lit(1)).alias("new_records"), F.min(updated_at).alias("earliest"),
             F.max(updated_at).alias("latest"))
    )


def sync_windowed_counts(
    changes: DataFrame, updated_at: str, target: str, checkpoint: str, minutes: int = 1,
    watermark_minutes: int | None = None, interval_seconds: int | None = None,
) -> StreamingQuery:
    """I7 as a stream: per-window change counts in update mode.

    Each micro-batch carries the windows it changed (full running values);
    a watermark, if given, lets Spark drop the state of windows older than it.
    Batches land in their own folders, so readers take the latest version of
    each window (``windowed_counts_state``)."""
    counts = windowed_change_counts(changes, updated_at, minutes, watermark_minutes)
    writer = (
        counts.writeStream.outputMode("update")
        .foreachBatch(batch_writer(target))
        .option("checkpointLocation", checkpoint)
    )
    writer = writer.trigger(availableNow=True) if interval_seconds is None else writer.trigger(
        processingTime=f"{int(interval_seconds)} seconds")
    return writer.start()


def windowed_counts_state(spark: SparkSession, target: str) -> DataFrame:
    """Latest value of every window written by ``sync_windowed_counts``."""
    rows = synced_changes(spark, target)
    latest = latest_per_key(rows, ["window"], ["batch_id"]).drop("batch_id")
    return latest.select(
        F.col("window.start").alias("window_start"),
        F.col("window.end").alias("window_end"),
        "new_records",
        "earliest",
        "latest",
    )

