"""A copy that is merged as it is written (E4, P4): hash-bucketed copy-on-write.

``sync.current_state`` reduces the snapshot and all newer batches each time it is read. Here every micro-batch is merged
when it comes: keys hash to a fixed number of buckets, the batch's rows meet the rows of the buckets they fall into, the
latest row of each key is written anew, and a manifest names the folder that now holds each bucket. Buckets without
changes are neither read nor written, and readers just read the folders of the manifest.

A batch is first written by bucket, without a shuffle. Then buckets are merged a few at a time, so much as ``GROUP_BYTES``
of files, each row shuffled once; what a group shuffled and its incoming files go before the next group begins.

A manifest is published as a version (``sinks.publish_version``): before that readers see the state before the batch,
after it the state with it, never a mixture. It also names the batch, so a replayed batch is passed over and a failed one
leaves only unnamed files, which ``vacuum`` removes. One writer at a time, as a streaming query has.

Null keys are keys like others: rows with equal keys, nulls included, are one key. Of rows with equal ``updated_at`` the
later batch wins, then the tie-break columns. Choose ``buckets`` so that one is some hundred MB; it is fixed with the first
batch.
"""

from __future__ import annotations

import uuid

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from wingspan.operators.windows import latest_per_key
from wingspan.session import STAGED, settings
from wingspan.sources.sinks import STAGED_FILES, _fs, current_version, publish_version, read_current, remove

BUCKET = "__bucket"
BATCH = "__batch"
_MANIFEST = "bucket int, folder string, batch long, buckets int"
#: Bytes of files, old and incoming, that are merged at a time: one bucket at least.
GROUP_BYTES = 512 << 20
#: Files that a task keeps open while it writes by bucket; with more buckets it sorts its rows.
OPEN_FILES = 32


def bucket_of(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def manifest(spark: SparkSession, base: str) -> dict[int, tuple[str, int, int]]:
    """bucket -> (folder, the last batch merged, number of buckets); -1 stands for the copy as a whole."""
    if current_version(spark, f"{base}/manifest") is None:
        return {}
    return {r.bucket: (r.folder, r.batch, r.buckets) for r in read_current(spark, f"{base}/manifest").collect()}  # a row a bucket


def _groups(sizes: dict[int, int], most: int) -> Iterator[list[int]]:
    """The buckets in groups of at most so many bytes, or of one bucket."""
    group, held = [], 0
    for b, n in sorted(sizes.items()):
        if group and held + n > most:
            yield group
            group, held = [], 0
        group.append(b)
        held += n
    if group:
        yield group


def _stored(schema: StructType) -> StructType:
    return StructType([*schema.fields, StructField(BATCH, LongType()), StructField(BUCKET, IntegerType())])


def _read(spark: SparkSession, base: str, held: dict[int, tuple[str, int, int]], buckets, schema: StructType) -> DataFrame:  # noqa: ANN001
    """Rows of these buckets: each folder is read with the buckets that the manifest gives to it."""
    paths = [f"{base}/files/{held[b][0]}/{BUCKET}={b}" for b in sorted(buckets) if b in held]
    fields = StructType(_stored(schema).fields[:-1])
    return spark.read.schema(fields).parquet(*paths) if paths else spark.createDataFrame([], fields)


def merge_batch(batch: DataFrame, batch_id: int, base: str, keys: list[str], updated_at: str, ties: list[str] | None = None, buckets: int = 64) -> list[int]:
    """Merge one batch into the copy below ``base``; returns the buckets it touched. A batch merged before is passed over."""
    spark = batch.sparkSession
    held = manifest(spark, base)
    _, done, buckets = held.get(-1, ("", -1, buckets))
    if batch_id <= done:
        return []
    rows = batch.withColumns({BATCH: F.lit(batch_id).cast("long"), BUCKET: bucket_of(keys, buckets)})
    order = [updated_at, BATCH, *(ties or [])]
    folder = f"batch-{batch_id}-{uuid.uuid4().hex[:12]}"
    own, fields = f"{base}/incoming/{folder}", StructType(_stored(batch.schema).fields[:-1])
    with settings(spark, STAGED | {"spark.sql.maxConcurrentOutputFileWriters": str(OPEN_FILES)}):
        rows.write.options(**STAGED_FILES).partitionBy(BUCKET).parquet(own)  # one pass over the source
    path, fs = _fs(spark, own)
    found = [p for p in (f.getPath().getName() for f in fs.listStatus(path)) if p.startswith(BUCKET)]  # ``buckets`` at most
    touched = sorted(int(p.split("=")[1]) for p in found)
    sizes = {}
    for b in touched:
        folders = [f"{own}/{BUCKET}={b}", *([f"{base}/files/{held[b][0]}/{BUCKET}={b}"] if b in held else [])]
        sizes[b] = sum(fs.getContentSummary(_fs(spark, f)[0]).getLength() for f in folders)
    for group in _groups(sizes, GROUP_BYTES):
        state = spark.read.schema(fields).parquet(*[f"{own}/{BUCKET}={b}" for b in group])
        if any(b in held for b in group):  # buckets that are new hold nothing to meet
            state = _read(spark, base, held, group, batch.schema).unionByName(state)
        # reduced within each task first, so a hot key is a row a task; a group's tasks write where they reduced
        state = latest_per_key(state.withColumn(BUCKET, bucket_of(keys, buckets)), [BUCKET, *keys], order)
        with settings(spark, STAGED):
            writer = state.write.mode("append").option("maxRecordsPerFile", 5_000_000).options(**STAGED_FILES)
            writer.partitionBy(BUCKET).parquet(f"{base}/files/{folder}")
        for b in group:
            remove(spark, f"{own}/{BUCKET}={b}")
    new = {b: (f, n, buckets) for b, (f, n, _) in held.items() if b >= 0} | {b: (folder, batch_id, buckets) for b in touched}
    new[-1] = ("", batch_id, buckets)
    publish_version(spark.createDataFrame([(b, *x) for b, x in sorted(new.items())], _MANIFEST).coalesce(1), f"{base}/manifest")
    remove(spark, own)
    return touched


def read_merged(spark: SparkSession, base: str, schema: StructType) -> DataFrame:
    """The current state: one row a key, as it was read (``schema`` as of the changes)."""
    held = manifest(spark, base)
    return _read(spark, base, held, [b for b in held if b >= 0], schema).drop(BATCH)


def sync_merged(
    changes: DataFrame, base: str, checkpoint: str, keys: list[str], updated_at: str, ties: list[str] | None = None, buckets: int = 64, interval_seconds: int | None = None
) -> StreamingQuery:
    """Keep the copy below ``base`` in step with a change stream: once over what there is, or on an interval."""

    def write(batch: DataFrame, batch_id: int) -> None:
        merge_batch(batch, batch_id, base, keys, updated_at, ties, buckets)

    writer = changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if interval_seconds is None else {"processingTime": f"{int(interval_seconds)} seconds"}
    return writer.trigger(**trigger).start()


def vacuum(spark: SparkSession, base: str) -> list[str]:
    """Delete the bucket folders that the current manifest doesn't name, once no reader of an older one is left."""
    held = manifest(spark, base)
    named = {f"{f}/{BUCKET}={b}" for b, (f, _, _) in held.items() if b >= 0}
    files, fs = _fs(spark, f"{base}/files")
    gone = []
    for folder in fs.listStatus(files) if fs.exists(files) else []:
        batch, kept = folder.getPath().getName(), 0
        for part in fs.listStatus(folder.getPath()):
            name = part.getPath().getName()
            if name.startswith(BUCKET) and f"{batch}/{name}" not in named:
                fs.delete(part.getPath(), True)
                gone.append(f"{batch}/{name}")
            kept += name.startswith(BUCKET) and f"{batch}/{name}" in named
        if not kept:
            fs.delete(folder.getPath(), True)
    return sorted(gone)
