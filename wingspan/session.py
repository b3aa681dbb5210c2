"""Session construction and the shared work folder.

Everything that must outlive a task (checkpoints, materialised tables,
streaming state) goes below the folder the cluster names in
``spark.checkpoint.dir``. Only a local-mode session without that setting
(tests, laptops) gets a private temporary folder.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

_LOCAL_FALLBACK: dict[str, str] = {}


def build_session(
    master: str = "local[8]",
    app: str = "wingspan",
    shuffle_partitions: int = 8,
    driver_memory: str = "8g",
    extra: dict[str, str] | None = None,
) -> SparkSession:
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        # size post-shuffle partitions by the advisory size, not by core count:
        # fewer tiny tasks on a busy cluster (neutral on local[8])
        .config("spark.sql.adaptive.coalescePartitions.parallelismFirst", "false")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", driver_memory)
        .config("spark.sql.parquet.filterPushdown", "true")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    shared_dir(spark)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder shared by driver and executors (``spark.checkpoint.dir``).

    Read from the session; a private temporary folder is created only for a
    local-mode session where the setting is absent.
    """
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(configured)
        return configured.rstrip("/")
    current = sc.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set: a cluster run needs a shared folder for "
            "checkpoints and materialised tables"
        )
    key = sc.applicationId
    if key not in _LOCAL_FALLBACK:
        _LOCAL_FALLBACK[key] = tempfile.mkdtemp(prefix="wingspan-shared-")
        sc.setCheckpointDir(_LOCAL_FALLBACK[key])
    return _LOCAL_FALLBACK[key]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, never reused folder below the shared folder."""
    return f"{shared_dir(spark)}/wingspan-work/{name}-{uuid.uuid4().hex[:12]}"


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "8"))


#: Shuffle files go when the job that wrote them ends, not when the driver's garbage collector finds them unused.
FREED = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
#: Bytes of shuffle that a task of a large staged copy takes: files large enough that a feed of them is one micro-batch.
STAGED = FREED | {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "32m"}


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for the jobs that run inside, put back afterwards."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
