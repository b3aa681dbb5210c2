"""Storage profile of a file-backed table (A11) and layout comparison.

Sizes come from the hidden ``_metadata`` column of file sources (path,
size, modification time per file), aggregated per distinct file on the
executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wingspan.functions.exprs import bytes_to_mb, safe_ratio


def table_profile(spark: SparkSession, path: str, fmt: str = "parquet", layout: str | None = None,
                  schema=None, options: dict | None = None) -> DataFrame:
    """One row: layout, row_count, files, total_mb, create_time, update_time."""
    reader = spark.read.format(fmt).options(**(options or {}))
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.load(path)
    per_file = df.groupBy(
        "_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time"
    ).agg(F.count(F.lit(1)).alias("rows"))
    totals = per_file.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).cast("bigint").alias("row_count"),
        F.count(F.lit(1)).alias("files"),
        F.coalesce(F.sum("file_size"), F.lit(0)).alias("total_bytes"),
        F.min("file_modification_time").alias("create_time"),
        F.max("file_modification_time").alias("update_time"),
    )
    return totals.select(
        F.lit(layout or fmt).alias("layout"),
        "row_count",
        "files",
        bytes_to_mb("total_bytes").alias("total_mb"),
        "create_time",
        "update_time",
    )


def compare_storage(row_profile: DataFrame, col_profile: DataFrame) -> DataFrame:
    """Two one-row profiles side by side with ``compression_ratio =
    row_total_mb / col_total_mb`` (0 when the columnar copy is empty)."""
    fields = [c for c in row_profile.columns]
    both = row_profile.withColumn("__side", F.lit("row")).unionByName(
        col_profile.withColumn("__side", F.lit("col"))
    )
    picked = both.agg(
        *[F.max(F.when(F.col("__side") == side, F.col(c))).alias(f"{side}_{c}")
          for side in ("row", "col") for c in fields]
    )
    return picked.withColumn(
        "compression_ratio", F.round(safe_ratio("row_total_mb", "col_total_mb", 0.0), 2)
    )
