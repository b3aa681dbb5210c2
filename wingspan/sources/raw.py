"""Readers for the raw delimited files (A1-A3), the fact CSV (A5) and the
change CSV (A8).

Raw files: no header, comma separated, ``\\N`` for null, quotes doubled,
backslash is data. The reference's reader also nulls its default NA tokens
(``NA``, ``null``, empty ...); Spark's ``nullValue`` takes one token, so one
``when(isin)`` pass over string columns does the rest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wingspan import schemas as S
from wingspan.functions.exprs import null_tokens

RAW_OPTIONS = {"header": "false", "sep": ",", "nullValue": "\\N", "escape": '"', "quote": '"',
               "mode": "PERMISSIVE"}
# Where a quoted line break may stand inside a record (``multi_line``), a file is
# read by one task, so writers bound the rows of a file.
MAX_RECORDS_PER_FILE = 1_000_000


def _null_string_tokens(df: DataFrame) -> DataFrame:
    return df.select(
        *[
            null_tokens(f.name).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def read_raw(spark: SparkSession, path: str, schema: T.StructType, multi_line: bool = False) -> DataFrame:
    """``multi_line`` for the small files whose text may hold line breaks; large
    files (routes: codes and numbers only) stay splittable."""
    return _null_string_tokens(spark.read.options(**RAW_OPTIONS).option("multiLine", multi_line).schema(schema).csv(path))


def write_raw(df: DataFrame, path: str) -> str:
    """Write a frame in the raw file format (used to stage test inputs)."""
    (
        df.write.mode("errorifexists")
        .options(header="false", sep=",", nullValue="\\N", escape='"', quote='"', **S.CSV_KEEP_BLANKS)
        .option("maxRecordsPerFile", MAX_RECORDS_PER_FILE)
        .csv(path)
    )
    return path


# A1 -------------------------------------------------------------------------------
def read_airports(spark: SparkSession, path: str, keep_all: bool = False) -> DataFrame:
    """Airports with a code and of type ``airport`` (``keep_all`` skips the filter)."""
    df = read_raw(spark, path, S.AIRPORTS, multi_line=True)
    if keep_all:
        return df
    return df.filter(F.col("iata_code").isNotNull() & (F.col("type") == "airport"))


FILE_ORDER = "file_order"


def with_file_order(df: DataFrame) -> DataFrame:
    """Add ``file_order``: the row's position in its files, exact under any
    split. Computed on the scan itself: (file name, start of the split, row id)
    - rows of one split keep file order and share a partition, whatever order
    Spark packs splits into partitions."""
    return df.withColumn(
        FILE_ORDER,
        F.struct(
            F.input_file_name().alias("file"),
            F.input_file_block_start().alias("offset"),
            F.monotonically_increasing_id().alias("row"),
        ),
    )


# A2 -------------------------------------------------------------------------------
def read_airlines(spark: SparkSession, path: str, keep_all: bool = False, file_order: bool = True,
                  multi_line: bool = True) -> DataFrame:
    """Airlines (active ones unless ``keep_all``); with ``file_order`` a
    ``file_order`` column keeps each row's position for keep-first (E1)."""
    df = read_raw(spark, path, S.AIRLINES, multi_line)
    if file_order:
        df = with_file_order(df)
    return df if keep_all else df.filter(F.col("active") == "Y")


# A3 -------------------------------------------------------------------------------
def read_routes(spark: SparkSession, path: str) -> DataFrame:
    return read_raw(spark, path, S.ROUTES)


# A5 -------------------------------------------------------------------------------
FACT_CSV_OPTIONS = {"header": "true", "escape": '"', "multiLine": "true"}


def read_fact_csv(spark: SparkSession, path: str) -> DataFrame:
    """Enriched fact CSV with header. The schema is listed in file order; the
    flag is read as 0/1 and cast (``boolean`` would turn 0/1 into null)."""
    df = spark.read.options(**FACT_CSV_OPTIONS).schema(S.FACT_CSV).csv(path)
    return df.withColumn("codeshare", F.col("codeshare").cast("boolean"))


# A8 -------------------------------------------------------------------------------
# Times are written to the microsecond and read with any fraction or none.
CHANGE_CSV_OPTIONS = {"header": "false", "sep": ",", "escape": '"'}
_WRITE_TIMES = {"timestampFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS", "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS"}
_READ_TIMES = {"timestampFormat": "yyyy-MM-dd HH:mm:ss[.SSSSSS]", "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss[.SSSSSS]"}
CORRUPT = "_unparsed"


class UnparsedRowsError(ValueError):
    pass


def write_change_csv(df: DataFrame, path: str) -> str:
    """Headerless change rows, flags as 0/1, timestamps at microsecond precision."""
    flags = [F.col(f.name).cast("int").alias(f.name) if isinstance(f.dataType, T.BooleanType) else F.col(f.name)
             for f in df.schema.fields]
    out = df.select(*flags).write.mode("errorifexists").option("maxRecordsPerFile", MAX_RECORDS_PER_FILE)
    out.options(**CHANGE_CSV_OPTIONS, **_WRITE_TIMES, **S.CSV_KEEP_BLANKS).csv(path)
    return path


def read_change_csv(spark: SparkSession, path: str, schema: T.StructType = S.FACT_WITH_AUDIT) -> DataFrame:
    """Headerless comma-separated change rows (the bulk-load format): flags as
    0/1, times to the second or finer. A row that does not parse fails the read
    (``UnparsedRowsError``) instead of turning into nulls; the check reads the
    files once."""
    stored = [T.StructField(f.name, T.IntegerType()) if isinstance(f.dataType, T.BooleanType) else f for f in schema.fields]
    reader = spark.read.options(**CHANGE_CSV_OPTIONS, **_READ_TIMES).option("multiLine", True)
    reader = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
    rows = reader.schema(T.StructType([*stored, T.StructField(CORRUPT, T.StringType())])).csv(path)
    bad = rows.select(CORRUPT, *[f.name for f in stored]).filter(F.col(CORRUPT).isNotNull()).limit(3).collect()
    if bad:
        raise UnparsedRowsError(f"{path}: rows that do not parse, e.g. {[r[CORRUPT] for r in bad]}")
    return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
