"""Sinks: fact files (A4), full refresh (A6), append (A7, G1), insert-select.

A full refresh never overwrites the folder readers use: it writes a new
version folder and then points at it. The pointer is a numbered file that holds
the version's name and is created once; readers take the newest, so a failed
write leaves the old version in place and there is no moment without one.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wingspan import schemas as S
from wingspan.session import settings

POINTER = "_current"

#: Parquet options of large staged copies: packed well, in row groups that a reader holds whole without harm.
STAGED_FILES = {"compression": "zstd", "parquet.block.size": str(16 << 20)}


# A4 (Parquet) ---------------------------------------------------------------------
def write_fact_parquet(df: DataFrame, path: str, partitions: int | None = None, mode: str = "errorifexists",
                       clustered: bool = False, widen: Callable[[DataFrame], DataFrame] | None = None) -> str:
    """Partitioned by the year and month of flight_date, date-sorted within files.

    ``REBALANCE`` on the partition columns hashes rows by month and lets AQE
    size the write tasks from real shuffle sizes: small months are merged,
    a hot month is split over several tasks (no single writer gets a third
    of the data), and no separate sampling pass over the input is needed.
    ``partitions`` is accepted for callers that fix the shuffle width.

    ``widen`` adds columns to the rows after they were shuffled and sorted; it
    must keep the partition columns and move no row. ``clustered`` is for frames
    read from month folders (or of one date per task): their rows already stand
    together, so nothing is shuffled; scans are cut so small that a task sorts
    in memory. Rows in another order would only give more files.
    """
    year, month = S.FACT_PARTITION_COLUMNS
    df = df.withColumns({year: F.year("flight_date"), month: F.month("flight_date")})
    if clustered:
        out = df
    else:
        out = df.hint("rebalance", *S.FACT_PARTITION_COLUMNS) if partitions is None else df.repartition(
            partitions, *S.FACT_PARTITION_COLUMNS, F.pmod(F.xxhash64("flight_number"), F.lit(max(1, partitions // 12)))
        )
    out = out.sortWithinPartitions(*S.FACT_PARTITION_COLUMNS, "flight_date")
    with settings(df.sparkSession, {"spark.sql.files.maxPartitionBytes": SCAN_BYTES} if clustered else {}):
        _write_months(widen(out) if widen else out, path, mode)
    return path


#: Bytes of Parquet that a task reads where it sorts what it read: some 300 MB as rows of a fact.
SCAN_BYTES = "16m"


def _write_months(df: DataFrame, path: str, mode: str) -> None:
    writer = df.write.mode(mode).option("maxRecordsPerFile", 5_000_000).partitionBy(*S.FACT_PARTITION_COLUMNS)
    writer.parquet(path)


def write_fact_by_date(df: DataFrame, path: str, mode: str = "errorifexists") -> str:
    """``write_fact_parquet`` for a frame whose tasks hold one date each: neither shuffled nor sorted."""
    year, month = S.FACT_PARTITION_COLUMNS
    with settings(df.sparkSession, {"spark.sql.maxConcurrentOutputFileWriters": "32", "spark.sql.files.maxPartitionBytes": SCAN_BYTES}):
        _write_months(df.withColumns({year: F.year("flight_date"), month: F.month("flight_date")}), path, mode)
    return path


#: Rows that a task of ``write_fact_calendar`` holds and writes for every date.
CALENDAR_ROWS = 1 << 18


def _calendar_writer(folder: str, dates: list[dict]) -> Callable:
    """A task of ``write_fact_calendar``: for each date one file, complete when it gets its name."""

    def write(batches: Iterator) -> Iterator:
        import os

        import pyarrow as pa
        import pyarrow.parquet as pq
        from pyspark import TaskContext

        task, attempt, writers, rows = TaskContext.get().partitionId(), uuid.uuid4().hex[:12], {}, 0
        kinds = [("flight_date", pa.date32()), ("flight_year", pa.int32()), ("flight_month", pa.int32()), ("flight_quarter", pa.int32())]

        def flush(held: list) -> int:
            table = pa.Table.from_batches(held).combine_chunks()
            for i, field in enumerate(table.schema):  # once, not once a date
                if pa.types.is_string(field.type):
                    table = table.set_column(i, field.name, table[i].dictionary_encode())
            for at, day in enumerate(dates):
                dated = table
                for name, kind in kinds:
                    dated = dated.append_column(name, pa.repeat(pa.scalar(day[name], kind), table.num_rows))
                dated = dated.select(S.FACT_COLUMNS)
                if at not in writers:
                    year, month = S.FACT_PARTITION_COLUMNS
                    home = f"{folder}/{year}={day['flight_year']}/{month}={day['flight_month']}"
                    os.makedirs(home, exist_ok=True)
                    name = f"{home}/.{attempt}-{at}", f"{home}/part-{task:05d}-{day['flight_date']}.snappy.parquet"
                    writers[at] = (*name, pq.ParquetWriter(name[0], dated.schema, compression="snappy", store_decimal_as_integer=True, store_schema=False))
                writers[at][2].write_table(dated)
            return table.num_rows

        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= CALENDAR_ROWS:
                rows += flush(held)
                held, n = [], 0
        if n:
            rows += flush(held)
        for temporary, final, writer in writers.values():
            writer.close()
            os.replace(temporary, final)
        yield pa.RecordBatch.from_pydict({"rows": pa.array([rows * len(dates)], pa.int64())})

    return write


def write_fact_calendar(rows: DataFrame, dates: DataFrame, path: str) -> int:
    """Each of ``rows`` (the fact's columns without dates) once for every one of ``dates`` (its date columns, a row a date;
    few), as ``write_fact_by_date`` writes them; returns how many were written.

    A task turns its rows into columns once and writes these for all dates with Arrow, a tenth of the work of writing them
    row by row. Files stand below ``_temporary`` until all are there. Arrow writes to a local or mounted file system
    (``writes_calendar``).
    """
    spark = rows.sparkSession
    folder, fs = _fs(spark, path)
    fs.mkdirs(folder)
    days = [r.asDict() for r in dates.collect()]
    staged = f"{path}/_temporary"
    local = _fs(spark, staged)[0].toUri().getPath()
    with settings(spark, {"spark.sql.files.maxPartitionBytes": SCAN_BYTES}):
        written = rows.mapInArrow(_calendar_writer(local, days), "rows bigint").agg(F.sum("rows")).first()[0]
    home = _fs(spark, staged)[0]
    for year in fs.listStatus(home) if fs.exists(home) else []:
        if not fs.rename(year.getPath(), _fs(spark, f"{path}/{year.getPath().getName()}")[0]):
            raise OSError(f"{year.getPath()} could not be moved to {path}")
    fs.delete(home, True)
    fs.create(_fs(spark, f"{path}/_SUCCESS")[0]).close()
    return written or 0


def month_folders(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """The month folders of a written fact, with the bytes of their files."""
    (top, fs), (year, month) = _fs(spark, path), S.FACT_PARTITION_COLUMNS

    def below(folder, name: str) -> list:
        return sorted((f.getPath() for f in fs.listStatus(folder) if f.getPath().getName().startswith(f"{name}=")), key=str)

    return [(m.toString(), fs.getContentSummary(m).getLength()) for y in below(top, year) for m in below(y, month)]


def writes_calendar(spark: SparkSession, path: str) -> bool:
    """Whether ``write_fact_calendar`` can write to ``path``: a new folder that tasks reach as files."""
    folder, fs = _fs(spark, path)
    return fs.getUri().getScheme() == "file" and not fs.exists(folder)


# A4 (CSV, the reference's exchange format) ---------------------------------------------
def write_fact_csv(df: DataFrame, path: str, mode: str = "errorifexists", compression: str | None = None) -> str:
    """CSV with header, FACT column order, flag as 0/1.

    A quoted line break may stand in a record, so readers give a file to one task: the rows of a file are bounded.
    ``compression`` (``gzip``) makes files a tenth as large; Spark's reader takes them by their suffix."""
    out = df.select(
        *[
            F.col(c).cast("int").alias(c) if c == "codeshare" else F.col(c)
            for c in S.FACT_COLUMNS
        ]
    )
    writer = out.write.mode(mode).options(**S.CSV_KEEP_BLANKS).option("header", True).option("escape", '"')
    writer.option("maxRecordsPerFile", S.CHUNK_ROWS * 100).csv(path, compression=compression)
    return path


# A6 -------------------------------------------------------------------------------------
def publish_version(df: DataFrame, base: str, partition_by: list[str] | None = None,
                    suffix: str | None = None, write=None) -> str:
    """Full refresh: write ``base/v-<id>`` then add its pointer below ``base/_current``.

    A failed write leaves only an orphan version folder; readers keep the
    previous version. ``write(df, path)`` replaces the plain Parquet writer."""
    version = f"v-{uuid.uuid4().hex[:12]}" + (f"-{suffix}" if suffix else "")
    if write is not None:
        write(df, f"{base}/{version}")
    else:
        writer = df.write.mode("errorifexists")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(f"{base}/{version}")
    _point(df.sparkSession, base, version)
    return version


def _fs(spark: SparkSession, path: str):
    """Hadoop path and its file system (local, HDFS, object stores)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder and all below it, if it is there."""
    folder, fs = _fs(spark, path)
    fs.delete(folder, True)


def _pointers(spark: SparkSession, base: str) -> list[str]:
    folder, fs = _fs(spark, f"{base}/{POINTER}")
    if not fs.exists(folder):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(folder)]
    return sorted(n for n in names if not n.startswith((".", "_")))


def _point(spark: SparkSession, base: str, version: str) -> None:
    """Publish ``version``: the next free number's file is created, never overwritten, and holds the version's name.

    Of two publishers that want one number the second one's creation fails, and it takes the next."""
    fs = _fs(spark, base)[1]
    fs.mkdirs(_fs(spark, f"{base}/{POINTER}")[0])
    number = 0
    while True:
        held = _pointers(spark, base)
        number = max(number, int(held[-1].split("=")[0]) + 1 if held else 0)
        path = _fs(spark, f"{base}/{POINTER}/{number:012d}")[0]
        try:
            out = fs.create(path, False)
        except Py4JJavaError:
            if not fs.exists(path):
                raise
            number += 1  # someone else's
            continue
        out.write(version.encode())
        out.close()
        return


def current_version(spark: SparkSession, base: str) -> str | None:
    """The version of the newest pointer that is written to its end."""
    for name in reversed(_pointers(spark, base)):
        if "=" in name:  # the form of earlier tables: an empty file named after the version
            return name.split("=", 1)[1]
        path, fs = _fs(spark, f"{base}/{POINTER}/{name}")
        stream = fs.open(path)
        version = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        if version:
            return version
    return None


def read_current(spark: SparkSession, base: str, schema=None) -> DataFrame:
    version = current_version(spark, base)
    if version is None:
        raise FileNotFoundError(f"no published version below {base}")
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(f"{base}/{version}")


# A7 / G1 ----------------------------------------------------------------------------------
def append(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """Append rows after the existing ones, columns bound by name."""
    out = df.select(*columns) if columns else df
    out.write.mode("append").option("maxRecordsPerFile", S.CHUNK_ROWS * 100).parquet(path)


def union_by_name(target: DataFrame, changes: DataFrame) -> DataFrame:
    return target.unionByName(changes)


# A9 / P5 -------------------------------------------------------------------------------
def insert_select(source: DataFrame, path: str, transform) -> DataFrame:
    """Insert rows computed by a query over ``source`` into ``path``; returns them."""
    rows = transform(source)
    append(rows, path, columns=source.columns)
    return rows
