"""The ``flights`` fact derived from the provided TPC-H-style tables.

One fact row per ``lineitem`` row:

* airline = supplier, origin airport = the supplier's own, destination airport
  = the ordering customer's own, so hubs and routes grow with the data;
* city, country, region, latitude and longitude are those of their nations,
  distance is the great-circle distance between these;
* seats = 10 x quantity, aircraft = part type, codeshare = returned line,
  stops = line number - 1, flight date = ship date.

At scale ``lineitem`` is the only large input. The plan joins ``orders`` to
``customer`` first (orders-sized), then ``lineitem`` to that on the order key,
then to ``supplier`` and ``part``. These joins carry no hint: Spark broadcasts a
side only when its real size is under ``spark.sql.autoBroadcastJoinThreshold``
(AQE re-plans from shuffle sizes) and splits skewed partitions otherwise. Only
the geography (nation x region, 25 rows by definition) is hinted. Suppliers come
last, so rows leave the joins in order of supplier, from which half of their
columns follow, and files pack them well. Large tables are built in slices of order keys, one after the other:
a slice's shuffle files go before the next begins. What follows
from a line's keys (codes, cities, coordinates, distance) is added after the last
shuffle, so shuffles and sorts move narrow rows.

The fact is materialised once per input set as Parquet partitioned by
the year and month of its date below the shared folder; named queries read it
with partition pruning, as the reference reads its column-store copy.
"""

from __future__ import annotations

import hashlib
import inspect
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wingspan import schemas as S
from wingspan.functions import exprs as X
from wingspan.session import FREED, STAGED, settings, shared_dir
from wingspan.sources.sinks import STAGED_FILES, _fs, current_version, publish_version, write_fact_parquet

#: Bytes of line item files that a slice of a build takes, and how many slices there are at most.
SLICE_BYTES = 512 << 20
MOST_SLICES = 4

_ROLLUPS: set[str] = set()
_MATERIALISED: dict[tuple[str, str], str] = {}
_FRAMES: dict[tuple[str, str], DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def geography(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nation key -> name, region, latitude, longitude (dimension-sized)."""
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    nk = F.col("n_nationkey")
    return nation.join(
        F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey")
    ).select(
        nk.alias("nk"),
        F.col("n_name").alias("name"),
        F.col("r_name").alias("region"),
        (nk * F.lit(3.0) - 36).cast("decimal(10,6)").alias("lat"),
        (nk * F.lit(5.0) - 60).cast("decimal(10,6)").alias("lon"),
    )


def airport_code(kind: str, key) -> "F.Column":
    return F.concat(F.lit(kind), F.lpad(key.cast("string"), 6, "0"))


def slices(spark: SparkSession, sf_dir: str) -> list[tuple[int, int]]:
    """The slices (number, of how many) in which the fact is built."""
    lineitem, fs = _fs(spark, f"{sf_dir.rstrip('/')}/lineitem.parquet")
    n = max(1, min(MOST_SLICES, -(-fs.getContentSummary(lineitem).getLength() // SLICE_BYTES)))
    return [(k, n) for k in range(n)]


def _of_slice(rows: DataFrame, key: str, part: tuple[int, int]) -> DataFrame:
    k, n = part
    return rows if n == 1 else rows.filter(F.pmod(F.xxhash64(key), F.lit(n)) == k)


def _lines(spark: SparkSession, sf_dir: str, part: tuple[int, int] = (0, 1)) -> DataFrame:
    """One narrow row per line item (of a slice): keys, names and measures, without what follows from them. Large shuffles move these."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        (F.col("l_quantity") * 10).cast("int").alias("seats"),
        (F.col("l_returnflag") == F.lit("R")).alias("codeshare"),
        F.col("l_shipdate").cast("date").alias("flight_date"),
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    li, orders = _of_slice(li, "l_orderkey", part), _of_slice(orders, "o_orderkey", part)
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    dest = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderkey", "c_custkey", "c_nationkey"
    )
    j = (
        li.join(dest, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    )
    return j.drop("o_orderkey", "s_suppkey", "p_partkey")


def _widened(lines: DataFrame, sf_dir: str, table_form: bool = False) -> DataFrame:
    """Narrow lines with all columns of the fact, or of its table form. No shuffle: rows stay where and in what order they are."""
    geo = F.broadcast(geography(lines.sparkSession, sf_dir))
    og = geo.select([F.col(c).alias(f"o_{c}") for c in geo.columns])
    dg = geo.select([F.col(c).alias(f"d_{c}") for c in geo.columns])
    j = lines.join(og, F.col("s_nationkey") == F.col("o_nk")).join(dg, F.col("c_nationkey") == F.col("d_nk"))
    flight_date = F.col("flight_date")
    cols = {
        "airline_code": F.concat(F.lit("S"), F.lpad(F.col("l_suppkey").cast("string"), 6, "0")),
        "airline_name": F.col("s_name"),
        "flight_number": F.concat(
            F.lit("S"), F.col("l_suppkey").cast("string"), F.lit("-"), F.col("l_partkey").cast("string")
        ),
        "origin_airport": airport_code("A", F.col("l_suppkey")),
        "origin_city": F.col("o_name"),
        "origin_country": F.col("o_name"),
        "origin_region": F.col("o_region"),
        "origin_latitude": F.col("o_lat"),
        "origin_longitude": F.col("o_lon"),
        "destination_airport": airport_code("C", F.col("c_custkey")),
        "destination_city": F.col("d_name"),
        "destination_country": F.col("d_name"),
        "destination_region": F.col("d_region"),
        "destination_latitude": F.col("d_lat"),
        "destination_longitude": F.col("d_lon"),
        "distance_km": X.haversine_km("o_lat", "o_lon", "d_lat", "d_lon").cast("decimal(10,2)"),
        "seats": F.col("seats"),
        "aircraft_type": F.col("p_type"),
        "codeshare": F.col("codeshare"),
        "stops": F.col("l_linenumber") - 1,
        "flight_date": flight_date,
        "flight_year": F.year(flight_date),
        "flight_month": F.month(flight_date),
        "flight_quarter": F.quarter(flight_date),
    }
    if table_form:
        created = flight_date.cast("timestamp")
        seconds = F.pmod(F.col("l_partkey"), F.lit(1440)) * 60 + F.col("l_linenumber")
        cols |= {
            "flight_id": F.col("l_orderkey") * 8 + F.col("l_linenumber"),
            "created_at": created,
            "updated_at": F.timestamp_seconds(F.unix_timestamp(created) + seconds),
        }
        return j.select(*[cols[f.name].cast(f.dataType).alias(f.name) for f in S.FACT_WITH_AUDIT.fields])
    kept = [c for c in S.FACT_PARTITION_COLUMNS if c in lines.columns]
    return j.select(*[cols[name].alias(name) for name in S.FACT_COLUMNS], *kept)


def flights_frame(spark: SparkSession, sf_dir: str, table_form: bool = False, part: tuple[int, int] = (0, 1)) -> DataFrame:
    """Lazy plan of the fact, or of a slice of it, over the raw tables (FACT column order).

    ``table_form`` gives the analytical table's 27 columns instead: the key
    ``flight_id`` (order key and line number), the fact, and the audit times
    ``created_at`` / ``updated_at``."""
    return _widened(_lines(spark, sf_dir, part), sf_dir, table_form)


def write_fact_table(spark: SparkSession, sf_dir: str, path: str, mode: str = "errorifexists",
                     change: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Write the table form to a staged copy at ``path``, or what ``change`` makes of its rows, slice by slice."""
    for part in slices(spark, sf_dir):
        rows = flights_frame(spark, sf_dir, True, part)
        with settings(spark, STAGED):
            writer = (change(rows) if change else rows).write.mode("append" if part[0] else mode)
            writer.options(**STAGED_FILES).parquet(path)


def _write_lines(sf_dir: str):
    """Writer of the fact from narrow lines: these are shuffled and sorted, the other columns follow as files are written.

    The fact is written slice by slice: a month has a file or more of each."""

    def write(lines: DataFrame, path: str) -> str:
        spark = lines.sparkSession
        for part in slices(spark, sf_dir):
            own = lines if part[1] == 1 else _lines(spark, sf_dir, part)
            with settings(spark, FREED):
                write_fact_parquet(own, path, mode="append" if part[0] else "errorifexists", widen=lambda rows: _widened(rows, sf_dir))
        return path

    return write


def _inputs_key(spark: SparkSession, sf_dir: str) -> str:
    """Inputs (path, size, mtime) plus the derivation's own source text, so a
    changed derivation never reuses an old table."""
    h = hashlib.sha1(f"{sf_dir.rstrip('/')} {S.FACT_PARTITION_COLUMNS}".encode())
    h.update(inspect.getsource(_lines).encode() + inspect.getsource(_widened).encode())
    h.update(inspect.getsource(geography).encode() + inspect.getsource(airport_code).encode())
    for name in ("lineitem", "orders", "customer", "supplier", "part", "nation", "region"):
        h.update(f"{name}:{_stat(spark, f'{sf_dir.rstrip(chr(47))}/{name}.parquet')}".encode())
    return h.hexdigest()[:16]


def _stat(spark: SparkSession, path: str) -> str:
    """Size and modification time of a file or folder on any Hadoop file
    system (local, HDFS, object stores)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return "missing"
    summary = fs.getContentSummary(p)
    return f"{summary.getLength()}:{summary.getFileCount()}:{fs.getFileStatus(p).getModificationTime()}"


def read_fact(spark: SparkSession, path: str) -> DataFrame:
    """Read a partitioned fact with its declared schema (no inference job)."""
    parts = [T.StructField(c, T.IntegerType()) for c in S.FACT_PARTITION_COLUMNS]
    return spark.read.schema(T.StructType(S.FACT.fields + parts)).parquet(path)


def flights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The materialised fact for ``sf_dir``, built on first use.

    Built as a published version (new folder, then a pointer switch), so a
    build that dies midway leaves the pointer untouched and the next call
    simply builds again. The DataFrame is kept per session, so its file index
    (the listing of the month folders) is built once, as a catalog table's."""
    key = (spark.sparkContext.applicationId, sf_dir)
    frame = _FRAMES.get(key)
    if frame is None:
        base = f"{shared_dir(spark)}/wingspan-tables/flights-{_inputs_key(spark, sf_dir)}"
        version = current_version(spark, base)
        if version is None:
            version = publish_version(_lines(spark, sf_dir), base, write=_write_lines(sf_dir))
        path = f"{base}/{version}"
        _MATERIALISED[key] = path
        frame = _FRAMES[key] = read_fact(spark, path)
    return frame


def fact_path(spark: SparkSession, sf_dir: str) -> str:
    """Folder of the materialised fact for ``sf_dir`` (built if needed)."""
    flights(spark, sf_dir)
    return _MATERIALISED[(spark.sparkContext.applicationId, sf_dir)]


def rollup_path(spark: SparkSession, sf_dir: str, name: str) -> str:
    """Folder of the materialised rollup ``HUBS`` or ``TRENDS`` of the fact for ``sf_dir`` (built if needed)."""
    from wingspan.plans import rollups

    rollup = getattr(rollups, name)
    base = f"{fact_path(spark, sf_dir)}-rollup-{name.lower()}"
    if (base not in _ROLLUPS) and not rollups.exists(spark, base):
        rollups.build(flights(spark, sf_dir), rollup, base)
    _ROLLUPS.add(base)
    return base
