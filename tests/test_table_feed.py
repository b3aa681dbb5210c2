"""Changes of a table by a composite mark: split instants, restarts, updates and odd rows."""

import datetime as dt
import os

from wingspan.sources.table_feed import table_changes
from wingspan.streaming import sync as I

SCHEMA = "flight_id bigint, payload string, updated_at timestamp"
T0, T1, T2 = (dt.datetime(2024, 1, 1, 10, m) for m in (0, 5, 10))


def write(spark, table, rows, files=1, mode="append"):
    spark.createDataFrame(rows, SCHEMA).repartition(files).write.mode(mode).parquet(table)


def run(spark, table, workdir, **options):
    schema = spark.createDataFrame([], SCHEMA).schema
    I.sync_once(table_changes(spark, table, schema, "updated_at", "flight_id", **options), f"{workdir}/target", f"{workdir}/ckpt")
    return sorted((r.batch_id, r.flight_id, r.payload) for r in I.synced_changes(spark, f"{workdir}/target").collect())


def test_an_instant_split_over_batches(spark, workdir):
    table = os.path.join(workdir, "table")
    write(spark, table, [(i, f"p{i}", T1) for i in range(25)], files=3)
    write(spark, table, [(100, "first", T0), (101, "last", T2)])
    schema = spark.createDataFrame([], SCHEMA).schema
    feed = table_changes(spark, table, schema, "updated_at", "flight_id", max_rows=10)
    query = feed.writeStream.foreachBatch(I.batch_writer(f"{workdir}/target")).option("checkpointLocation", f"{workdir}/ckpt").start()
    query.processAllAvailable()
    query.stop()
    got = I.synced_changes(spark, f"{workdir}/target").collect()
    assert sorted(r.flight_id for r in got) == [*range(25), 100, 101]  # each once
    sizes = {}
    for r in got:
        sizes[r.batch_id] = sizes.get(r.batch_id, 0) + 1
    assert [sizes[b] for b in sorted(sizes)] == [10, 10, 7]
    of_instant = [r for r in got if r.updated_at == T1]
    assert len({r.batch_id for r in of_instant}) == 3
    order = [r.flight_id for r in sorted(got, key=lambda r: (r.batch_id, r.updated_at, r.flight_id))]
    assert order == [100, *range(25), 101]


def test_restart_and_updates(spark, workdir):
    table = os.path.join(workdir, "table")
    write(spark, table, [(1, "a", T0), (2, "b", T1)])
    first = run(spark, table, workdir)
    assert [x[1:] for x in first] == [(1, "a"), (2, "b")]
    assert run(spark, table, workdir) == first  # nothing new
    write(spark, table, [(1, "a", T0), (2, "b2", T2), (3, "c", T1)], mode="overwrite")  # 2 updated, 3 of the mark's own instant
    again = run(spark, table, workdir)
    assert [x[1:] for x in again if x not in first] == [(2, "b2"), (3, "c")]
    assert run(spark, table, workdir) == again
    state = I.current_state(spark, f"{workdir}/target", ["flight_id"], "updated_at").collect()
    assert {r.flight_id: r.payload for r in state} == {1: "a", 2: "b2", 3: "c"}


def test_odd_rows(spark, workdir):
    table = os.path.join(workdir, "table")
    os.makedirs(table)
    assert run(spark, table, workdir) == []  # an empty folder
    write(spark, table, [(None, "no key", T1), (5, "no time", None), (6, None, T1), (6, None, T1)])
    assert [x[1:] for x in run(spark, table, workdir)] == [(6, None), (6, None)]  # alike rows come together
    write(spark, table, [(7, "x" * 100_000, T2), (7, "other", T2)])
    assert [x[1:] for x in run(spark, table, workdir, max_rows=1)][2:] == [(7, "other"), (7, "x" * 100_000)]


def test_settled_rows_only(spark, workdir):
    table = os.path.join(workdir, "table")
    write(spark, table, [(1, "a", T0), (2, "b", T1), (3, "c", T2)])
    assert [x[1] for x in run(spark, table, workdir, settle_seconds=300)] == [1, 2]
    write(spark, table, [(9, "late", T2)])
    assert [x[1] for x in run(spark, table, workdir)] == [1, 2, 3, 9]


def test_a_hot_instant(spark, workdir):
    """A third of all rows at one instant, over many files and row groups."""
    table = os.path.join(workdir, "table")
    rows = spark.range(9000).selectExpr(
        "id AS flight_id", "concat('p', id) AS payload",
        "CASE WHEN id % 3 = 0 THEN timestamp'2024-01-01 10:05:00' ELSE timestamp'2024-01-01 10:00:00' + make_interval(0, 0, 0, 0, 0, 0, id % 600) END AS updated_at")
    rows.repartition(6).write.option("parquet.block.size", 4096).parquet(table)
    schema = spark.createDataFrame([], SCHEMA).schema
    query = table_changes(spark, table, schema, "updated_at", "flight_id", max_rows=1000).writeStream
    query = query.foreachBatch(I.batch_writer(f"{workdir}/target")).option("checkpointLocation", f"{workdir}/ckpt").start()
    query.processAllAvailable()
    query.stop()
    got = I.synced_changes(spark, f"{workdir}/target")
    assert got.count() == got.select("flight_id").distinct().count() == 9000
    assert {r["count"] for r in got.groupBy("batch_id").count().collect()} == {1000}
