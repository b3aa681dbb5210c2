"""Incremental sync (I1-I7, E4, P4): replay, restart, updates, late and empty batches."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from wingspan.streaming import sync as I

SCHEMA = "flight_id bigint, payload string, updated_at timestamp"
T0, T1, T2 = (dt.datetime(2024, 1, 1, 10, m) for m in (0, 5, 10))


def drop(spark, feed, name, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(os.path.join(feed, name))


def state(spark, target):
    rows = I.current_state(spark, target, ["flight_id"], "updated_at").collect()
    return {r["flight_id"]: r["payload"] for r in rows}


def run(spark, feed, target, ckpt):
    stream = I.change_stream(spark, feed, spark.createDataFrame([], SCHEMA).schema,
                             options={"recursiveFileLookup": "true"})
    I.sync_once(stream, target, ckpt)


def counters(spark, target):
    r = I.sync_counters(spark, target).collect()[0]
    return r["batches"], r["rows_synced"]


def test_sync_lifecycle(spark, workdir):
    feed, target, ckpt = (os.path.join(workdir, x) for x in ("feed", "target", "ckpt"))
    os.makedirs(feed)
    drop(spark, feed, "b1", [(1, "a", T1), (2, "b", T1)])
    run(spark, feed, target, ckpt)
    assert state(spark, target) == {1: "a", 2: "b"}

    # newer version of an old key, a new key, and an older version arriving late
    drop(spark, feed, "b2", [(1, "a2", T2), (3, "c", T2), (2, "b-old", T0)])
    run(spark, feed, target, ckpt)
    assert state(spark, target) == {1: "a2", 2: "b", 3: "c"}

    # same updated_at as the stored version: the later batch wins
    drop(spark, feed, "b3", [(3, "c-tie", T2)])
    run(spark, feed, target, ckpt)
    assert state(spark, target)[3] == "c-tie"
    assert counters(spark, target) == (3, 6)

    # restart on the same checkpoint with nothing new: no batch, no duplicates
    run(spark, feed, target, ckpt)
    assert counters(spark, target) == (3, 6)

    # an empty change file: nothing is written
    drop(spark, feed, "b4", [])
    run(spark, feed, target, ckpt)
    assert counters(spark, target) == (3, 6)
    assert I.synced_changes(spark, target).count() == 6


def test_replayed_batch_is_idempotent(spark, workdir):
    target = os.path.join(workdir, "target")
    batch = spark.createDataFrame([(1, "a", T1), (2, "b", T1)], SCHEMA)
    write = I.batch_writer(target)
    write(batch, 0)
    write(batch, 0)  # replay after a failure
    assert I.synced_changes(spark, target).count() == 2
    assert counters(spark, target) == (1, 2)


def test_compaction_switches_pointer(spark, workdir):
    target = os.path.join(workdir, "target")
    write = I.batch_writer(target)
    write(spark.createDataFrame([(1, "a", T1), (2, "x", T1)], SCHEMA), 0)
    write(spark.createDataFrame([(1, "b", T2)], SCHEMA), 1)
    I.compact(spark, target, ["flight_id"], "updated_at")
    assert I.compacted_upto(spark, target) == 1
    rows = I.read_compacted(spark, target).collect()
    assert sorted((r["flight_id"], r["payload"]) for r in rows) == [(1, "b"), (2, "x")]
    # later batches are merged over the snapshot; a tie on updated_at goes to the later batch
    write(spark.createDataFrame([(2, "y", T1), (3, "z", T0)], SCHEMA), 2)
    assert state(spark, target) == {1: "b", 2: "y", 3: "z"}
    I.compact(spark, target, ["flight_id"], "updated_at")
    assert I.compacted_upto(spark, target) == 2
    write(spark.createDataFrame([(1, "old", T0)], SCHEMA), 3)
    assert state(spark, target) == {1: "b", 2: "y", 3: "z"}


def test_timed_trigger(spark, workdir):
    feed, target, ckpt = (os.path.join(workdir, x) for x in ("feed", "target", "ckpt"))
    os.makedirs(feed)
    drop(spark, feed, "b1", [(7, "x", T1)])
    stream = I.change_stream(spark, feed, spark.createDataFrame([], SCHEMA).schema,
                             options={"recursiveFileLookup": "true"})
    q = I.run_continuous(stream, target, ckpt, interval_seconds=1)
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert state(spark, target) == {7: "x"}


def test_change_window_report(spark):
    rows = [(1, "a", T0), (2, "b", T1), (3, "c", T2)]
    df = spark.createDataFrame(rows, SCHEMA)
    r = I.change_window_report(df, "updated_at", dt.datetime(2024, 1, 1, 10, 6), minutes=1).collect()[0]
    # ">= as_of - 1 minute" with no upper bound: 10:05 and the later 10:10 both count
    assert r["new_records"] == 2 and r["earliest"] == T1 and r["latest"] == T2
    w = I.windowed_change_counts(df, "updated_at", minutes=5)
    assert w.isStreaming is False and w.count() == 3
    assert df.filter(F.col("updated_at") > T0).count() == 2


def test_marks_ignore_session_time_zone(spark):
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    from wingspan.operators import filters as B

    mark = dt.datetime(2024, 1, 15, 0, 0, 0)
    base = B.changed_since(ev, "ts", mark).count()
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
        assert B.changed_since(ev, "ts", mark).count() == base
        r1 = I.change_window_report(ev, "ts", dt.datetime(2024, 1, 20, 12), minutes=1).collect()[0]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    r0 = I.change_window_report(ev, "ts", dt.datetime(2024, 1, 20, 12), minutes=1).collect()[0]
    assert r0["new_records"] == r1["new_records"]
    assert base == ev.filter(F.col("ts") > F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")).count()


def test_windowed_counts_do_not_depend_on_the_split(spark, workdir):
    def t(h, m, s):
        return dt.datetime(2024, 1, 1, h, m, s)

    files = [[(1, "a", t(10, 0, 10)), (2, "b", t(10, 0, 20)), (3, "c", t(10, 1, 5))],
             [(4, "d", t(10, 0, 30)), (5, "e", t(10, 30, 0))], [(6, "f", t(10, 0, 40))]]
    schema = spark.createDataFrame([], SCHEMA).schema
    found = []
    for run_no, (order, most) in enumerate([([0, 1, 2], 1000), ([0, 1, 2], 1), ([2, 1, 0], 1)]):
        feed, target, ckpt = (os.path.join(workdir, f"{run_no}-{x}") for x in ("feed", "target", "ckpt"))
        os.makedirs(feed)
        for i in order:
            drop(spark, feed, f"b{order.index(i)}", files[i])
        stream = I.change_stream(spark, feed, schema, max_files_per_trigger=most, options={"recursiveFileLookup": "true"})
        I.sync_windowed_counts(stream, "updated_at", target, ckpt, minutes=1).awaitTermination()
        found.append({(r["window_start"].hour, r["window_start"].minute): r["new_records"]
                      for r in I.windowed_counts_state(spark, target).collect()})
    assert found == [{(10, 0): 4, (10, 1): 1, (10, 30): 1}] * 3


def test_empty_feed(spark, workdir):
    feed, target, ckpt = (os.path.join(workdir, x) for x in ("feed", "target", "ckpt"))
    os.makedirs(feed)
    run(spark, feed, target, ckpt)
    assert counters(spark, target) == (0, 0) and state(spark, target) == {}
    drop(spark, feed, "b1", [])
    run(spark, feed, target, ckpt)
    assert counters(spark, target) == (0, 0) and state(spark, target) == {}
    drop(spark, feed, "b2", [(1, "a", T1)])
    run(spark, feed, target, ckpt)
    assert counters(spark, target) == (1, 1) and state(spark, target) == {1: "a"}


def test_new_checkpoint_on_an_old_target_is_refused(spark, workdir):
    feed, target, ckpt = (os.path.join(workdir, x) for x in ("feed", "target", "ckpt"))
    os.makedirs(feed)
    drop(spark, feed, "b1", [(1, "a", T1)])
    run(spark, feed, target, ckpt)
    with pytest.raises(ValueError):
        run(spark, feed, target, ckpt + "-other")
    assert state(spark, target) == {1: "a"}


def test_paced_backfill(spark, workdir):
    feed, target, ckpt = (os.path.join(workdir, x) for x in ("feed", "target", "ckpt"))
    os.makedirs(feed)
    for i in range(3):
        drop(spark, feed, f"b{i}", [(i, f"p{i}", T1)])
    stream = I.change_stream(spark, feed, spark.createDataFrame([], SCHEMA).schema, max_files_per_trigger=1,
                             options={"recursiveFileLookup": "true"})
    I.sync_once(stream, target, ckpt)
    assert counters(spark, target) == (3, 3)  # one file per micro-batch
    assert state(spark, target) == {0: "p0", 1: "p1", 2: "p2"}
