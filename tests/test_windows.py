"""Change counts by window from partial rows of every micro-batch."""

import datetime as dt
import os

import pytest

from wingspan.streaming import sync as I
from wingspan.streaming import windows as W

SCHEMA = "id int, updated_at timestamp"


def t(h, m, s):
    return dt.datetime(2024, 1, 1, h, m, s)


FILES = [
    [(1, t(10, 0, 10)), (2, t(10, 0, 20)), (3, t(10, 1, 5)), (4, None)],
    [(5, t(10, 0, 30)), (6, t(10, 30, 0))],
    [(7, t(10, 0, 5)), (7, t(10, 0, 5))],  # late for a watermark, and repeated
    [],
]


def feed(spark, folder, files, first=0):
    for i, rows in enumerate(files, first):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(os.path.join(folder, f"b{i}"))


def stream(spark, folder, most=1):
    schema = spark.createDataFrame([], SCHEMA).schema
    return I.change_stream(spark, folder, schema, max_files_per_trigger=most, options={"recursiveFileLookup": "true"})


def told(spark, target):
    return {(r["window_start"].hour, r["window_start"].minute): (r["new_records"], r["earliest"].second, r["latest"].second)
            for r in W.counts(spark, target).collect()}


WANT = {(10, 0): (5, 5, 30), (10, 1): (1, 5, 5), (10, 30): (1, 0, 0)}


def test_any_split_and_order(spark, workdir):
    for n, (files, most) in enumerate([(FILES, 1000), (FILES, 1), (FILES[::-1], 1)]):
        folder, target = os.path.join(workdir, f"feed{n}"), os.path.join(workdir, f"target{n}")
        os.makedirs(folder)
        feed(spark, folder, files)
        W.start(stream(spark, folder, most), "updated_at", target, f"{target}-ckpt").awaitTermination()
        assert told(spark, target) == WANT


def test_restart_replay_and_fold(spark, workdir):
    folder, target = os.path.join(workdir, "feed"), os.path.join(workdir, "target")
    os.makedirs(folder)
    feed(spark, folder, FILES[:1])
    W.start(stream(spark, folder), "updated_at", target, f"{target}-ckpt").awaitTermination()
    W.fold(spark, target)
    assert told(spark, target) == {(10, 0): (2, 10, 20), (10, 1): (1, 5, 5)}
    feed(spark, folder, FILES[1:], first=1)
    W.start(stream(spark, folder), "updated_at", target, f"{target}-ckpt").awaitTermination()
    assert told(spark, target) == WANT
    # a batch that is written again replaces itself
    last = max(int(d.split("=")[1]) for d in os.listdir(f"{target}/{I.CHANGES}") if "=" in d)
    again = spark.read.parquet(f"{target}/{I.CHANGES}/batch_id={last}")
    rows = again.collect()
    I.batch_writer(target)(spark.createDataFrame(rows, again.schema), last)
    W.fold(spark, target)
    assert told(spark, target) == WANT
    with pytest.raises(ValueError):
        W.start(stream(spark, folder), "updated_at", target, f"{target}-other")


def test_no_state_in_the_plan(spark, workdir):
    folder, target = os.path.join(workdir, "feed"), os.path.join(workdir, "target")
    os.makedirs(folder)
    feed(spark, folder, FILES[:2])
    q = W.start(stream(spark, folder), "updated_at", target, f"{target}-ckpt")
    q.awaitTermination()
    assert all(not p.stateOperators for p in q.recentProgress)
    assert not os.path.exists(f"{target}-ckpt/state")


def test_empty_feed(spark, workdir):
    folder, target = os.path.join(workdir, "feed"), os.path.join(workdir, "target")
    os.makedirs(folder)
    feed(spark, folder, [[]])
    W.start(stream(spark, folder), "updated_at", target, f"{target}-ckpt").awaitTermination()
    assert told(spark, target) == {}
    with pytest.raises(ValueError):
        W.fold(spark, target)
