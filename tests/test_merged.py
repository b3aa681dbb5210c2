"""The merged copy: equal to the latest rows of all changes, replays, untouched buckets, odd rows."""

import datetime as dt
import os
import random

from wingspan.operators.windows import latest_per_key
from wingspan.streaming import merged as M
from wingspan.streaming import sync as I

SCHEMA = "flight_id bigint, payload string, updated_at timestamp"
T = [dt.datetime(2024, 1, 1, 10, m) for m in range(0, 50, 5)]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def state(spark, base):
    schema = frame(spark, []).schema
    return sorted((tuple(r) for r in M.read_merged(spark, base, schema).collect()), key=str)


def files(base):
    """The bucket folders by name, with the files they hold."""
    out = {}
    for folder, _, names in os.walk(f"{base}/files"):
        out.update({os.path.join(folder, n): os.stat(os.path.join(folder, n)).st_mtime_ns for n in names if n.endswith(".parquet")})
    return out


def test_equal_to_the_latest_of_all_changes(spark, workdir):
    dice = random.Random(3)
    base, seen = f"{workdir}/copy", []
    for batch in range(4):
        rows = [(None if dice.random() < 0.05 else 0 if dice.random() < 0.33 else dice.randrange(60), f"{batch}-{i}", dice.choice(T)) for i in range(80)]
        rows += rows[:5]
        M.merge_batch(frame(spark, rows), batch, base, ["flight_id"], "updated_at", ["payload"], buckets=8)
        seen += [(*r, batch) for r in rows]
        every = spark.createDataFrame(seen, f"{SCHEMA}, b int")
        want = latest_per_key(every, ["flight_id"], ["updated_at", "b", "payload"]).drop("b").collect()
        assert state(spark, base) == sorted(map(tuple, want), key=str)


def test_replay_and_untouched_buckets(spark, workdir):
    base = f"{workdir}/copy"
    assert state(spark, base) == []
    M.merge_batch(frame(spark, [(i, "a", T[1]) for i in range(100)]), 0, base, ["flight_id"], "updated_at", buckets=16)
    before, held = files(base), M.manifest(spark, base)
    change = frame(spark, [(7, "new", T[2]), (7, "newer", T[3]), (8, "too old", T[0])])
    touched = M.merge_batch(change, 1, base, ["flight_id"], "updated_at", buckets=4)  # the first batch's number of buckets stays
    now = M.manifest(spark, base)
    assert 1 <= len(touched) <= 2
    assert {b for b in held if held[b][0] != now[b][0]} == set(touched)
    assert before.items() <= files(base).items()  # nothing that was there is written again
    assert {r[0]: r[1] for r in state(spark, base)} == {i: "newer" if i == 7 else "a" for i in range(100)}
    assert M.merge_batch(change, 1, base, ["flight_id"], "updated_at") == [] and M.manifest(spark, base) == now  # a replay
    assert M.merge_batch(frame(spark, []), 2, base, ["flight_id"], "updated_at") == []
    gone = M.vacuum(spark, base)
    assert len(gone) == len(touched) and len(state(spark, base)) == 100


def test_a_failed_batch_leaves_the_state(spark, workdir):
    base = f"{workdir}/copy"
    M.merge_batch(frame(spark, [(1, "a", T[1])]), 0, base, ["flight_id"], "updated_at")
    bad = frame(spark, [(2, "b", T[1])]).selectExpr("flight_id", "CASE WHEN flight_id = 2 THEN raise_error('broken') ELSE payload END AS payload", "updated_at")
    try:
        M.merge_batch(bad, 1, base, ["flight_id"], "updated_at")
        raise AssertionError("no error")
    except Exception as e:
        assert "broken" in str(e)
    assert [r[:2] for r in state(spark, base)] == [(1, "a")]
    M.merge_batch(frame(spark, [(2, "b", T[1])]), 1, base, ["flight_id"], "updated_at")
    assert [r[:2] for r in state(spark, base)] == [(1, "a"), (2, "b")]


def test_stream(spark, workdir):
    feed, base = f"{workdir}/feed", f"{workdir}/copy"
    for n, rows in enumerate(([(1, "a", T[0]), (2, "b", T[0])], [(2, "b2", T[1]), (3, "c", T[1])], [(2, "late", T[0])])):
        frame(spark, rows).coalesce(1).write.parquet(f"{feed}/{n}")
        stream = I.change_stream(spark, feed, frame(spark, []).schema, options={"recursiveFileLookup": "true"})
        for _ in range(2):  # the second run finds nothing new
            q = M.sync_merged(stream, base, f"{workdir}/ckpt", ["flight_id"], "updated_at", buckets=4)
            q.awaitTermination()
    assert [r[:2] for r in state(spark, base)] == [(1, "a"), (2, "b2"), (3, "c")]
