"""Large copies: built in slices, packed once, and without shuffle files that outlive their job."""

import datetime as dt
import os
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from factfix import fact as make
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wingspan import schemas as S
from wingspan.operators import checksum as CS
from wingspan.operators import distinct as D
from wingspan.operators import windows as W
from wingspan.plans import fixture
from wingspan.plans import pipelines as P
from wingspan.plans import rollups as U
from wingspan.session import FREED, settings
from wingspan.sources import sinks
from wingspan.sources.table_feed import PIECE_ROWS, FeedReader
from wingspan.streaming import merged as M

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted(map(str, df.collect()))


# F1
def test_slices_make_the_whole_table(spark, workdir, monkeypatch):
    monkeypatch.setattr(fixture, "SLICE_BYTES", 20_000)
    parts = fixture.slices(spark, SF)
    assert len(parts) == fixture.MOST_SLICES > 1
    counts = [fixture.flights_frame(spark, SF, True, p).count() for p in parts]
    assert all(counts)
    whole = fixture.flights_frame(spark, SF, True)
    fixture.write_fact_table(spark, SF, f"{workdir}/t")
    assert rows_of(spark.read.schema(S.FACT_WITH_AUDIT).parquet(f"{workdir}/t")) == rows_of(whole)
    fixture.write_fact_table(spark, SF, f"{workdir}/t", mode="overwrite", change=lambda r: r.filter("seats > 100"))
    assert rows_of(spark.read.schema(S.FACT_WITH_AUDIT).parquet(f"{workdir}/t")) == rows_of(whole.filter("seats > 100"))


def test_shuffle_files_go_with_their_job(spark, workdir):
    folder = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        return {b.name() for b in map(folder.getAllBlocks().apply, range(folder.getAllBlocks().size())) if b.name().startswith("shuffle_")}

    before = shuffled()
    with settings(spark, FREED):
        spark.range(1000).repartition(3, "id").write.parquet(f"{workdir}/a")
    for _ in range(50):  # they are removed in the background
        if not shuffled() - before:
            break
        __import__("time").sleep(0.1)
    assert not shuffled() - before
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_the_latest_row_is_packed_without_repeats(spark):
    df = spark.createDataFrame([(1, "a", 5, "x"), (1, "b", 5, "y"), (1, "b", 5, "z"), (2, None, None, "n"), (None, "q", 1, None)], "k int, s string, n int, w string")
    got = W.latest_per_key(df, ["k"], ["n", "s", "n"])
    assert got.columns == df.columns and rows_of(got) == rows_of(spark.createDataFrame([(1, "b", 5, "z"), (2, None, None, "n"), (None, "q", 1, None)], df.schema))
    packed = got._jdf.queryExecution().optimizedPlan().toString().split("struct(")[1].split(")")[0]
    assert packed.count(", n#") == 1 and packed.count(", s#") == 1


def test_a_feed_task_holds_few_rows(spark, workdir):
    n = 3 * PIECE_ROWS
    at = np.datetime64("2024-01-01T00:00:00", "us") + np.arange(n)
    pq.write_table(pa.table({"k": np.arange(n), "t": pa.array(at, pa.timestamp("us", tz="UTC"))}), f"{workdir}/f.parquet")
    schema = spark.createDataFrame([], "k bigint, t timestamp").schema
    reader = FeedReader(schema, {"path": workdir, "updated_at": "t", "key": "k"})
    batches = [b for p in reader.partitions(reader.initialOffset(), reader.latestOffset()) for b in reader.read(p)]
    assert sum(b.num_rows for b in batches) == n and max(b.num_rows for b in batches) <= PIECE_ROWS


# F2
def test_a_short_list_of_ranges_moves_no_rows(spark, monkeypatch):
    df = spark.range(2000).selectExpr("id AS k", "concat('v', id % 7) AS v")
    want = set(range(0, 2000, 3))
    listed = df.filter("k % 3 = 0").select(CS._range_of(["k"], 2).alias("range"))
    with settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        few = CS._within(df, ["k"], 2, listed)
        monkeypatch.setattr(CS, "LISTED", 10)
        many = CS._within(df, ["k"], 2, listed)
        plans = [x._jdf.queryExecution().executedPlan().toString() for x in (few, many)]
        found = [{r.k for r in x.collect()} for x in (few, many)]
    assert "BroadcastHashJoin" in plans[0] and "SortMergeJoin" in plans[1]
    assert all(want <= f and len(f - want) < 100 for f in found)


def test_summaries_are_narrow_and_wrap(spark):
    df = spark.range(1000).selectExpr("0 AS k", "id")
    got = CS.summary(df, ["k"])
    assert got.columns == ["range", "rows", "s0", "s1"]
    hashes = [r.h for r in df.selectExpr("xxhash64(0, k IS NULL, k, id IS NULL, id) AS h").collect()]
    assert sum(hashes) != (want := (sum(hashes) + 2**63) % 2**64 - 2**63)  # the plain sum is beyond 64 bits
    assert [(r.rows, r.s0) for r in got.collect()] == [(1000, want)]
    assert spark.conf.get("spark.sql.ansi.enabled") == "true"


# F3
def test_buckets_are_merged_a_group_at_a_time(spark, workdir, monkeypatch):
    groups, real = [], M.latest_per_key
    monkeypatch.setattr(M, "GROUP_BYTES", 1)
    monkeypatch.setattr(M, "latest_per_key", lambda df, *a: groups.append(1) or real(df, *a))
    seen, base = None, f"{workdir}/copy"
    for batch in range(2):
        rows = spark.range(60).selectExpr("IF(id % 7 = 0, NULL, id % 23) AS k", f"concat('{batch}-', id) AS v", "timestamp_seconds(id % 5) AS t")
        groups.clear()
        touched = M.merge_batch(rows, batch, base, ["k"], "t", ["v"], buckets=4)
        assert len(groups) == len(touched) == 4  # each bucket's rows are shuffled by themselves
        every = rows.withColumn("b", F.lit(batch))
        seen = every if seen is None else seen.union(every)
        want = W.latest_per_key(seen, ["k"], ["t", "b", "v"]).drop("b")
        assert rows_of(M.read_merged(spark, base, rows.schema)) == rows_of(want)
        assert not any(files for _, _, files in os.walk(f"{base}/incoming"))


def test_groups_hold_so_many_bytes():
    assert [*M._groups({3: 5, 1: 4, 2: 9, 7: 1}, 9)] == [[1], [2], [3, 7]]
    assert [*M._groups({}, 9)] == []


# F4
def test_a_calendar_is_written_as_by_date(spark, workdir, monkeypatch):
    monkeypatch.setattr(sinks, "CALENDAR_ROWS", 7)  # several row groups a file
    base = make(spark, [dict(flight_number=None if i % 9 == 0 else f"F{i}", seats=None if i % 5 == 0 else i, codeshare=None if i % 7 == 0 else i % 2 == 0) for i in range(60)])
    rows = base.select(*P.ENRICHED_COLUMNS).repartition(3)
    days = [dt.date(2024, 1, 15), dt.date(2024, 2, 1), dt.date(2024, 2, 29)]
    expanded = [P.expand_calendar(rows, d, months=0) for d in days]
    dates = spark.createDataFrame([(None,) * len(rows.columns)], rows.schema)
    dates = reduce(DataFrame.unionByName, [P.expand_calendar(dates, d, months=0) for d in days]).select(*P.DATE_COLUMNS)
    monkeypatch.setattr(sinks, "_write_months", None)  # not row by row
    assert sinks.writes_calendar(spark, f"{workdir}/a") and sinks.write_fact_calendar(rows, dates, f"{workdir}/a") == 180
    monkeypatch.undo()
    sinks.write_fact_by_date(reduce(DataFrame.unionByName, expanded), f"{workdir}/b")
    a, b = (fixture.read_fact(spark, f"{workdir}/{x}") for x in "ab")
    assert rows_of(a) == rows_of(b) and a.schema == b.schema
    assert not sinks.writes_calendar(spark, f"{workdir}/a") and not os.path.exists(f"{workdir}/a/_temporary")
    assert [os.path.relpath(f.removeprefix("file:"), f"{workdir}/a") for f, _ in sinks.month_folders(spark, f"{workdir}/a")] == [
        "part_year=2024/part_month=1", "part_year=2024/part_month=2"]
    assert sinks.write_fact_calendar(rows.limit(0), dates, f"{workdir}/c") == 0 and spark.read.schema(S.FACT).parquet(f"{workdir}/c").count() == 0


# F5
def test_months_are_made_some_at_a_time(spark, workdir, monkeypatch):
    data = [dict(flight_number=f"F{i % 40}", seats=i, flight_date=dt.date(2024, 1 + i % 6, 1 + i % 9)) for i in range(240)]
    sinks.write_fact_parquet(make(spark, data), f"{workdir}/f")
    fact = fixture.read_fact(spark, f"{workdir}/f")
    calls, real = [], D.month_bitmaps
    monkeypatch.setattr(D, "month_bitmaps", lambda rows, *a: calls.append(rows.select("part_month").distinct().count()) or real(rows, *a))
    U.build(fact, U.HUBS, f"{workdir}/whole")
    monkeypatch.setattr(U, "SLICE_ROWS", 90)
    U.build(fact, U.HUBS, f"{workdir}/some")
    assert calls == [6, 2, 2, 2] and U.exists(spark, f"{workdir}/some")
    whole, some = (U.read_months(fact, U.HUBS, f"{workdir}/{x}") for x in ("whole", "some"))
    assert rows_of(whole) == rows_of(some)
    done = []
    monkeypatch.setattr(D, "month_bitmaps", lambda rows, *a: done.append(1) or (1 / 0 if len(done) == 2 else real(rows, *a)))
    with pytest.raises(ZeroDivisionError):
        U.build(fact, U.HUBS, f"{workdir}/broken")
    assert not U.exists(spark, f"{workdir}/broken")  # it is built again


def test_the_fact_is_built_in_slices(spark, workdir, monkeypatch):
    lines = fixture._lines(spark, SF)
    fixture._write_lines(SF)(lines, f"{workdir}/one")
    monkeypatch.setattr(fixture, "SLICE_BYTES", 40_000)
    fixture._write_lines(SF)(lines, f"{workdir}/more")
    one, more = (fixture.read_fact(spark, f"{workdir}/{x}") for x in ("one", "more"))
    assert len(fixture.slices(spark, SF)) > 1 and rows_of(one) == rows_of(more)
