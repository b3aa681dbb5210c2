"""Steps that must not grow faster than their input: what they shuffle, how large files and tasks are."""

import datetime as dt
import glob
import gzip

import pytest
from pyspark.sql import functions as F

from factfix import fact
from wingspan.functions import exprs as X
from wingspan.operators import distinct as D
from wingspan.operators import filters as B
from wingspan.operators import joins as J
from wingspan.plans import fixture, rollups
from wingspan.sources import raw, sinks
from wingspan.streaming import merged as M
from wingspan.streaming import sync as I



def days(spark, n=400):
    return fact(spark, [dict(flight_number=f"F{i}", flight_date=dt.date(2024, 1, 1) + dt.timedelta(days=(i * 37) % 100)) for i in range(n)])


def _exchanges(monkeypatch, job):
    """Exchanges in the plan of the rows that ``job`` writes to month folders."""
    plans, real = [], sinks._write_months

    def write(df, *rest):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        real(df, *rest)

    monkeypatch.setattr(sinks, "_write_months", write)
    job()
    return plans[0].replace("BroadcastExchange", "").count("Exchange")


def test_a_fact_read_by_month_is_rewritten_without_a_shuffle(spark, workdir, monkeypatch):
    f = days(spark)
    sinks.write_fact_parquet(f, f"{workdir}/a")
    read = fixture.read_fact(spark, f"{workdir}/a")
    assert _exchanges(monkeypatch, lambda: sinks.write_fact_parquet(read, f"{workdir}/b", clustered=True)) == 0
    back = fixture.read_fact(spark, f"{workdir}/b")
    assert sorted(back.collect()) == sorted(read.collect())
    for path in glob.glob(f"{workdir}/b/*/*/*.parquet"):
        dates = [r[0] for r in spark.read.parquet(path).select("flight_date").collect()]
        assert dates == sorted(dates)
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == "134217728b"


def test_the_fact_is_built_from_narrow_rows(spark):
    lines = fixture._lines(spark, "/root/testdata/sf0.001")
    assert not {"origin_city", "distance_km", "flight_number", "destination_airport"} & set(lines.columns)
    assert sorted(map(str, fixture._widened(lines, "/root/testdata/sf0.001").collect()))[:5] == sorted(
        map(str, fixture.flights_frame(spark, "/root/testdata/sf0.001").collect()))[:5]


def test_csv_files_are_bounded_and_may_be_packed(spark, workdir, monkeypatch):
    monkeypatch.setattr(sinks.S, "CHUNK_ROWS", 1)  # 100 rows a file
    f = days(spark).coalesce(1)
    sinks.write_fact_csv(f, f"{workdir}/c", compression="gzip")
    files = glob.glob(f"{workdir}/c/*.csv.gz")
    assert len(files) == 4 and all(len(gzip.open(p, "rt").readlines()) == 101 for p in files)
    assert sorted(raw.read_fact_csv(spark, f"{workdir}/c").collect()) == sorted(f.collect())


def test_every_date_writes_its_own_month_without_a_shuffle(spark, workdir, monkeypatch):
    base = days(spark, 50)
    both = base.withColumn("flight_date", F.lit(dt.date(2024, 1, 15))).unionByName(base.withColumn("flight_date", F.lit(dt.date(2024, 2, 1))))
    assert _exchanges(monkeypatch, lambda: sinks.write_fact_by_date(both, f"{workdir}/d")) == 0
    assert fixture.read_fact(spark, f"{workdir}/d").groupBy("part_month").count().orderBy("part_month").collect() == [(1, 50), (2, 50)]


@pytest.mark.parametrize("end", [dt.date(2024, 5, 15), dt.date(2024, 3, 31), dt.date(2001, 8, 1), dt.date(2024, 2, 29)])
def test_month_starts_as_the_series(spark, end):
    start = X.add_months(end, -24)
    want = spark.range(1).select(X.month_start_series(F.lit(start), F.lit(end))).first()[0]
    assert X.month_starts(end, 24) == want


def test_a_lookup_deals_one_key_over_many_tasks(spark):
    left = spark.range(3000).select("id", F.when(F.col("id") % 10 == 0, None).otherwise("K").alias("k"))
    right = spark.createDataFrame([("K", None), ("Z", "z"), (None, "never")], "key string, v string")
    with J_shuffled(spark):
        out = J.lookup_left_with_default(left, right, "k", "key", "v", "found", "none").withColumn("task", F.spark_partition_id())
        most = out.groupBy("task").count().agg(F.max("count")).first()[0]
        rows = out.groupBy("k", "found").count().collect()
    assert out.columns == ["id", "k", "found", "task"]
    assert {tuple(r) for r in rows} == {(None, "none", 300), ("K", None, 2700)}
    assert most < 2400  # 2,700 in one task before


def J_shuffled(spark):
    from wingspan.session import settings

    return settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "64"})


def test_bitmaps_are_made_after_the_shuffle(spark, workdir):
    f = days(spark).withColumns({"part_year": F.col("flight_year"), "part_month": F.col("flight_month")})
    codes = D.dense_codes(f, "flight_number")
    made = D.month_bitmaps(f, codes, list(rollups.HUBS.keys), "flight_number", rollups.HUBS.sums())
    text = made._jdf.queryExecution().executedPlan().toString()
    assert "partial_bitmap_construct_agg" in text
    assert text.index("Exchange hashpartitioning(part_year") > text.index("partial_bitmap_construct_agg")  # below it in the plan


def test_only_wanted_columns_are_merged(spark, workdir):
    rows = [(1, "a", 5, "2024-01-01 00:00:00"), (1, "b", 6, "2024-01-02 00:00:00"), (2, "c", 7, "2024-01-01 00:00:00"), (2, "c", 8, "2024-01-01 00:00:00"), (None, "d", 9, None)]
    df = spark.createDataFrame(rows, "k int, s string, n int, t string").withColumn("t", F.col("t").cast("timestamp")).withColumn("wide", F.lit("x"))
    df.write.parquet(f"{workdir}/feed")
    I.sync_once(I.change_stream(spark, f"{workdir}/feed", df.schema), f"{workdir}/t", f"{workdir}/c")
    whole = I.current_state(spark, f"{workdir}/t", ["k"], "t", ["s", "n"])
    some = I.current_state(spark, f"{workdir}/t", ["k"], "t", ["s", "n"], ["k", "s", "n"])
    assert "wide" not in some._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(str, some.collect())) == sorted(map(str, whole.select("k", "s", "n").collect()))
    with pytest.raises(ValueError):
        I.current_state(spark, f"{workdir}/t", ["k"], "t", ["s"], ["wide"])


def test_changed_and_unchanged_are_all(spark):
    df = spark.createDataFrame([(1, dt.datetime(2024, 1, 1)), (2, dt.datetime(2024, 1, 2)), (3, None), (3, None)], "k int, t timestamp")
    mark = dt.datetime(2024, 1, 1)
    for inclusive in (False, True):
        changed, rest = B.changed_since(df, "t", mark, inclusive), B.unchanged_since(df, "t", mark, inclusive)
        assert sorted(map(str, rest.collect())) == sorted(map(str, df.exceptAll(changed).collect()))


def test_a_first_batch_is_reduced_once(spark, workdir, monkeypatch):
    calls, real = [], M.latest_per_key
    monkeypatch.setattr(M, "latest_per_key", lambda *a: calls.append(1) or real(*a))
    df = spark.createDataFrame([(1, "a", dt.datetime(2024, 1, 1)), (1, "b", dt.datetime(2024, 1, 2))], "flight_id bigint, payload string, updated_at timestamp")
    M.merge_batch(df, 0, f"{workdir}/m", ["flight_id"], "updated_at", buckets=4)
    assert len(calls) == 1 and [r[1] for r in M.read_merged(spark, f"{workdir}/m", df.schema).collect()] == ["b"]
