"""Distributed operators against brute force on small fixtures."""

import datetime as dt
import os
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from factfix import fact
from wingspan import schemas as S
from wingspan.operators import ordering as O
from wingspan.operators import windows as W
from wingspan.sources import profile as A
from wingspan.sources import raw
from wingspan.sources import sinks as K


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(7)
    # many ties in v, hot key 0 holding a third of the rows
    return [(i, (0 if i % 3 == 0 else rnd.randint(1, 40)), rnd.randint(0, 20)) for i in range(600)]


def test_running_sums_match_brute_force(spark, rows):
    df = spark.createDataFrame(rows, "id int, k int, v int")
    out = W.running_sums(df, [F.col("v").desc(), "id"], {"run": F.col("v"), "pos": F.lit(1)},
                         {"total": "run"}, blocks=5).collect()
    ordered = sorted(rows, key=lambda r: (-r[2], r[0]))
    expect, acc = {}, 0
    for pos, r in enumerate(ordered, start=1):
        acc += r[2]
        expect[r[0]] = (acc, pos)
    got = {r["id"]: (r["run"], r["pos"]) for r in out}
    assert got == expect
    assert {r["total"] for r in out} == {sum(r[2] for r in rows)}


def test_with_position_is_total_order(spark, rows):
    df = spark.createDataFrame(rows, "id int, k int, v int")
    got = sorted((r["position"], r["id"]) for r in W.with_position(df, ["v", "id"]).collect())
    assert [p for p, _ in got] == list(range(1, len(rows) + 1))
    assert [i for _, i in got] == [r[0] for r in sorted(rows, key=lambda r: (r[2], r[0]))]


def test_top_k_share_equals_full_ranking(spark, rows):
    df = spark.createDataFrame(rows, "id int, k int, v int").groupBy("k").agg(F.sum("v").alias("v"))
    full = {r["k"]: (r["share"], r["rank"]) for r in W.cumulative_share(df, "v", "k", out="share", rank_out="rank").collect()}
    top = W.top_k_share(df, "v", "k", 5, out="share", rank_out="rank").collect()
    assert len(top) == 5
    for r in top:
        assert full[r["k"]] == (r["share"], r["rank"])


def test_keep_first_and_latest(spark, rows):
    df = spark.createDataFrame(rows, "id int, k int, v int")
    first = {r["k"]: (r["id"], r["v"]) for r in W.keep_first(df, "k", ["id"]).collect()}
    latest = {r["k"]: (r["id"], r["v"]) for r in W.latest_per_key(df, ["k"], ["v", "id"]).collect()}
    for k in {r[1] for r in rows}:
        grp = [r for r in rows if r[1] == k]
        lo = min(grp, key=lambda r: r[0])
        hi = max(grp, key=lambda r: (r[2], r[0]))
        assert first[k] == (lo[0], lo[2]) and latest[k] == (hi[0], hi[2])


def test_sample_n_does_not_depend_on_partitions(spark):
    data = spark.range(5000).selectExpr("id", "CASE WHEN id % 7 = 0 THEN NULL ELSE concat('v', id % 90) END AS v", "id % 3 AS `a.b`")
    samples = [sorted(map(str, O.sample_n(data.repartition(k), 40, seed=5).collect())) for k in (2, 7)]
    assert samples[0] == samples[1] and len(set(samples[0])) == 40
    parts = [O.sample_n(data.filter(f"id % 2 = {k}"), 40, seed=5) for k in (0, 1)]
    assert sorted(map(str, O.sample_n(parts[0].union(parts[1]), 40, seed=5).collect())) == samples[0]
    assert sorted(map(str, O.sample_n(data, 40, seed=6).collect())) != samples[0]
    assert O.sample_n(data.limit(0), 5).collect() == []


def test_sample_n_exact_and_seeded(spark, rows):
    df = spark.createDataFrame(rows, "id int, k int, v int")
    a = [r["id"] for r in O.sample_n(df, 50, seed=3).collect()]
    b = [r["id"] for r in O.sample_n(df, 50, seed=3).collect()]
    assert len(a) == 50 == len(set(a)) and sorted(a) == sorted(b)
    assert len(O.sample_n(df, 10_000).collect()) == len(rows)


def test_top_k_and_recent_n(spark, rows):
    df = spark.createDataFrame(rows, "id int, k int, v int")
    got = [r["id"] for r in O.top_k(df, 7, [F.col("v").desc(), "id"]).collect()]
    assert got == [r[0] for r in sorted(rows, key=lambda r: (-r[2], r[0]))[:7]]
    got = [r["id"] for r in O.recent_n(df, 4, "v", "id").collect()]
    assert got == [r[0] for r in sorted(rows, key=lambda r: (r[2], r[0]), reverse=True)[:4]]


def test_versioned_overwrite(spark, workdir):
    base = os.path.join(workdir, "t")
    v1 = K.publish_version(spark.range(5), base)
    assert K.read_current(spark, base).count() == 5
    v2 = K.publish_version(spark.range(3), base)
    assert v1 != v2 and K.current_version(spark, base) == v2
    assert K.read_current(spark, base).count() == 3
    assert spark.read.parquet(os.path.join(base, v1)).count() == 5  # old version intact


def test_fact_csv_round_trip_edges(spark, workdir):
    rows = [dict(airline_name='Quote "Air"', distance_km=None, codeshare=True, aircraft_type="a,b"),
            dict(airline_name="Back\\slash", stops=3, flight_date=dt.date(2020, 2, 29))]
    df = fact(spark, rows)
    path = os.path.join(workdir, "csv")
    K.write_fact_csv(df, path)
    back = raw.read_fact_csv(spark, path)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_parquet_partitioned_round_trip(spark, workdir):
    rows = [dict(flight_date=dt.date(2020, m, 1), seats=m) for m in range(1, 13)]
    path = os.path.join(workdir, "pq")
    K.write_fact_parquet(fact(spark, rows), path)
    back = spark.read.schema(S.FACT).parquet(path)
    assert back.count() == 12
    assert sorted(os.listdir(os.path.join(path, "part_year=2020"))) == sorted(f"part_month={m}" for m in range(1, 13))


def test_table_profile_and_compare(spark, workdir):
    df = fact(spark, [dict(seats=s) for s in range(200)])
    K.write_fact_parquet(df, os.path.join(workdir, "col"))
    df.write.json(os.path.join(workdir, "row"))
    col = A.table_profile(spark, os.path.join(workdir, "col"), "parquet", layout="columnar", schema=S.FACT)
    row = A.table_profile(spark, os.path.join(workdir, "row"), "json", layout="row", schema=S.FACT)
    c, r = col.collect()[0], row.collect()[0]
    assert c["row_count"] == r["row_count"] == 200 and c["files"] >= 1
    both = A.compare_storage(row, col).collect()[0]
    assert both["row_row_count"] == 200 and both["col_layout"] == "columnar"
    expected = round(r["total_mb"] / c["total_mb"], 2) if c["total_mb"] else 0.0
    assert both["compression_ratio"] == expected


def test_decimal_sum_exact(spark):
    df = fact(spark, [dict(seats=3, distance_km=Decimal("0.10")) for _ in range(10)])
    got = df.agg(F.sum(F.col("seats") * F.col("distance_km")).alias("x")).collect()[0]["x"]
    assert got == Decimal("3.00")
