"""Distinct counts from monthly bitmaps: Q1 and Q4 equal to the ones on the fact, for odd rows, days and refreshes."""

import datetime as dt

import pytest
from factfix import fact as make
from pyspark.sql import functions as F

from wingspan.operators import distinct as D
from wingspan.plans import catalog as Q
from wingspan.plans import rollups as U
from wingspan.plans.fixture import read_fact
from wingspan.sources.sinks import write_fact_parquet

DAYS = [dt.date(2023, 1, 15), dt.date(2023, 3, 31), dt.date(2023, 4, 1), dt.date(2023, 4, 2), dt.date(2024, 2, 29), dt.date(2024, 3, 10)]


def rows():
    out = []
    for i in range(240):
        out.append(dict(flight_number=None if i % 17 == 0 else f"F{i % 70:05d}", airline_code=None if i % 23 == 0 else f"A{i % 9}",
                        origin_airport=None if i % 29 == 0 else f"H{i % 12 if i % 3 else 0}", seats=None if i % 31 == 0 else 100 + i % 50,
                        flight_date=None if i % 37 == 0 else DAYS[i % len(DAYS)]))
    return out + out[:60]  # repeated rows


def written(spark, path, data, mode="errorifexists"):
    write_fact_parquet(make(spark, data), path, mode=mode)
    return read_fact(spark, path)


def same(fact, base_hubs, base_trends, as_of):
    assert U.top_10_hubs(fact, base_hubs, as_of).collect() == Q.top_10_hubs(fact, as_of).collect()
    assert U.capacity_trends(fact, base_trends, as_of).collect() == Q.capacity_trends(fact, as_of).collect()


def test_equal_for_every_day(spark, workdir):
    fact = written(spark, f"{workdir}/fact", rows())
    U.build(fact, U.HUBS, f"{workdir}/hubs")
    U.build(fact, U.TRENDS, f"{workdir}/trends")
    for as_of in ("2024-04-01", "2024-04-02", "2024-03-31", "2025-02-28", "2030-01-01"):
        same(fact, f"{workdir}/hubs", f"{workdir}/trends", as_of)


def test_refresh_touches_its_months_only(spark, workdir):
    fact = written(spark, f"{workdir}/fact", rows())
    U.build(fact, U.HUBS, f"{workdir}/hubs")
    U.build(fact, U.TRENDS, f"{workdir}/trends")
    files = lambda: {r[0] for r in spark.read.parquet(f"{workdir}/hubs/months").select("_metadata.file_path").distinct().collect()}
    before = files()
    codes = dict(map(tuple, U.read_current(spark, f"{workdir}/hubs/codes").collect()))
    changed = [r | dict(flight_number="A-new", airline_code="ZZ") if r["flight_date"] == DAYS[5] else r for r in rows() if r["flight_date"] != DAYS[4]]
    fact = written(spark, f"{workdir}/fact2", changed)
    for rollup, name in ((U.HUBS, "hubs"), (U.TRENDS, "trends")):
        U.refresh(fact, rollup, f"{workdir}/{name}", [(2024, 3), (2024, 2)])
    same(fact, f"{workdir}/hubs", f"{workdir}/trends", "2024-04-10")
    untouched = {f for f in before if "part_year=2023" in f}
    assert untouched and untouched <= files() and not any("part_month=2/" in f for f in files())
    now = dict(map(tuple, U.read_current(spark, f"{workdir}/hubs/codes").collect()))
    assert codes.items() <= now.items() and now["A-new"] == len(codes) + 1


def test_many_buckets(spark):
    """Codes over several buckets, and a hub that holds a third of all rows."""
    data = spark.range(100_000).select(
        F.lit(2024).alias("part_year"), (F.col("id") % 12 + 1).cast("int").alias("part_month"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("h"), (F.col("id") % 50).cast("string"))).alias("hub"),
        (F.col("id") % 70_000).alias("value"),
    )
    codes = D.dense_codes(data, "value")
    assert tuple(codes.agg(F.min(D.CODE), F.max(D.CODE), F.countDistinct(D.CODE)).first()) == (1, 70_000, 70_000)
    parts = D.month_bitmaps(data, codes, ["hub"], "value", {"n": F.count(F.lit(1))})
    got = {r.hub: (r.d, r.n) for r in D.merged(parts, ["hub"], "d", ["n"]).collect()}
    assert got == {r.hub: (r.d, r.n) for r in data.groupBy("hub").agg(F.countDistinct("value").alias("d"), F.count(F.lit(1)).alias("n")).collect()}


def test_missing_code_fails(spark, workdir):
    data = spark.createDataFrame([(2024, 1, "x", "a"), (2024, 1, "x", "b")], "part_year int, part_month int, hub string, value string")
    codes = D.dense_codes(data.filter("value = 'a'"), "value")
    with pytest.raises(Exception, match="no code for value b"):
        D.month_bitmaps(data, codes, ["hub"], "value", {"n": F.count(F.lit(1))}).collect()


def test_empty_fact(spark, workdir):
    fact = written(spark, f"{workdir}/fact", rows())
    U.build(fact, U.HUBS, f"{workdir}/hubs")
    assert U.top_10_hubs(fact, f"{workdir}/hubs", "2040-01-01").collect() == []
