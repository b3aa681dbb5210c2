"""CSV fidelity: blanks, line breaks, quotes and backslashes survive; rows that do not parse are not silently null."""

import datetime as dt

import pytest

from factfix import fact
from wingspan import schemas as S
from wingspan.sources import raw, sinks

TEXTS = [" lead", "trail ", "two\nlines", 'a "quoted" word', "back\\slash", "comma, and ' more", "x"]


def test_fact_csv(spark, workdir):
    rows = [dict(airline_name=t, origin_city=t, flight_number=f"F{i}") for i, t in enumerate(TEXTS)]
    f = fact(spark, rows)
    back = raw.read_fact_csv(spark, sinks.write_fact_csv(f, workdir + "/f"))
    assert sorted(back.collect()) == sorted(f.collect())


def test_raw(spark, workdir):
    rows = [(i, t, t, None, f"A{i}", None, "c", "Y") for i, t in enumerate(TEXTS)]
    airlines = spark.createDataFrame(rows, S.AIRLINES)
    back = raw.read_raw(spark, raw.write_raw(airlines, workdir + "/r"), S.AIRLINES, multi_line=True)
    assert sorted(back.collect(), key=str) == sorted(airlines.collect(), key=str)


SCHEMA = S.T.StructType([S.T.StructField("k", S.T.LongType()), S.T.StructField("s", S.T.StringType()),
                         S.T.StructField("codeshare", S.T.BooleanType()), S.T.StructField("at", S.T.TimestampType())])


def test_change_csv(spark, workdir):
    at = [dt.datetime(2024, 1, 15, 10, 0, 0), dt.datetime(2024, 1, 15, 10, 0, 0, 120)]
    rows = [(i, t, [True, False, None][i % 3], at[i % 2]) for i, t in enumerate(TEXTS)]
    changes = spark.createDataFrame(rows, SCHEMA)
    back = raw.read_change_csv(spark, raw.write_change_csv(changes, workdir + "/c"), SCHEMA)
    assert sorted(back.collect()) == sorted(changes.collect())


def test_change_csv_at_second_precision(spark, tmp_path):
    (tmp_path / "a.csv").write_text("1,x,1,2024-01-15 10:00:00\n2,y,0,2024-01-15 10:00:00.5\n")
    got = raw.read_change_csv(spark, str(tmp_path), SCHEMA).collect()
    assert [tuple(r) for r in got] == [(1, "x", True, dt.datetime(2024, 1, 15, 10)), (2, "y", False, dt.datetime(2024, 1, 15, 10, 0, 0, 500000))]


def test_rows_that_do_not_parse_fail(spark, tmp_path):
    (tmp_path / "a.csv").write_text("1,x,1,2024-01-15 10:00:00\nnope,y,0,yesterday\n")
    with pytest.raises(raw.UnparsedRowsError):
        raw.read_change_csv(spark, str(tmp_path), SCHEMA)
