"""Raw readers (A1-A3), enrichment (P1), calendar (P2/C6) and dedupe (E1) on literal lines."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from wingspan.operators import enrich as C
from wingspan.plans import pipelines as P
from wingspan.sources import raw

AIRPORTS = [
    '1,"Alpha ""Intl""",Aville,US,AAA,KAAA,10.0,20.0,100,-5,A,America/New_York,airport,OurAirports',
    '2,"Back\\slash Field",Bville,France,BBB,LFBB,10.5,20.5,50,1,E,Europe/Paris,airport,OurAirports',
    '3,Gamma,Cville,ZZ,CCC,\\N,-33.9,151.2,10,10,O,\\N,airport,OurAirports',
    '4,No Code,Dville,US,\\N,KDDD,1.0,1.0,0,0,U,\\N,airport,OurAirports',
    '5,Rail,Eville,US,EEE,\\N,1.0,1.0,0,0,U,\\N,station,OurAirports',
]
AIRLINES = [
    '10,Old Air,\\N,XA,OLD,OLDCALL,US,N',
    '11,New Air,\\N,XA,NEW,NEWCALL,US,Y',
    '12,Second Air,\\N,XA,SEC,SECCALL,US,Y',
    '13,\\N,\\N,XB,NUL,\\N,US,Y',
    '14,Nation Air,\\N,NA,NAA,\\N,US,Y',
]
ROUTES = [
    'XA,11,AAA,1,BBB,2,Y,0,738 320',
    'XB,13,AAA,1,CCC,3,,\\N,\\N',
    'QQ,99,BBB,2,AAA,1,N,1,77W',
    '\\N,\\N,AAA,1,AAA,1,\\N,\\N,',
    'XA,11,ZZZ,9,AAA,1,,0,738',
    'XA,11,AAA,1,ZZZ,9,,0,738',
    'XA,11,ZZZ,9,YYY,8,,0,738',
    'XA,11,\\N,\\N,AAA,1,,0,738',
]


def write(workdir, name, lines):
    path = os.path.join(workdir, name)
    os.makedirs(path)
    with open(os.path.join(path, "part-0.csv"), "w") as fh:
        fh.write("\n".join(lines) + "\n")
    return path


@pytest.fixture()
def raw_paths(workdir):
    return (write(workdir, "airports", AIRPORTS), write(workdir, "airlines", AIRLINES),
            write(workdir, "routes", ROUTES))


def test_readers(spark, raw_paths):
    ap, al, rt = raw_paths
    airports = {r["airport_id"]: r for r in raw.read_airports(spark, ap, keep_all=True).collect()}
    assert airports[1]["name"] == 'Alpha "Intl"'
    assert airports[2]["name"] == "Back\\slash Field"
    assert airports[3]["icao_code"] is None
    kept = {r["iata_code"] for r in raw.read_airports(spark, ap).collect()}
    assert kept == {"AAA", "BBB", "CCC"}
    airlines = raw.read_airlines(spark, al).collect()
    assert {r["airline_id"] for r in airlines} == {11, 12, 13, 14}
    assert [r["iata_code"] for r in airlines if r["airline_id"] == 14] == [None]  # "NA" is a null token
    routes = raw.read_routes(spark, rt).collect()
    assert routes[1]["codeshare"] is None and routes[1]["stops"] is None and routes[3]["equipment"] is None


def test_enrich_routes(spark, raw_paths):
    ap, al, rt = raw_paths
    out = P.enrich_routes(raw.read_routes(spark, rt), raw.read_airports(spark, ap),
                          raw.read_airlines(spark, al)).collect()
    assert len(out) == 4  # four routes have both airports
    by = {(r["airline_code"], r["origin_airport"], r["destination_airport"]): r for r in out}
    a = by[("XA", "AAA", "BBB")]
    assert a["airline_name"] == "New Air"  # inactive first row skipped, then first active
    assert a["aircraft_type"] == "738" and a["codeshare"] is True and a["stops"] == 0
    assert a["origin_region"] == "North America" and a["destination_region"] == "Other"  # names are not codes
    assert 100 <= a["seats"] <= 220 and a["flight_number"].startswith("XA")
    b = by[("XB", "AAA", "CCC")]
    assert b["airline_name"] is None  # matched airline with null name stays null
    assert b["aircraft_type"] == "Unknown" and b["codeshare"] is False and b["stops"] == 0
    c = by[("QQ", "BBB", "AAA")]
    assert c["airline_name"] == "Unknown"
    d = [r for r in out if r["airline_code"] is None][0]
    assert d["airline_name"] == "Unknown" and float(d["distance_km"]) == 0.0 and d["flight_number"] is None


def test_unmatched_audit(spark, raw_paths):
    ap, _, rt = raw_paths
    n = C.unmatched_routes(raw.read_routes(spark, rt), raw.read_airports(spark, ap)).count()
    assert n == 4  # unknown origin, unknown destination, both, null origin: one each


def test_duplicate_airport_code_fails(spark, workdir):
    ap = write(workdir, "dup", AIRPORTS + ['6,Dup,Fville,US,AAA,\\N,1.0,1.0,0,0,U,\\N,airport,OurAirports'])
    rt = write(workdir, "r", ROUTES[:1])
    al = write(workdir, "a", AIRLINES)
    with pytest.raises(C.DuplicateKeyError):
        P.enrich_routes(raw.read_routes(spark, rt), raw.read_airports(spark, ap), raw.read_airlines(spark, al))


def test_calendar_expand_25_months(spark, raw_paths, workdir):
    ap, al, rt = raw_paths
    out = os.path.join(workdir, "fact")
    fact = P.run(spark, ap, al, rt, out, as_of=dt.date(2024, 5, 15))
    per_route = fact.groupBy("airline_code", "origin_airport", "destination_airport").count().collect()
    assert {r["count"] for r in per_route} == {25}
    dates = sorted({r[0] for r in fact.select("flight_date").distinct().collect()})
    assert dates[0] == dt.date(2022, 5, 15) and dates[1] == dt.date(2022, 6, 1) and dates[-1] == dt.date(2024, 5, 1)
    q = fact.filter(F.col("flight_month") == 5).select("flight_quarter").distinct().collect()
    assert [r[0] for r in q] == [2]


def test_region_lookup_first_wins(spark):
    lk = C.region_lookup_frame(spark, {"R1": ["AA", "BB"], "R2": ["BB", "CC"]})
    got = {r["country"]: r["region"] for r in lk.collect()}
    assert got == {"AA": "R1", "BB": "R1", "CC": "R2"}


def test_keep_first_follows_file_order(spark, workdir):
    # id order and file order disagree: the first active row in the file wins
    lines = ['20,Later Id First In File,\\N,XC,A20,\\N,US,Y', '15,Earlier Id,\\N,XC,A15,\\N,US,Y',
             '30,Inactive,\\N,XD,A30,\\N,US,N', '31,Only Active,\\N,XD,A31,\\N,US,Y']
    al = write(workdir, "airlines_order", lines)
    got = {r["iata_code"]: r["airline_id"] for r in C.dedupe_airlines(raw.read_airlines(spark, al)).collect()}
    assert got == {"XC": 20, "XD": 31}
    by_id = {r["iata_code"]: r["airline_id"] for r in
             C.dedupe_airlines(raw.read_airlines(spark, al, file_order=False)).collect()}
    assert by_id == {"XC": 15, "XD": 31}


def test_file_order_across_splits(spark, workdir):
    # a file read in several splits: the ordinal still follows the file
    path = os.path.join(workdir, "many")
    os.makedirs(path)
    with open(os.path.join(path, "part-0.csv"), "w") as fh:
        for i in range(20000):
            fh.write(f"{100000 - i},Air {i},\\N,C{i % 7},X,\\N,US,Y\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
        df = raw.read_airlines(spark, path, multi_line=False)
        assert df.rdd.getNumPartitions() > 3
        got = {r["iata_code"]: r["airline_id"] for r in C.dedupe_airlines(df).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == {f"C{k}": 100000 - k for k in range(7)}  # first line of each code in the file
