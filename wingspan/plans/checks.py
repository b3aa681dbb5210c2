"""Registered queries: name -> callable(spark, sf_dir) -> DataFrame.

Each reads the provided tables (or the fact Spark derives from them) in
full. Outputs use plain types so they compare 1:1 with the SQL oracle:
integers as bigint, decimals as double, dates and timestamps as ISO text.
"""

from __future__ import annotations

import datetime as dt
import hashlib
from functools import partial, reduce
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wingspan import schemas as S
from wingspan.functions import exprs as X
from wingspan.operators import enrich as C
from wingspan.operators import filters as B
from wingspan.operators import ordering as O
from wingspan.operators import checksum as CS
from wingspan.operators import reconcile as G
from wingspan.operators import windows as W
from wingspan.plans import catalog as Q
from wingspan.plans import pipelines as P
from wingspan.plans import raw_fixture as R
from wingspan.plans import rollups as U
from wingspan.plans.fixture import fact_path, flights, flights_frame, rollup_path, table, write_fact_table
from wingspan.session import scratch_path
from wingspan.sources import profile as A
from wingspan.sources import raw as RAW
from wingspan.sources import sinks as K
from wingspan.sources.table_feed import table_changes
from wingspan.streaming import merged as MERGED
from wingspan.streaming import sync as I
from wingspan.streaming import windows as WINDOWS

AS_OF = dt.date(2001, 8, 1)

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(name: str):
    def deco(fn):
        REGISTRY[name] = fn
        return fn

    return deco


def plain(df: DataFrame) -> DataFrame:
    """Cast every column to bigint / double / string / boolean."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        t = f.dataType
        if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            c = c.cast("bigint")
        elif isinstance(t, (T.DecimalType, T.FloatType)):
            c = c.cast("double")
        elif isinstance(t, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(t, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flights(spark, sf_dir)


# ---------------------------------------------------------------------------------
# The named catalogue
# ---------------------------------------------------------------------------------
def _catalog(key: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return plain(Q.run(key, fact(spark, sf_dir), AS_OF))

    return run


for _key in ["top_10_hubs", "regional_capacity", "underserved_routes", "capacity_trends",
             "distance_analysis", "hub_concentration", "capacity_trend_series", "month_over_month"]:
    register(_key)(_catalog(_key))


# Q1 and Q4 from monthly bitmaps
@register("top_10_hubs_rollup")
def _top_10_hubs_rollup(spark, sf_dir):
    return plain(U.top_10_hubs(fact(spark, sf_dir), rollup_path(spark, sf_dir, "HUBS"), AS_OF))


@register("capacity_trends_rollup")
def _capacity_trends_rollup(spark, sf_dir):
    return plain(U.capacity_trends(fact(spark, sf_dir), rollup_path(spark, sf_dir, "TRENDS"), AS_OF))


@register("regional_flow_matrix")
def _regional_flow_matrix(spark, sf_dir):
    # region names of the fixture: a dimension table (5 rows by definition)
    most = int(spark.conf.get("spark.sql.pivotMaxValues"))
    names = [r[0] for r in table(spark, sf_dir, "region").select("r_name").distinct().limit(most + 1).collect()]
    if len(names) > most:
        raise ValueError(f"more than {most} destination regions: raise spark.sql.pivotMaxValues")
    return plain(Q.regional_flow_matrix(fact(spark, sf_dir), AS_OF, regions=sorted(names)))


# ---------------------------------------------------------------------------------
# Operator-level queries
# ---------------------------------------------------------------------------------
CHANGE_MARK = dt.datetime(2024, 1, 15, 0, 0, 0)
CHANGE_AS_OF = dt.datetime(2024, 1, 20, 12, 0, 0)


def events(spark, sf_dir):
    return table(spark, sf_dir, "events")


# B1 / H11
@register("trailing_months")
def _trailing_months(spark, sf_dir):
    f = B.trailing_months(fact(spark, sf_dir), 12, AS_OF)
    return plain(f.select("airline_code", "flight_number", "origin_airport", "destination_airport",
                          "flight_date", "seats"))


# B2
@register("null_equality_filter")
def _null_equality_filter(spark, sf_dir):
    return plain(B.not_null_and_equal(R.airports_raw(spark, sf_dir), "iata_code", "type", "airport"))


# B3
@register("flag_filter")
def _flag_filter(spark, sf_dir):
    return plain(B.flag_filter(R.airlines_raw(spark, sf_dir), "active", "Y"))


# B6
@register("having_or")
def _having_or(spark, sf_dir):
    return plain(Q.underserved_groups(fact(spark, sf_dir), AS_OF))


# B7
@register("project_alias")
def _project_alias(spark, sf_dir):
    f = fact(spark, sf_dir)
    return plain(f.select(F.col("origin_airport").alias("hub"), F.col("origin_city").alias("hub_city"),
                          F.col("seats").alias("capacity"), F.col("distance_km").alias("km")))


# B8 / H5
@register("distance_band")
def _distance_band(spark, sf_dir):
    f = fact(spark, sf_dir)
    return plain(f.select("flight_number", "distance_km",
                          X.distance_band("distance_km").alias("distance_category"),
                          X.band_rank(X.distance_band("distance_km")).alias("band_rank")))


# B9 / H2
@register("date_parts")
def _date_parts(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber",
                                                F.col("l_shipdate").cast("date").alias("ship_date"))
    out = B.with_date_parts(li, "ship_date", "ship_").withColumn(
        "quarter_from_month", X.quarter_of_month(F.col("ship_month")))
    return plain(out)


# B10
@register("override_projection")
def _override_projection(spark, sf_dir):
    out = B.override_dates(fact(spark, sf_dir), AS_OF)
    return plain(out.select("flight_number", "origin_airport", "destination_airport", "seats",
                            "flight_date", "flight_year", "flight_month", "flight_quarter"))


# B11 / A13
@register("named_projection")
def _named_projection(spark, sf_dir):
    return plain(B.named_projection(fact(spark, sf_dir), S.FACT_TABLE_ORDER))


# The fact in its table form: key first, audit times last
def fact_table(spark, sf_dir):
    return flights_frame(spark, sf_dir, table_form=True)


FACT_MARK = dt.datetime(2001, 7, 1, 0, 0, 0)


# B11 / A13 on the table form (27 columns)
@register("fact_table_projection")
def _fact_table_projection(spark, sf_dir):
    return plain(B.named_projection(fact_table(spark, sf_dir), S.FACT_WITH_AUDIT.fieldNames()))


# B4 on the table form
@register("fact_incremental")
def _fact_incremental(spark, sf_dir):
    return plain(B.changed_since(fact_table(spark, sf_dir), "updated_at", FACT_MARK))


# A8 on the table form: flags as 0/1, times to the second
@register("fact_csv_append")
def _fact_csv_append(spark, sf_dir):
    base = scratch_path(spark, "fact-changes")
    RAW.write_change_csv(B.changed_since(fact_table(spark, sf_dir), "updated_at", FACT_MARK), f"{base}/incoming")
    K.append(RAW.read_change_csv(spark, f"{base}/incoming"), f"{base}/target")
    return plain(spark.read.schema(S.FACT_WITH_AUDIT).parquet(f"{base}/target"))


SYNCED = ["flight_id", "flight_number", "seats", "codeshare", "created_at", "updated_at"]


# P4 / I1 / E4 on the table form: every row, then the changed rows again with a seat more and a later time
@register("fact_sync")
def _fact_sync(spark, sf_dir):
    base = scratch_path(spark, "fact-sync")
    rows = fact_table(spark, sf_dir)
    rows.write.parquet(f"{base}/feed")
    later = {"seats": F.col("seats") + 1, "updated_at": F.col("updated_at") + F.expr("INTERVAL 1 MINUTE")}
    B.changed_since(rows, "updated_at", FACT_MARK).withColumns(later).write.mode("append").parquet(f"{base}/feed")
    stream = I.change_stream(spark, f"{base}/feed", S.FACT_WITH_AUDIT)
    I.sync_once(stream, f"{base}/target", f"{base}/checkpoint")
    # order and line number repeat in the provided tables: ties go to the larger row
    ties = ["flight_number", "seats", "created_at", "codeshare"]
    return plain(I.current_state(spark, f"{base}/target", ["flight_id"], "updated_at", ties, SYNCED))


# The table itself is read by its mark, before and after rows were updated in it
@register("table_feed_sync")
def _table_feed_sync(spark, sf_dir):
    base = scratch_path(spark, "table-feed")
    later = {"seats": F.col("seats") + 1, "updated_at": F.col("updated_at") + F.expr("INTERVAL 1 MINUTE")}

    def rest(rows):
        return B.unchanged_since(rows, "updated_at", FACT_MARK)

    def updated(rows):
        return rest(rows).unionByName(B.changed_since(rows, "updated_at", FACT_MARK).withColumns(later).select(*rows.columns))

    for version in (rest, updated):
        write_fact_table(spark, sf_dir, f"{base}/table", mode="overwrite", change=version)
        I.sync_once(table_changes(spark, f"{base}/table", S.FACT_WITH_AUDIT, "updated_at", "flight_id"), f"{base}/target", f"{base}/checkpoint")
    K.remove(spark, f"{base}/table")  # all of it is in the target
    ties = ["flight_number", "seats", "created_at", "codeshare"]
    return plain(I.current_state(spark, f"{base}/target", ["flight_id"], "updated_at", ties, SYNCED))


# The copy is merged as it is written
@register("fact_sync_merged")
def _fact_sync_merged(spark, sf_dir):
    base = scratch_path(spark, "fact-merged")
    later = {"seats": F.col("seats") + 1, "updated_at": F.col("updated_at") + F.expr("INTERVAL 1 MINUTE")}
    ties = ["flight_number", "seats", "created_at", "codeshare"]

    def changed(rows):
        return B.changed_since(rows, "updated_at", FACT_MARK).withColumns(later)

    for version in (None, changed):
        write_fact_table(spark, sf_dir, f"{base}/feed", mode="append", change=version)
        stream = I.change_stream(spark, f"{base}/feed", S.FACT_WITH_AUDIT)
        MERGED.sync_merged(stream, f"{base}/copy", f"{base}/checkpoint", ["flight_id"], "updated_at", ties, buckets=16).awaitTermination()
    K.remove(spark, f"{base}/feed")  # all of it is merged
    return plain(MERGED.read_merged(spark, f"{base}/copy", S.FACT_WITH_AUDIT)
                 .select("flight_id", "flight_number", "seats", "codeshare", "created_at", "updated_at"))


# D1
@register("agg_count")
def _agg_count(spark, sf_dir):
    return plain(fact(spark, sf_dir).groupBy("origin_region").agg(F.count(F.lit(1)).alias("flights")))


# D2
@register("agg_count_distinct")
def _agg_count_distinct(spark, sf_dir):
    return plain(fact(spark, sf_dir).groupBy("origin_region").agg(
        F.countDistinct("flight_number").alias("distinct_flight_numbers"),
        F.countDistinct("airline_code").alias("distinct_airlines")))


# D3
@register("agg_sum")
def _agg_sum(spark, sf_dir):
    return plain(fact(spark, sf_dir).groupBy("destination_region").agg(F.sum("seats").alias("total_seats")))


# D4
@register("agg_avg")
def _agg_avg(spark, sf_dir):
    return plain(fact(spark, sf_dir).groupBy("origin_airport").agg(
        X.mean("seats", *X.SEATS_SCALE).alias("avg_seats"), X.mean("distance_km", *X.DISTANCE_SCALE).alias("avg_distance")))


# D5
@register("agg_sum_product")
def _agg_sum_product(spark, sf_dir):
    return plain(fact(spark, sf_dir).groupBy("origin_airport", "destination_region").agg(
        F.sum(F.col("seats") * F.col("distance_km")).alias("capacity_kilometers")))


# D6
@register("agg_min_max")
def _agg_min_max(spark, sf_dir):
    return plain(fact(spark, sf_dir).agg(
        F.count(F.lit(1)).alias("flights"), F.min("flight_date").alias("earliest"),
        F.max("flight_date").alias("latest"), F.min("seats").alias("min_seats"),
        F.max("seats").alias("max_seats")))


# D7
@register("group_multi")
def _group_multi(spark, sf_dir):
    return plain(fact(spark, sf_dir).groupBy("origin_region", "destination_region", "aircraft_type").agg(
        F.count(F.lit(1)).alias("flights"), F.sum("seats").alias("total_seats")))


# D8
@register("group_alias")
def _group_alias(spark, sf_dir):
    f = fact(spark, sf_dir).withColumn("distance_category", X.distance_band("distance_km"))
    return plain(f.groupBy("distance_category").agg(F.count(F.lit(1)).alias("flights"),
                                                     F.sum("seats").alias("total_seats")))


# D10
@register("global_count")
def _global_count(spark, sf_dir):
    return plain(fact(spark, sf_dir).agg(F.count(F.lit(1)).alias("row_count")))


# E1
@register("dedupe_first")
def _dedupe_first(spark, sf_dir):
    active = B.flag_filter(R.airlines_raw(spark, sf_dir), "active", "Y")
    return plain(C.dedupe_airlines(active).select("airline_id", "iata_code", "name", "country", "active"))


# E4
@register("latest_per_key")
def _latest_per_key(spark, sf_dir):
    return plain(W.latest_per_key(events(spark, sf_dir), ["user_id"], ["ts", "event_id"]))


# E2 over every hub (block-wise running sums)
@register("hub_concentration_all")
def _hub_concentration_all(spark, sf_dir):
    return plain(Q.hub_concentration(fact(spark, sf_dir), AS_OF, top=None))


# F1
@register("sort_desc")
def _sort_desc(spark, sf_dir):
    q2 = Q.regional_capacity(fact(spark, sf_dir), AS_OF)
    return plain(W.with_position(q2, [F.col("total_capacity").desc(), "origin_region", "destination_region"]))


# F2
@register("sort_multi")
def _sort_multi(spark, sf_dir):
    q4 = Q.capacity_trends(fact(spark, sf_dir), AS_OF)
    return plain(W.with_position(q4, ["flight_year", "flight_month", "origin_region"]))


# F3
@register("sort_by_rank")
def _sort_by_rank(spark, sf_dir):
    q5 = Q.distance_analysis(fact(spark, sf_dir), AS_OF)
    return plain(W.with_position(q5, [X.band_rank("distance_category")]))


# F4
@register("top_k")
def _top_k(spark, sf_dir):
    per_airline = fact(spark, sf_dir).groupBy("airline_code").agg(F.sum("seats").alias("total_seats"))
    top = O.top_k(per_airline, 10, [F.col("total_seats").desc(), "airline_code"])
    return plain(W.position_in_limited(top, [F.col("total_seats").desc(), "airline_code"]))


# F5 / I4
@register("recent_n")
def _recent_n(spark, sf_dir):
    top = O.recent_n(events(spark, sf_dir), S.FIRST_SYNC_ROWS, "ts", "event_id")
    return plain(W.position_in_limited(top, [F.col("ts").desc(), F.col("event_id").desc()]))


# F6
@register("sample_n")
def _sample_n(spark, sf_dir):
    """One checked row: how many rows the sample has and how many of them stand in the fact."""
    f = fact(spark, sf_dir).select(*S.FACT_COLUMNS)
    sample = O.sample_n(f, 100, seed=17)
    held = sample.distinct().join(f, [sample[c].eqNullSafe(f[c]) for c in S.FACT_COLUMNS], "left_anti")
    missing = held.agg(F.count(F.lit(1)).alias("n")).select(F.lit(0).alias("s"), F.col("n").alias("m"))
    counts = sample.agg(F.count(F.lit(1)).alias("n")).select(F.col("n").alias("s"), F.lit(0).alias("m")).union(missing)
    return plain(counts.agg(F.sum("s").alias("sample_rows"), F.sum("m").alias("not_in_fact")))


# the very rows, which depend on the values and the seed alone
@register("sample_n_rows")
def _sample_n_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    return plain(O.sample_n(rows, 100, seed=17))


# F8
@register("ordered_changes")
def _ordered_changes(spark, sf_dir):
    changed = B.changed_since(events(spark, sf_dir), "ts", CHANGE_MARK)
    return plain(W.with_position(changed, ["ts", "event_id"]))


# B4
@register("incremental_since")
def _incremental_since(spark, sf_dir):
    return plain(B.changed_since(events(spark, sf_dir), "ts", CHANGE_MARK))


# B5
@register("recent_changes")
def _recent_changes(spark, sf_dir):
    return plain(B.recent_window(events(spark, sf_dir), "ts", CHANGE_AS_OF, minutes=1))


# I7 (with D6)
@register("change_window_report")
def _change_window_report(spark, sf_dir):
    return plain(I.change_window_report(events(spark, sf_dir), "ts", CHANGE_AS_OF, minutes=1))


# G1
@register("append_union")
def _append_union(spark, sf_dir):
    rows = fact(spark, sf_dir).select(*S.FACT_COLUMNS)
    out = K.union_by_name(rows, B.override_dates(rows, AS_OF))
    return plain(out.select("flight_number", "origin_airport", "seats", "flight_date"))


# G2
@register("reconcile_equal")
def _reconcile_equal(spark, sf_dir):
    f = fact(spark, sf_dir)
    left = Q.regional_capacity(f, AS_OF)
    view = "flights_" + hashlib.sha1(sf_dir.encode()).hexdigest()[:10]
    f.createOrReplaceTempView(view)
    cutoff = B.trailing_cutoff(AS_OF, 6).isoformat()
    u = "CAST(SUM(distance_km) * 100 AS DECIMAL(38,0))"  # exact sum in cents
    right = spark.sql(f"""
        SELECT origin_region, destination_region, COUNT(*) AS route_count,
               CAST(SUM(seats) AS BIGINT) AS total_capacity,
               CAST(sign({u}) * ((2 * abs({u}) * 10000 + COUNT(distance_km)) div (2 * COUNT(distance_km)))
                    AS DOUBLE) / 1000000.0 AS avg_distance,
               CAST(SUM(seats * distance_km) AS DOUBLE) AS capacity_kilometers
        FROM {view} WHERE flight_date >= DATE '{cutoff}'
        GROUP BY origin_region, destination_region""")
    return plain(G.compare(left, right))


@register("reconcile_diff")
def _reconcile_diff(spark, sf_dir):
    left = Q.regional_capacity(fact(spark, sf_dir), AS_OF)
    right = left.withColumns({
        "capacity_kilometers": F.when(F.col("destination_region") == "AFRICA",
                                      F.col("capacity_kilometers") + 0.0005).otherwise(F.col("capacity_kilometers")),
        "route_count": F.when(F.col("destination_region") == "ASIA",
                              F.col("route_count") + 1).otherwise(F.col("route_count")),
    })
    return plain(G.compare(left, right, tolerance=0.001))


# G2 on the fact's table form by a checksum tree: a copy that lost and edited some rows
@register("reconcile_tree")
def _reconcile_tree(spark, sf_dir):
    path = scratch_path(spark, "fact-tree")
    write_fact_table(spark, sf_dir, path)  # joined once: the tree reads both copies on every level
    left = spark.read.schema(S.FACT_WITH_AUDIT).parquet(path)
    right = left.filter(F.coalesce(F.col("flight_id") % 1000 != 8, F.lit(True))).withColumn(
        "seats", F.when(F.col("flight_id") % 1000 == 7, F.col("seats") + 1).otherwise(F.col("seats")).cast(left.schema["seats"].dataType))
    return plain(CS.compare_by_tree(left, right, ["flight_id"]))


# G2 as the reference uses it: every core query on two copies of the fact
@register("layouts_agree")
def _layouts_agree(spark, sf_dir):
    path = scratch_path(spark, "row-copy")
    K.write_fact_csv(fact(spark, sf_dir), path, compression="gzip")
    return plain(Q.compare_copies(fact(spark, sf_dir), RAW.read_fact_csv(spark, path), AS_OF))


# G3
@register("sync_check")
def _sync_check(spark, sf_dir):
    return plain(G.copy_counts(table(spark, sf_dir, "lineitem"), fact(spark, sf_dir)))


# A10
@register("validate_count")
def _validate_count(spark, sf_dir):
    return plain(G.validate_count(fact(spark, sf_dir), table(spark, sf_dir, "lineitem")))


def _airports_ok(airports):
    """A1's filter: a code and type ``airport``."""
    return B.not_null_and_equal(airports, "iata_code", "type", "airport")


def _matched_routes(spark, sf_dir):
    airports, _, routes = R.raw_frames(spark, sf_dir)
    ok = _airports_ok(airports)
    return C.join_destination(C.join_origin(routes, ok), ok)


# H1
@register("haversine_pairs")
def _haversine_pairs(spark, sf_dir):
    j = _matched_routes(spark, sf_dir)
    return plain(j.select("origin_airport", "destination_airport",
                          X.haversine_km("o_latitude", "o_longitude", "d_latitude", "d_longitude").alias("distance_km"))
                 .distinct())


# H4
@register("day_range")
def _day_range(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    start = F.col("o_orderdate").cast("date")
    span = F.substring("o_orderpriority", 1, 1).cast("int") - 1
    out = o.select("o_orderkey", F.explode(X.day_series(start, F.date_add(start, span))).alias("day"))
    return plain(out)


# H3
@register("month_range")
def _month_range(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    start = F.col("o_orderdate").cast("date")
    out = o.select("o_orderkey", F.explode(X.month_start_series(start, F.add_months(start, 3))).alias("month_date"))
    return plain(out)


def _routes_with_distance(spark, sf_dir):
    j = _matched_routes(spark, sf_dir)
    return j.withColumn("distance", X.haversine_km("o_latitude", "o_longitude", "d_latitude", "d_longitude"))


# H6
@register("seat_estimate")
def _seat_estimate(spark, sf_dir):
    j = _routes_with_distance(spark, sf_dir)
    return plain(j.select("airline_id", "origin_airport_id", "destination_airport_id", "distance",
                          X.seat_estimate(F.col("distance"), P.route_seed()).alias("seats")))


# H6b
@register("seat_estimate_aircraft")
def _seat_estimate_aircraft(spark, sf_dir):
    j = _routes_with_distance(spark, sf_dir)
    code = X.first_token("equipment")
    seats = F.coalesce(F.element_at(X.aircraft_seats_map(), code),
                       X.seat_estimate(F.col("distance"), P.route_seed()))
    return plain(j.select("airline_id", "origin_airport_id", "destination_airport_id",
                          code.alias("aircraft_type"), seats.alias("seats")))


# H7
@register("flight_number")
def _flight_number(spark, sf_dir):
    r = R.routes_raw(spark, sf_dir)
    return plain(r.select("airline_code", "airline_id", "origin_airport_id", "destination_airport_id",
                          X.flight_number("airline_code", P.number_seed()).alias("flight_number")))


# H8
@register("first_token")
def _first_token(spark, sf_dir):
    r = R.routes_raw(spark, sf_dir)
    return plain(r.select("airline_code", "origin_airport", "equipment",
                          X.first_token("equipment").alias("aircraft_type")))


# H9
@register("flag_to_int")
def _flag_to_int(spark, sf_dir):
    r = R.routes_raw(spark, sf_dir)
    return plain(r.select("airline_code", "origin_airport", "codeshare",
                          X.flag_to_int("codeshare").alias("codeshare_flag")))


# H10
@register("null_default")
def _null_default(spark, sf_dir):
    r = R.routes_raw(spark, sf_dir)
    return plain(r.select("airline_code", "origin_airport", "stops", X.int_or_default("stops").alias("stops_or_zero")))


# H13
@register("safe_ratio")
def _safe_ratio(spark, sf_dir):
    f = fact(spark, sf_dir)
    g = f.groupBy("origin_airport", "stops").agg(
        F.sum(F.when(F.col("codeshare"), F.col("seats")).otherwise(0)).alias("codeshare_seats"),
        F.sum(F.when(~F.col("codeshare"), F.col("seats")).otherwise(0)).alias("own_seats"))
    return plain(g.withColumn("ratio", X.safe_ratio("codeshare_seats", "own_seats")))


# H14
@register("size_mb")
def _size_mb(spark, sf_dir):
    f = fact(spark, sf_dir)
    text_bytes = (F.length("airline_name") + F.length("flight_number") + F.length("origin_airport")
                  + F.length("destination_airport") + F.length("aircraft_type"))
    g = f.groupBy("flight_year").agg(F.sum(text_bytes).alias("text_bytes"))
    return plain(g.withColumn("text_mb", X.bytes_to_mb("text_bytes")))


# C1
@register("origin_join")
def _origin_join(spark, sf_dir):
    airports, _, routes = R.raw_frames(spark, sf_dir)
    j = C.join_origin(routes, _airports_ok(airports))
    return plain(j.select("airline_code", "origin_airport", "destination_airport", "o_city", "o_country",
                          "o_latitude", "o_longitude"))


# C2
@register("destination_join")
def _destination_join(spark, sf_dir):
    airports, _, routes = R.raw_frames(spark, sf_dir)
    j = C.join_destination(routes, _airports_ok(airports))
    return plain(j.select("airline_code", "origin_airport", "destination_airport", "d_city", "d_country",
                          "d_latitude", "d_longitude"))


# C3
@register("airline_left_default")
def _airline_left_default(spark, sf_dir):
    _, airlines, routes = R.raw_frames(spark, sf_dir)
    firsts = C.dedupe_airlines(B.flag_filter(airlines, "active", "Y"))
    j = C.join_airline(routes, firsts)
    return plain(j.select("airline_code", "airline_id", "origin_airport", "destination_airport", "airline_name"))


# C4
@register("unmatched_audit")
def _unmatched_audit(spark, sf_dir):
    airports, _, routes = R.raw_frames(spark, sf_dir)
    missed = C.unmatched_routes(routes, _airports_ok(airports))
    return plain(missed.agg(F.count(F.lit(1)).alias("unmatched_routes")))


# C5
@register("region_lookup")
def _region_lookup(spark, sf_dir):
    airports = R.airports_raw(spark, sf_dir)
    out = C.with_region(airports, "country", "region", C.region_lookup_frame(spark))
    return plain(out.select("airport_id", "country", "region"))


# C6
@register("calendar_expand")
def _calendar_expand(spark, sf_dir):
    routes = R.routes_raw(spark, sf_dir).select("airline_code", "origin_airport", "destination_airport").distinct()
    start = X.add_months(AS_OF, -S.HISTORY_MONTHS)
    return plain(C.expand_calendar(routes, start, AS_OF))


def _raw_round_trip(spark, sf_dir):
    """Stage the raw-shaped frames as raw files, then read them back (A1-A3)."""
    base = scratch_path(spark, "raw")
    airports, airlines, routes = R.raw_frames(spark, sf_dir)
    RAW.write_raw(airports, f"{base}/airports")
    # staged in id order (range-partitioned, part files in key order), as the
    # reference's airline file is; keep-first then follows file order
    RAW.write_raw(airlines.orderBy("airline_id"), f"{base}/airlines")
    RAW.write_raw(routes, f"{base}/routes")
    return base


# P1 / A1 A2 A3 A13
@register("enrich_routes")
def _enrich_routes(spark, sf_dir):
    base = _raw_round_trip(spark, sf_dir)
    enriched = P.enrich_routes(
        RAW.read_routes(spark, f"{base}/routes"),
        RAW.read_airports(spark, f"{base}/airports"),
        RAW.read_airlines(spark, f"{base}/airlines"),
    )
    return plain(enriched)


#: Bytes of the enriched fact's files that a task groups: some ten million rows.
GROUPED_BYTES = 128 << 20


# P2 / P3 / A4
@register("enriched_fact")
def _enriched_fact(spark, sf_dir):
    base = _raw_round_trip(spark, sf_dir)
    fact_df = P.run(spark, f"{base}/airports", f"{base}/airlines", f"{base}/routes", f"{base}/fact", AS_OF)
    # tasks of many rows of one month: flight numbers repeat, and each task shuffles a number once a group. Two tasks a
    # month at least: a union of frames of one partition each is run as one task
    months = [spark.read.schema(S.FACT).parquet(folder).coalesce(max(2, -(-size // GROUPED_BYTES)))
              for folder, size in K.month_folders(spark, f"{base}/fact")]
    fact_df = reduce(DataFrame.unionByName, months) if months else fact_df
    g = fact_df.groupBy("flight_year", "flight_month", "flight_quarter", "origin_region").agg(
        F.count(F.lit(1)).alias("flights"), F.sum("seats").alias("total_seats"),
        F.sum("distance_km").alias("total_distance"),
        F.countDistinct("flight_number").alias("flight_numbers"),
        F.min("flight_date").alias("first_date"))
    return plain(g)


# A4 / A5
@register("fact_roundtrip_csv")
def _fact_roundtrip_csv(spark, sf_dir):
    path = scratch_path(spark, "fact-csv")
    K.write_fact_csv(fact(spark, sf_dir), path, compression="gzip")
    return plain(RAW.read_fact_csv(spark, path))


# A4 (Parquet)
@register("fact_roundtrip_parquet")
def _fact_roundtrip_parquet(spark, sf_dir):
    path = scratch_path(spark, "fact-parquet")
    K.write_fact_parquet(fact(spark, sf_dir), path, clustered=True)
    return plain(spark.read.schema(S.FACT).parquet(path).select(*S.FACT_COLUMNS))


# A6
@register("load_overwrite")
def _load_overwrite(spark, sf_dir):
    base = scratch_path(spark, "overwrite")
    f = fact(spark, sf_dir)
    write = partial(K.write_fact_parquet, clustered=True)
    K.publish_version(B.trailing_months(f, 3, AS_OF), base, write=write)
    K.publish_version(f, base, write=write)  # full refresh replaces the first load
    return plain(K.read_current(spark, base, S.FACT).select(*S.FACT_COLUMNS))


# A7
@register("load_append")
def _load_append(spark, sf_dir):
    path = scratch_path(spark, "append")
    f = fact(spark, sf_dir)
    cutoff = B.trailing_cutoff(AS_OF, 24)
    older = f.filter(~(F.col("flight_date") >= F.lit(cutoff)) | F.col("flight_date").isNull())
    K.append(B.trailing_months(f, 24, AS_OF), path)
    K.append(older, path, columns=S.FACT_COLUMNS)
    return plain(spark.read.schema(S.FACT).parquet(path))


# A8
@register("csv_append")
def _csv_append(spark, sf_dir):
    base = scratch_path(spark, "csv-append")
    ev = events(spark, sf_dir)
    RAW.write_change_csv(ev, f"{base}/incoming")
    staged = RAW.read_change_csv(spark, f"{base}/incoming", ev.schema)
    K.append(staged, f"{base}/target")
    return plain(spark.read.schema(ev.schema).parquet(f"{base}/target"))


# A9 / P5
@register("insert_select")
def _insert_select(spark, sf_dir):
    path = scratch_path(spark, "insert-select")
    f = fact(spark, sf_dir).select(*S.FACT_COLUMNS)
    K.append(f, path)
    target_before = spark.read.schema(S.FACT).parquet(path)
    before = target_before.agg(F.count(F.lit(1)).alias("n"),
                               F.count(F.when(F.col("flight_date") == F.lit(AS_OF), 1)).alias("d")).first()
    K.insert_select(f, path, lambda src: P.arrivals_from_sample(src, 100, AS_OF))
    after = spark.read.schema(S.FACT).parquet(path)
    return plain(after.agg(
        F.lit(before["n"]).cast("bigint").alias("rows_before"),
        F.count(F.lit(1)).alias("rows_after"),
        (F.count(F.lit(1)) - F.lit(before["n"])).alias("rows_inserted"),
        (F.count(F.when(F.col("flight_date") == F.lit(AS_OF), 1)) - F.lit(before["d"])).alias("inserted_on_as_of"),
    ))


# P4 / I1 I2 I4 I5
def _synced(spark, sf_dir):
    base = scratch_path(spark, "sync")
    ev = events(spark, sf_dir)
    stream = I.change_stream(spark, sf_dir, ev.schema, glob="events.parquet")
    I.sync_once(stream, f"{base}/target", f"{base}/checkpoint")
    return base


@register("sync_current_state")
def _sync_current_state(spark, sf_dir):
    base = _synced(spark, sf_dir)
    return plain(I.current_state(spark, f"{base}/target", ["user_id"], "ts", ["event_id"]))


# I7 streaming form
@register("change_window_stream")
def _change_window_stream(spark, sf_dir):
    base = scratch_path(spark, "window-stream")
    ev = events(spark, sf_dir)
    stream = I.change_stream(spark, sf_dir, ev.schema, glob="events.parquet")
    q = I.sync_windowed_counts(stream, "ts", f"{base}/target", f"{base}/checkpoint", minutes=1)
    q.awaitTermination()
    return plain(I.windowed_counts_state(spark, f"{base}/target"))


# I7 on a feed of several files whose rows are out of order, one file a micro-batch
@register("change_window_files")
def _change_window_files(spark, sf_dir):
    base = scratch_path(spark, "window-files")
    ev = events(spark, sf_dir)
    ev.repartition(4, F.xxhash64("event_id")).write.parquet(f"{base}/feed")
    stream = I.change_stream(spark, f"{base}/feed", ev.schema, max_files_per_trigger=1)
    q = I.sync_windowed_counts(stream, "ts", f"{base}/target", f"{base}/checkpoint", minutes=1)
    q.awaitTermination()
    return plain(I.windowed_counts_state(spark, f"{base}/target"))


# I7 without a state store: every micro-batch leaves partial rows, readers merge them
@register("change_window_partials")
def _change_window_partials(spark, sf_dir):
    base = scratch_path(spark, "window-partials")
    ev = events(spark, sf_dir)
    ev.repartition(4, F.xxhash64("event_id")).write.parquet(f"{base}/feed")
    stream = I.change_stream(spark, f"{base}/feed", ev.schema, max_files_per_trigger=1)
    WINDOWS.start(stream, "ts", f"{base}/target", f"{base}/checkpoint", minutes=1).awaitTermination()
    return plain(WINDOWS.counts(spark, f"{base}/target"))


# The timed trigger, stopped once the feed is drained
@register("sync_continuous")
def _sync_continuous(spark, sf_dir):
    base = scratch_path(spark, "sync-continuous")
    ev = events(spark, sf_dir)
    stream = I.change_stream(spark, sf_dir, ev.schema, glob="events.parquet")
    q = I.run_continuous(stream, f"{base}/target", f"{base}/checkpoint", interval_seconds=1)
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return plain(I.current_state(spark, f"{base}/target", ["user_id"], "ts", ["event_id"]))


# A feed without a change leaves no batch; its state is empty, its counters zero
@register("sync_empty_batch")
def _sync_empty_batch(spark, sf_dir):
    base = scratch_path(spark, "sync-empty")
    ev = events(spark, sf_dir)
    ev.filter(F.col("event_id").isNull()).write.parquet(f"{base}/feed")
    stream = I.change_stream(spark, f"{base}/feed", ev.schema)
    I.sync_once(stream, f"{base}/target", f"{base}/checkpoint")
    state = I.current_state(spark, f"{base}/target", ["user_id"], "ts", ["event_id"])
    rows = state.agg(F.count(F.lit(1)).alias("state_rows"))
    counters = I.sync_counters(spark, f"{base}/target").withColumn("state_rows", F.lit(0).cast("bigint"))
    both = counters.unionByName(rows, allowMissingColumns=True)
    source = ev.agg(F.count(F.lit(1)).alias("feed_rows_in_table"))
    both = both.unionByName(source, allowMissingColumns=True)
    return plain(both.agg(*[F.sum(c).cast("bigint").alias(c) for c in both.columns]))


# I6
@register("sync_counters")
def _sync_counters(spark, sf_dir):
    base = _synced(spark, sf_dir)
    return plain(I.sync_counters(spark, f"{base}/target"))


# A11
@register("table_profile")
def _table_profile(spark, sf_dir):
    found = A.table_profile(spark, fact_path(spark, sf_dir), "parquet", layout="columnar", schema=S.FACT)
    return plain(found.select("layout", "row_count", (F.col("files") > 0).alias("has_files"),
                              (F.col("total_mb") > 0).alias("has_size"),
                              (F.col("create_time") <= F.col("update_time")).alias("times_in_order")))


# A12
@register("compare_storage")
def _compare_storage(spark, sf_dir):
    path = scratch_path(spark, "storage")
    f = fact(spark, sf_dir)
    K.write_fact_csv(f, f"{path}/row")
    K.write_fact_parquet(f, f"{path}/col", clustered=True)
    row = A.table_profile(spark, f"{path}/row", "csv", layout="row", schema=S.FACT_CSV, options=RAW.FACT_CSV_OPTIONS)
    col = A.table_profile(spark, f"{path}/col", "parquet", layout="columnar", schema=S.FACT)
    both = A.compare_storage(row, col)
    return plain(both.select("row_row_count", "col_row_count", (F.col("compression_ratio") > 1).alias("columnar_smaller")))
