"""Reconciliation (G2), copy counts (G3), load count (A10)."""

from wingspan.operators import reconcile as G


def row(df):
    return df.collect()[0].asDict()


def test_exact_bag(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, None)], "k int, v string")
    b = spark.createDataFrame([(2, None), (1, "x"), (1, "x")], "k int, v string")
    assert row(G.compare(a, b))["equal"] is True
    c = spark.createDataFrame([(1, "x"), (2, None), (3, "z")], "k int, v string")
    r = row(G.compare(a, c))
    assert (r["only_left"], r["only_right"], r["matched"], r["equal"]) == (1, 1, 2, False)


def test_float_tolerance(spark):
    a = spark.createDataFrame([(1, 2.0), (1, 5.0), (2, None)], "k int, v double")
    b = spark.createDataFrame([(1, 2.0005), (1, 4.9995), (2, None)], "k int, v double")
    assert row(G.compare(a, b, 0.001))["equal"] is True
    c = spark.createDataFrame([(1, 2.01), (1, 5.0), (2, None)], "k int, v double")
    r = row(G.compare(a, c, 0.001))
    assert (r["only_left"], r["only_right"], r["equal"]) == (1, 1, False)
    assert G.results_match(a, b) and not G.results_match(a, None)


def test_decimal_is_exact(spark):
    a = spark.sql("SELECT CAST(1.000 AS DECIMAL(10,3)) AS v")
    b = spark.sql("SELECT CAST(1.0005 AS DECIMAL(10,4)) AS v").selectExpr("CAST(v AS DECIMAL(10,3)) AS v")
    assert row(G.compare(a, b))["equal"] is False  # 1.001 vs 1.000


def test_width_mismatch(spark):
    a = spark.createDataFrame([(1, 2)], "a int, b int")
    b = spark.createDataFrame([(1,)], "a int")
    assert row(G.compare(a, b))["equal"] is False


def test_counts(spark):
    a, b = spark.range(10), spark.range(7)
    r = row(G.copy_counts(a, b))
    assert (r["source_rows"], r["target_rows"], r["difference"], r["in_sync"]) == (10, 7, 3, False)
    r = row(G.validate_count(a, 10))
    assert r["matches"] is True
    r = row(G.validate_count(b, a))
    assert (r["expected_count"], r["actual_count"], r["matches"]) == (10, 7, False)


def test_chains_pair_rank_by_rank(spark):
    """1.0 and 1.0008 against 1.0008 and 1.0016: sorted and zipped, both pairs lie within 0.001."""
    a = spark.createDataFrame([("k", 1.0), ("k", 1.0008), ("m", 5.0)], "k string, v double")
    b = spark.createDataFrame([("k", 1.0008), ("k", 1.0016), ("m", 5.0)], "k string, v double")
    assert row(G.compare(a, b, 0.001))["equal"] is True
    r = row(G.compare(a, b, 0.0005))
    assert (r["only_left"], r["only_right"], r["matched"]) == (2, 2, 1)


def test_floats_only_and_repeats(spark):
    a = spark.createDataFrame([(2.0,), (2.0,), (1.0,), (None,)], "v double")
    b = spark.createDataFrame([(1.0,), (2.0,), (2.0005,), (None,)], "v double")
    assert row(G.compare(a, b, 0.001))["equal"] is True
    r = row(G.compare(a, b.filter("v < 2.0001 OR v IS NULL"), 0.001))
    assert (r["rows_left"], r["rows_right"], r["only_left"], r["only_right"]) == (4, 3, 1, 0)
    assert row(G.compare(a.limit(0), b.limit(0)))["equal"] is True
