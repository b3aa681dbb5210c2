"""Publishing versions: two publishers, a pointer that was not written to its end; appends and insert-select."""

from concurrent.futures import ThreadPoolExecutor

from wingspan.sources import sinks as K


def test_two_publishers_take_two_numbers(spark, workdir):
    with ThreadPoolExecutor(4) as pool:
        versions = list(pool.map(lambda k: K.publish_version(spark.range(k), f"{workdir}/t"), range(1, 7)))
    held = K._pointers(spark, f"{workdir}/t")
    assert len(held) == len(set(held)) == 6
    assert K.current_version(spark, f"{workdir}/t") in versions


def test_an_empty_pointer_is_passed_over(spark, workdir):
    assert K.current_version(spark, f"{workdir}/t") is None
    first = K.publish_version(spark.range(3), f"{workdir}/t")
    path, fs = K._fs(spark, f"{workdir}/t/{K.POINTER}/000000000001")
    fs.create(path, False).close()  # a publisher that died
    assert K.current_version(spark, f"{workdir}/t") == first
    second = K.publish_version(spark.range(5), f"{workdir}/t")
    assert K.current_version(spark, f"{workdir}/t") == second and K.read_current(spark, f"{workdir}/t").count() == 5


def test_append_binds_by_name(spark, workdir):
    spark.createDataFrame([(1, "a")], "k int, v string").write.parquet(f"{workdir}/t")
    K.append(spark.createDataFrame([("b", 2, 0.5), (None, None, 1.0)], "v string, k int, extra double"), f"{workdir}/t", columns=["k", "v"])
    K.append(spark.createDataFrame([], "k int, v string"), f"{workdir}/t")
    assert sorted(map(tuple, spark.read.parquet(f"{workdir}/t").collect()), key=str) == [(1, "a"), (2, "b"), (None, None)]
    rows = K.insert_select(spark.read.parquet(f"{workdir}/t"), f"{workdir}/t", lambda df: df.filter("k = 2").selectExpr("k + 10 AS k", "v"))
    assert rows.columns == ["k", "v"]
    assert (12, "b") in set(map(tuple, spark.read.parquet(f"{workdir}/t").collect()))
    both = K.union_by_name(spark.range(1).selectExpr("1 AS k", "'x' AS v"), spark.range(1).selectExpr("'y' AS v", "2 AS k"))
    assert sorted(map(tuple, both.collect())) == [(1, "x"), (2, "y")]
