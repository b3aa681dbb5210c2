"""Reconciliation by a checksum tree (G2, G3) against the row-by-row comparison."""

import pytest

from wingspan.operators import checksum as T
from wingspan.operators import reconcile as G

SCHEMA = "k int, v string, x double"


def row(df):
    return df.collect()[0].asDict()


def frames(spark, a, b, parts=3):
    return spark.createDataFrame(a, SCHEMA).repartition(parts), spark.createDataFrame(b, SCHEMA).repartition(parts + 2)


BASE = [(i, f"v{i % 7}", i / 3) for i in range(400)]
CASES = {
    "equal": (BASE, BASE[::-1]),
    "edited": (BASE, [(k, "new" if k in (3, 200) else v, x) for k, v, x in BASE]),
    "within tolerance": (BASE, [(k, v, x + 0.0005) for k, v, x in BASE]),
    "beyond tolerance": (BASE, [(k, v, x + (0.01 if k == 9 else 0)) for k, v, x in BASE]),
    "missing and new": (BASE[5:], BASE[:-3]),
    "repeated rows": (BASE + BASE[:4] * 2, BASE + BASE[:4]),
    "swapped nulls": ([(1, None, 1.0), (None, "a", None)], [(1, "a", 1.0), (None, None, None)]),
    "null keys": ([(None, "a", 1.0)] * 3 + BASE[:9], BASE[:9] + [(None, "a", 1.0)] * 3),
    "hot key": ([(1, "a", float(i % 9)) for i in range(3000)] + BASE, [(1, "a", float(i % 9)) for i in range(2999)] + BASE),
    "one empty": (BASE[:20], []),
    "both empty": ([], []),
}


@pytest.mark.parametrize("name", list(CASES))
def test_same_answer_as_compare(spark, name):
    a, b = frames(spark, *CASES[name])
    want = row(G.compare(a, b))
    for levels in (1, 2) if name == "edited" else (2,):
        assert row(T.compare_by_tree(a, b, ["k"], levels=levels)) == want


def test_summary_ignores_order_and_counts_repeats(spark):
    a, b = frames(spark, BASE, BASE[::-1], 7)
    assert sorted(T.summary(a, ["k"]).collect()) == sorted(T.summary(b, ["k"]).collect())
    twice = T.differing(T.summary(a.union(a), ["k"]), T.summary(b, ["k"]))
    assert twice.filter("same").isEmpty()
    assert T.summary(a, ["k"]).count() <= 2**T.BITS


def test_equal_copies_are_not_read_row_by_row(spark, monkeypatch):
    def never(*_):
        raise AssertionError("rows were compared")

    monkeypatch.setattr(T, "compare", never)
    a, b = frames(spark, BASE, BASE)
    assert row(T.compare_by_tree(a, b, ["k"])) == {"rows_left": 400, "rows_right": 400, "only_left": 0, "only_right": 0, "matched": 400, "equal": True}


def test_only_differing_ranges_are_read(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(T, "compare", lambda a, b, t: seen.append((a.count(), b.count())) or G.compare(a, b, t))
    a, b = frames(spark, BASE, [(k, "new" if k == 3 else v, x) for k, v, x in BASE])
    assert row(T.compare_by_tree(a, b, ["k"]))["only_left"] == 1
    assert seen == [(1, 1)]


def test_odd_columns(spark):
    a = spark.createDataFrame([(1, 2, 3)], "`range` int, rows int, `a.b` int")
    assert row(T.compare_by_tree(a, a, ["range", "a.b"]))["equal"] is True
    assert row(T.compare_by_tree(a, a.drop("rows"), ["range"]))["equal"] is False
    with pytest.raises(ValueError):
        T.compare_by_tree(*frames(spark, BASE, BASE), ["x"])
