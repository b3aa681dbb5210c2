"""Toxicity: held-out accuracy, boosting and calibration against plain versions, features and odd rows."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wingspan.llm import toxicity as T
from wingspan.llm.common import table

EMPTY = T.Lexicon({})


def test_held_out_rows_are_found(spark):
    docs, labels = (table(spark, "/root/testdata/sf0.1", n) for n in ("documents", "labels"))
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    rows = T.judge(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [(r.predicted, truth[r.doc_id], r.score) for r in rows if r.held_out and r.doc_id in truth]
    caught = sum(p and t for p, t, _ in held) / sum(t for _, t, _ in held)
    assert caught > 0.85 and sum(p and not t for p, t, _ in held) <= 0.02 * len(held)
    assert np.mean([(s - t) ** 2 for _, t, s in held]) < 0.02  # calibrated


def test_held_out_labels_are_not_learned_from(spark):
    docs, labels = (table(spark, "/root/testdata/sf0.001", n) for n in ("documents", "labels"))
    turned = labels.selectExpr("doc_id", "CASE WHEN crc32(cast(doc_id AS string)) % 5 = 0 THEN 1 - toxic ELSE toxic END AS toxic")
    other = docs.selectExpr("doc_id", "text", "'zz' AS lang", "1 AS source", "doc_id AS toxic")
    assert sorted(map(tuple, T.judge(docs, labels).collect())) == sorted(map(tuple, T.judge(other, turned).collect()))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 1), st.integers(1, 3)), min_size=1, max_size=14))
def test_isotonic(rows):
    """Against the formula: the largest over starts of the least over ends of weighted means."""
    margin, y, weight = (np.array([r[i] for r in rows], float) for i in range(3))
    at, scores = T.isotonic(margin, y, weight)
    mean = lambda a, b: np.average(y[(margin >= a) & (margin <= b)], weights=weight[(margin >= a) & (margin <= b)])
    values = sorted(set(margin.tolist()))
    for v in values:
        want = max(min(mean(a, b) for b in values if b >= v) for a in values if a <= v)
        assert np.interp(v, at, scores) == pytest.approx(want)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 5), st.integers(0, 1)), min_size=4, max_size=30))
def test_a_stump_is_the_best_of_all(rows):
    x, y = np.array([r[:2] for r in rows], float), np.array([r[2] for r in rows], float)
    if len(set(y.tolist())) < 2:
        return
    trees = T.boost(x, y, rounds=1, depth=1, rate=1.0, bins=32, l2=1.0, least_weight=0.0)
    p = y.mean()
    g, h = y - p, np.full(len(y), p * (1 - p))
    leaf = lambda held: g[held].sum() / (h[held].sum() + 1)
    gain = lambda held: g[held].sum() ** 2 / (h[held].sum() + 1)
    splits = [(f, c) for f in (0, 1) for c in sorted(set(x[:, f].tolist()))[:-1]]
    best = max([gain(x[:, f] <= c) + gain(x[:, f] > c) for f, c in splits], default=0)
    f, c = trees.feature[0, 0], trees.cut[0, 0]
    left = x[:, f] <= c
    assert gain(left) + gain(~left) == pytest.approx(max(best, gain(np.ones(len(y), bool))), abs=1e-9)
    margin = trees.margin(x) - trees.base
    for side in (left, ~left):
        if side.any():
            assert margin[side] == pytest.approx(leaf(side))


def test_boosting_learns_what_one_tree_cannot():
    x = np.random.default_rng(3).random((2000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.4)).astype(float)
    assert np.mean((T.boost(x, y).margin(x) > 0) == (y > 0)) > 0.97


def test_features():
    lexicon = T.Lexicon({"dumb": 3.0, "clow*": 2.0})
    told = dict(zip(T.FEATURES, T.features("You are such a CLOWNISH, dumb thing!! d.u.m.b d0mb dumb123 duuuumb DUMBO", lexicon), strict=True))
    assert told["tier_1"] > 0 and told["near_second_person"] > 0 and told["mark_runs"] > 0 and told["largest_weight"] == 3.0
    assert told["hidden_hits"] > 0 and told["signed"] > 0 and told["stretched"] > 0 and told["capital_words"] > 0
    for spelled in ("dvmb", "d4mb"):
        assert lexicon[T.revealed(spelled).pop()] is None
    assert any(lexicon[w] for w in T.revealed("c|0wn")) and any(lexicon[w] for w in T.revealed("duuumb"))
    assert lexicon["clo"] is None and lexicon["clown"] == (2.0, 0) and lexicon["dumbo"] is None
    for text in (None, "", " ", "!", "\x00", "é" * 10, "a" * 200_000, "1 " * 50_000):
        assert np.isfinite(T.features(text, EMPTY)).all() and len(T.features(text, EMPTY)) == len(T.FEATURES)


def test_odd_rows(spark):
    texts = [("you are an awful idiot " * k, 1) for k in range(1, 30)] + [("the calm river and green hill " * k, 0) for k in range(1, 40)]
    rows = [(i, t) for i, (t, _) in enumerate(texts)] + [(None, "idiot"), (900, None), (901, ""), (5, "awful idiot you"), (5, "awful idiot you"), (902, "river " * 50_000)]
    docs = spark.createDataFrame([(*r, 1.0, True) for r in rows], "doc_id long, text string, score double, held_out boolean")
    labels = spark.createDataFrame([(i, t, "x") for i, (_, t) in enumerate(texts)] + [(None, 1, "x"), (900, None, "x"), (3, 0, "x")], "doc_id long, toxic int, text string")
    got = T.judge(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id == 5}) <= 2
    assert T.judge(docs.limit(0), labels).collect() == []
    for some, share in ((labels.filter("toxic = 1"), 1.0), (labels.filter("toxic = 0"), 0.0), (labels.limit(0), 0.0)):
        assert {r.score for r in T.judge(docs, some).collect()} == {share}
