"""Language identification: held-out accuracy, calibration, sparsity and odd rows."""

import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from wingspan.llm import language_id as L
from wingspan.llm.common import table


def test_held_out_accuracy(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    rows = L.identify(docs).collect()
    assert len(rows) == len(truth)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    held = [r for r in rows if r.held_out]
    right = np.mean([truth[r.doc_id] == r.lang_pred for r in held])
    assert right > 0.98
    assert abs(right - np.mean([r.score for r in held])) < 0.05  # the scores are calibrated


def test_held_out_rows_are_not_learned_from(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text", "lang")
    changed = docs.selectExpr("doc_id", "text", "CASE WHEN crc32(cast(doc_id AS string)) % 4 = 2 THEN 'zz' ELSE lang END AS lang")
    assert sorted(map(tuple, L.identify(docs).collect())) == sorted(map(tuple, L.identify(changed).collect()))


def test_weights_are_sparse(spark):
    model = L.fit(table(spark, "/root/testdata/sf0.001", "documents"))
    assert 0 < np.mean(model.weights != 0) < 0.7


def brute_features(text, dims):
    """The same features by a loop over n-grams."""
    out = {}
    s = " " + L._NO_LETTERS.sub(" ", text or "").strip().lower() + " "
    for i in range(len(s)) if len(s) > 2 else ():
        h = 0
        for n in range(1, 4):
            if i + n > len(s):
                break
            h = (h + ord(s[i + n - 1]) + n) * 0x9E3779B97F4A7C15 % 2**64
            h ^= h >> 29
            f = h >> (64 - (dims.bit_length() - 1))
            out[f] = out.get(f, 0) + 1
    return out


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=40), st.sampled_from([3, 7, 1 << 16]))
def test_features(text, block):
    old, L.BLOCK = L.BLOCK, block
    held, counts = L.features(text, 1024)
    L.BLOCK = old
    assert dict(zip(held.tolist(), counts.tolist(), strict=True)) == brute_features(text, 1024)


def test_odd_rows(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "12 !?", "en"), (None, "the thing and that", "en"), (4, "das und die der", "de"),
            (5, "the other thing", "en"), (5, "the other thing", "en"), (6, "der die das", None), (7, "the " * 50_000, "en"), (8, "日本", None)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, lang string, held_out int, lang_pred string")
    got = {(r.doc_id, r.lang_pred) for r in L.identify(docs).collect()}
    assert len(L.identify(docs).collect()) == len(rows)
    assert {(1, "und"), (2, "und"), (3, "und")} <= got and {g[1] for g in got} == {"und", "en", "de"}
    assert all(r.score == 0 for r in L.identify(docs).filter("lang_pred = 'und'").collect())
    assert {r.lang_pred for r in L.identify(docs.selectExpr("doc_id", "text", "cast(null AS string) AS lang")).collect()} == {"und"}
    one = L.identify(docs.filter("lang = 'en'")).filter("lang_pred <> 'und'").collect()
    assert {(r.lang_pred, r.score) for r in one} == {("en", 1.0)}
    assert L.identify(docs.limit(0)).collect() == []
