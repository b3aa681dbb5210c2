"""Quality rules against brute force."""

import math
import re
from collections import Counter

import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from wingspan.llm import quality_rules as Q
from wingspan.llm.common import table

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def words_of(text):
    return [w for w in SPACE.split(text or "") if w]


def brute_signals(text):
    text, words = text or "", words_of(text)
    lines = [x for x in text.split("\n") if words_of(x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(8)}
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), n < 20 or 100 * len(covered) > 30 * n


def buckets_of(text, buckets):
    signed = lambda h: h - (1 << 64) if h >= 1 << 63 else h
    of_long = lambda h, seed: xxhash.xxh64_intdigest(h.to_bytes(8, "little"), seed)
    h1 = [xxhash.xxh64_intdigest(w.encode(), 42) for w in words_of(text)]
    h2 = [of_long(b, of_long(a, 42)) for a, b in zip(h1, h1[1:], strict=False)]
    return [signed(h) % buckets for h in h1 + h2]


def brute(rows, good, buckets, smooth, threshold):
    raw, target = Counter(), Counter()
    for d, t in rows:
        raw.update(buckets_of(t, buckets))
        if d in good:
            target.update(buckets_of(t, buckets))
    raws, targets = sum(raw.values()), sum(target.values())
    ratio = lambda b: math.log((target[b] + smooth) / (targets + smooth * buckets)) - math.log((raw[b] + smooth) / (raws + smooth * buckets)) if targets else 0.0
    out = []
    for d, t in rows:
        grams, s = buckets_of(t, buckets), brute_signals(t)
        score = sum(map(ratio, grams)) / len(grams) if grams else 0.0
        out.append((d, *s, score, not s[-1] and score >= threshold))
    return sorted(out, key=str)


def compare(df, want):
    got = sorted((tuple(r) for r in df.collect()), key=str)
    assert [(*g[:7], g[8]) for g in got] == [(*w[:7], w[8]) for w in want]
    assert [g[7] for g in got] == pytest.approx([w[7] for w in want], abs=1e-9)


@settings(max_examples=12, deadline=None)
@given(st.lists(st.one_of(st.none(), st.lists(st.sampled_from(["a", "b", "É", "x#", "$&", "\n", "\n\n", "\t", "|"]), max_size=60).map(" ".join)), max_size=8))
def test_signals(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in Q.signals(rows).drop("row", "ones", "twos").collect()}
    assert got == {i: brute_signals(t) for i, t in enumerate(texts)}


def test_small_table(spark):
    docs, labels = (table(spark, "/root/testdata/sf0.001", n) for n in ("documents", "labels"))
    good = {r.doc_id for r in labels.collect() if r.quality == 1}
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    compare(Q.judge(docs, labels, buckets=512), brute(rows, good, 512, 1.0, -0.05))


def test_odd_rows(spark):
    long = " ".join(f"w{i % 5000}" for i in range(40_000))
    rows = [(1, None), (2, ""), (None, "a b " * 30), (3, "same text " * 9), (3, "same text " * 9), (4, long), (5, " ".join("abcdefghijklmnopqrstuvwxyz")), (6, " \n\t\n")]
    docs = spark.createDataFrame([(*r, 1, True) for r in rows], "doc_id long, text string, words int, kept boolean")
    labels = spark.createDataFrame([(5, 1), (5, 1), (4, 0), (None, 1), (3, None)], "doc_id long, quality int")
    compare(Q.judge(docs, labels), brute(rows, {5}, 8192, 1.0, -0.05))
    compare(Q.judge(docs, labels.limit(0)), brute(rows, set(), 8192, 1.0, -0.05))
    assert Q.judge(docs.limit(0), labels).collect() == []
    from test_quality_left_out import brute as left_out

    kept = {w[0] for w in left_out(rows, {5}, 32_768, 1.0, 0.005) if w[-1]}
    assert sorted(Q.kept_documents(docs, labels).collect(), key=str) == sorted((r for r in docs.collect() if r.doc_id in kept), key=str)


def test_clean_documents_stay(spark):
    docs, labels = (table(spark, "/root/testdata/sf0.1", n) for n in ("documents", "labels"))
    rows = Q.judge(docs, labels).join(labels, "doc_id").filter("NOT base_failed").collect()
    good, bad = [r.kept for r in rows if r.quality == 1], [r.kept for r in rows if r.quality == 0]
    assert sum(good) / len(good) > 0.99 and sum(bad) / len(bad) < 0.1


def test_native(spark):
    docs, labels = (table(spark, "/root/testdata/sf0.001", n) for n in ("documents", "labels"))
    plan = Q.judge(docs, labels)._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "Arrow", "Pandas"))
