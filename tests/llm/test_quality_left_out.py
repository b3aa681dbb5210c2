"""Quality scores against the counts of all other documents, by brute force and by language."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F
from test_quality_rules import brute_signals, buckets_of, compare

from wingspan.llm import quality_rules as Q
from wingspan.llm.common import table
from wingspan.llm.queries import REGISTRY


def brute(rows, good, buckets, smooth, lost_share):
    own = [Counter(buckets_of(t, buckets)) for _, t in rows]
    raw, target = Counter(), Counter()
    for (d, _), c in zip(rows, own, strict=True):
        raw.update(c)
        target.update(c if d in good else {})
    raws, targets = sum(raw.values()), sum(target.values())
    out, trusted = [], []
    for (d, t), c in zip(rows, own, strict=True):
        n, s, score = sum(c.values()), brute_signals(t), 0.0
        if n and targets:
            k, inside = smooth * raws / targets, d in good
            for b, m in c.items():
                p_target = (target[b] - m * inside + smooth) / (targets - n * inside + smooth * buckets)
                score += m / n * math.log(p_target / ((raw[b] - m + k) / (raws - n + k * buckets)))
        if d in good and not s[-1]:
            trusted.append(score)
        out.append((d, *s, score))
    trusted.sort()
    threshold = math.floor(trusted[math.floor(lost_share * len(trusted))] * Q.BINS) / Q.BINS if trusted else -math.inf
    return sorted(((*r, not r[-2] and r[-1] >= threshold) for r in out), key=str)


def test_small_table(spark):
    docs, labels = (table(spark, "/root/testdata/sf0.001", n) for n in ("documents", "labels"))
    good = {r.doc_id for r in labels.collect() if r.quality == 1}
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for share in (0.0, 0.005, 0.1):
        compare(Q.judge_left_out(docs, labels, buckets=512, lost_share=share), brute(rows, good, 512, 1.0, share))


def test_odd_rows(spark):
    long = " ".join(f"w{i % 5000}" for i in range(40_000))
    rows = [(1, None), (2, ""), (None, "a b " * 30), (3, "same text " * 9), (3, "same text " * 9), (4, long), (5, " ".join("abcdefghijklmnopqrstuvwxyz")), (6, " \n\t\n")]
    docs = spark.createDataFrame([(*r, 1, True) for r in rows], "doc_id long, text string, words int, kept boolean")
    labels = spark.createDataFrame([(5, 1), (5, 1), (4, 0), (None, 1), (3, None)], "doc_id long, quality int")
    compare(Q.judge_left_out(docs, labels, buckets=8192), brute(rows, {5}, 8192, 1.0, 0.005))
    compare(Q.judge_left_out(docs, labels.limit(0), buckets=8192), brute(rows, set(), 8192, 1.0, 0.005))
    assert Q.judge_left_out(docs.limit(0), labels).collect() == []


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_unlabelled_prose_stays_in_every_language(spark, sf):
    """Unlabelled rows without symbols that pass the base rules: no language loses a tenth."""
    docs, labels = (table(spark, f"/root/testdata/{sf}", n) for n in ("documents", "labels"))
    rows = REGISTRY["op6_quality_rules"](spark, f"/root/testdata/{sf}").join(docs.select("doc_id", "lang"), "doc_id")
    rows = rows.join(labels, "doc_id", "left_anti").filter("NOT base_failed AND n_symbols = 0")
    lost = {r.lang: r.lost for r in rows.groupBy("lang").agg(F.avg((~F.col("kept")).cast("int")).alias("lost")).collect()}
    assert len(lost) == 4 and max(lost.values()) < 0.1, lost


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_good_stay_and_bad_go(spark, sf):
    labels = table(spark, f"/root/testdata/{sf}", "labels")
    rows = REGISTRY["op6_quality_rules"](spark, f"/root/testdata/{sf}").join(labels, "doc_id").filter("NOT base_failed").collect()
    good, bad = [r.kept for r in rows if r.quality == 1], [r.kept for r in rows if r.quality == 0]
    assert sum(good) / len(good) > 0.99 and sum(bad) / len(bad) < 0.1
