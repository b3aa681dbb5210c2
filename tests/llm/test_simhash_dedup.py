"""SimHash near-dedup against brute force."""

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from wingspan.llm import simhash_dedup as S
from wingspan.llm.common import components, table


def brute_fingerprint(text, k=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", low) if w]
    grams = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    out = 0
    for bit in range(64):
        ones = sum(xxhash.xxh64_intdigest(g.encode(), 42) >> bit & 1 for g in grams)
        out |= (2 * ones > len(grams)) << bit
    return out


def brute_components(fps, ids, radius=4):
    x = np.array(fps, np.uint64)
    parent = list(range(len(x)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(x)):
        for j in np.flatnonzero(np.bitwise_count(x ^ x[i]) <= radius).tolist():
            a, b = sorted((top(i), top(j)))
            parent[b] = a
    low = {}
    for i, d in enumerate(ids):
        if d is not None:
            low[top(i)] = min(low.get(top(i), d), d)
    return [low.get(top(i)) for i in range(len(x))]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aB cÉ\n\t\x0b.", max_size=60))
def test_fingerprint(text):
    assert S.fingerprint(text.encode(), 4) == brute_fingerprint(text)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 63).map(lambda b: 1 << b), max_size=90), st.integers(0, 6))
def test_tree_finds_all(flips, radius):
    values = list(dict.fromkeys(np.bitwise_xor.accumulate(np.array([0, *flips], np.uint64)).tolist()))
    tree = S.BKTree()
    for v in values:
        tree.add(v)
    for q in values:
        assert sorted(tree.near(q, radius)) == [i for i, v in enumerate(values) if (v ^ q).bit_count() <= radius]
    all_ = {i: set() for i in range(len(values))}
    for node, hit in tree.near_all(np.array(values, np.uint64), radius):
        for q in hit.tolist():
            all_[q].add(node)
    assert all(sorted(all_[i]) == sorted(tree.near(q, radius)) for i, q in enumerate(values))


def check(rows, result):
    fps = [brute_fingerprint(t) for _, t in rows]
    want = sorted(zip([d for d, _ in rows], fps, brute_components(fps, [d for d, _ in rows]), strict=True), key=str)
    got = sorted(((r.doc_id, r.fp % (1 << 64), r.component_id) for r in result.collect()), key=str)
    assert got == want


def test_small_table(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text")
    check([(r.doc_id, r.text) for r in docs.collect()], S.near_duplicates(docs))


@pytest.mark.parametrize("shard_rows", [3, 2048])
def test_hot_cluster(spark, shard_rows):
    base = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(base[:i] + ["x"] + base[i + 1 :])) for i in range(120)]
    rows += [(500 + i, f"alone {i} here we go again number {i * i}") for i in range(60)]
    check(rows, S.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shard_rows=shard_rows))


def test_odd_rows(spark):
    rows = [(7, None), (3, ""), (None, "a b c d e f"), (9, "A B c d e f"), (9, "A B c d e f"), (4, " \n "), (None, "q r s t u v w x"),
            (5, "lone"), (6, "word " * 30_000)]
    docs = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, fp int, component_id int")
    check(rows, S.near_duplicates(docs))
    assert S.near_duplicates(docs.limit(0)).collect() == []


def test_components_of_a_chain(spark):
    n = 200
    e = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(900, 901)], "a long, b long")
    got = {r.node: r.root for r in components(e).collect()}
    assert got == {i: 0 for i in range(n + 1)} | {900: 900, 901: 900}
