"""License scans: base places against brute force, planted notices, odd rows."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wingspan.llm import license_scan as L
from wingspan.llm.common import table

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    places = [(i, label) for phrase, label in L.BASE for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


INDEX = L.Index({}, 6, 4, 0.7)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["mit", "MIT", "license", "License.", "apache", "general", "public", "é", "x\xa0mit", "-", "the", "gnu"]), max_size=30).map(" ".join))
def test_base(text):
    r = INDEX.scan(text.encode())
    assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute(text)


@pytest.mark.parametrize("t", range(len(L.TEMPLATES)))
def test_notices_are_found(t):
    label, notice, _ = L.TEMPLATES[t]
    around = "the of and is a to in by or use with public version " * 30
    found = INDEX.scan(f"{around} {notice.title()} {around} {notice}".encode())
    assert label in found["labels"].split(",")
    assert sum(m["label"] == label for m in found["matches"]) >= 2


def test_loose_words_are_no_notice():
    text = "source and binary forms " + "of the redistribution in use following conditions are met by permission " * 20 + "cc nc by creative attribution commons"
    assert INDEX.scan(text.encode())["labels"] == ""


def rows_of(df):
    return sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in df.collect()), key=str)


def test_small_table(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = L.scan(docs)
    assert rows_of(got) == sorted(((d, *brute(t)) for d, t in texts.items()), key=str)
    for r in got.collect():
        assert ("cc-by-nc" in r.labels) == ("CC BY-NC" in texts[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "MIT License"), (3, "Apache License"), (3, "Apache License"), (4, "mit license " * 50_000), (5, "\n")]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n_words int, labels string")
    assert rows_of(L.scan(docs)) == sorted(((d, *brute(t)) for d, t in rows), key=str)
    assert L.scan(docs.limit(0)).collect() == []
