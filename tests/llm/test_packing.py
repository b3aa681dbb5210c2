"""Packing: every id in exactly one piece, full windows, and the library's ids."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from wingspan.llm import packing as K
from wingspan.llm.common import table

PATH = P.path("word_bpe_49k.json")
TOKENIZER = Tokenizer.from_file(PATH)
ENCODER = K.Encoder(open(PATH, encoding="utf-8").read(), 1)
ODD = "aé ÀßZ'sll\t\n\x0b\x1c\x85\xa0 9½²×÷—’€日本🙂́İſﬁ<|endoftext|>.,!$"


def ids_of(text):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=ODD, max_size=40), st.text(alphabet="aeÉt 'sl1.\n", max_size=60)), max_size=4))
def test_ids_are_the_librarys(texts):
    assert [x.tolist() for x in ENCODER.encode(texts)] == [ids_of(t) for t in texts]


def check(rows, docs):
    """rows: as the contract has them; docs: (doc_id, text)."""
    want = defaultdict(list)
    for d, t in docs:
        want[d].append(ids_of(t))
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        windows[r.sequence_id].append(r)
    assert set(pieces) == set(want)
    for d, own in pieces.items():
        if len(want[d]) == 1:
            ids, at = want[d][0], 0
            for r in sorted(own, key=lambda r: r.start):
                assert (r.start, r.doc_tokens) == (at, len(ids)) and r.length > 0
                assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
                at += r.length
            assert at == len(ids)
        else:
            assert sum(r.length for r in own) == sum(map(len, want[d]))
    for w in windows.values():
        at = 0
        for r in sorted(w, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == w[0].tier <= 2048 and at & (at - 1) == 0
    return windows


def test_small_table(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    windows = check(K.pack(docs, PATH, pool_tokens=10_000).collect(), [(r.doc_id, r.text) for r in docs.collect()])
    groups = defaultdict(lambda: defaultdict(int))
    for w in windows.values():
        groups[w[0].tier][w[0].step_group] += 1
    assert {2048, 1024, 512} <= set(groups)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "a b"), (3, "same"), (3, "same"), (4, "<|endoftext|> x"), (5, "word " * 70_000), (6, "\n")]
    docs = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, start int, length int")
    check(K.pack(docs, PATH).collect(), rows)
    assert K.pack(docs.limit(0), PATH).collect() == []


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 6000), max_size=60), st.integers(1, 9))
def test_packer(sizes, every):
    packer, rows = K.Packer(step_tokens=8192), []
    for i, n in enumerate(sizes):
        packer.add((i, n), np.arange(n, dtype=np.int32))
        if i % every == 0:
            packer.pack()
            rows += packer.rows()
    packer.finish()
    rows += packer.rows()
    for i, n in enumerate(sizes):
        own = sorted((r[1], r[2]) for r in rows if r[0] == i)
        assert [a for a, _ in own] == [0, *np.cumsum([b for _, b in own]).tolist()][:-1] and sum(b for _, b in own) == n


def test_step_groups_are_balanced():
    rng, packer = np.random.default_rng(1), K.Packer(step_tokens=32_768)
    for i in range(3000):
        n = int(rng.lognormal(6, 1)) + 1
        packer.add((i, n), np.zeros(n, np.int32))
    packer.pack()
    groups = defaultdict(lambda: defaultdict(set))
    for r in packer.rows():
        groups[r[7]][r[8]].add(r[5])
    for by in groups.values():
        sizes = [len(x) for x in by.values()]
        assert max(sizes) - min(sizes) <= 1


@pytest.mark.parametrize("tiers", [(2048, 1000), (256, 512)])
def test_tiers_must_be_powers_of_two(tiers):
    with pytest.raises(ValueError):
        K.Packer(tiers)
