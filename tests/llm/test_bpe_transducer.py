"""The transducer's ids against the tokenizers library, and the round trip."""

import hashlib

import public_tokenizers as P
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from wingspan.llm import bpe_transducer as B
from wingspan.llm.common import table

PATH = P.path("byte_bpe_50k.json")
TOKENIZER = Tokenizer.from_file(PATH)
VOCABULARY = B.Vocabulary(open(PATH, encoding="utf-8").read())
ODD = "aé ÀßZ'sll\t\n\x0b\x1c\x85\xa0 9½²×÷—’€日本🙂́İſﬁ<|endoftext|>.,!$"


def ids_of(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(alphabet=ODD, max_size=60), st.text(alphabet="aeÉt 'sl1.\n", max_size=60), st.text(max_size=40)))
def test_words_and_merges(text):
    text = text.replace("l<", "l<|endoftext|>")
    text = text.encode("utf-8", "ignore").decode()
    ids = [i for w in VOCABULARY.split(text) for i in VOCABULARY.encode_word(w)]
    assert ids == ids_of(text)
    assert VOCABULARY.decode(ids) == TOKENIZER.decode(ids, skip_special_tokens=False) == text


def test_long_words():
    for word in ("the" * 5000, "aé" * 3000, "!?" * 999, "antidisestablishmentarianism" * 40):
        assert VOCABULARY.merge(word.encode()) == ids_of(word)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.binary(max_size=6), st.lists(st.integers(0, 9), max_size=4), max_size=40), st.lists(st.binary(max_size=6), max_size=10))
def test_lexicon(tmp_path_factory, entries, others):
    path = tmp_path_factory.mktemp("lexicon") / "x.bin"
    path.write_bytes(B.Lexicon.compile(entries).to_bytes())
    lexicon = B.Lexicon.mapped(str(path))
    words = [*entries, *others]
    for w, n in zip(words, lexicon.numbers(words).tolist(), strict=True):
        assert (n >= 0) == (w in entries)
        if n >= 0:
            assert lexicon.ids[lexicon.starts[n] : lexicon.starts[n + 1]].tolist() == entries[w]


def test_lexicon_shares_suffixes():
    words = [a + b for a in (b"walk", b"talk", b"jump") for b in (b"", b"s", b"ed", b"ing")]
    lexicon = B.Lexicon.compile({w: [i] for i, w in enumerate(words)})
    assert len(lexicon.final) < 16  # the tree without shared suffixes has 31 states
    assert sorted(lexicon.numbers(words).tolist()) == list(range(12))


def test_frequent_words_are_bounded(spark):
    docs = spark.createDataFrame([(" ".join(f"w{i}" for i in range(200) for _ in range(1 + i % 7)),)], "text string")
    counts = {r.word: r.n for r in B.word_counts(docs, VOCABULARY._spec).collect()}
    some = B.frequent_words(docs, VOCABULARY._spec, 60)
    assert 0 < len(some) <= 60 and min(counts[w] for w in some) >= max(n for w, n in counts.items() if w not in set(some)) / 2


def check(rows, result):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = [(d, len(ids_of(t)), sha(",".join(map(str, ids_of(t)))), sha(TOKENIZER.decode(ids_of(t), skip_special_tokens=False))) for d, t in rows]
    assert sorted(map(tuple, result.collect()), key=str) == sorted(want, key=str)


def test_small_table(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text")
    check([tuple(r) for r in docs.collect()], B.digests(docs, PATH, lexicon_words=2000))


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "a b"), (3, "same"), (3, "same"), (4, "<|endoftext|> x<|endoftext|>"), (5, "word " * 70_000), (6, "\n \n")]
    docs = spark.createDataFrame([(d, t, 1, [2]) for d, t in rows], "doc_id long, text string, n_tokens int, ids array<int>")
    check(rows, B.digests(docs, PATH))
    back = B.decode(B.encode(docs, PATH), PATH)
    assert sorted(map(tuple, back.collect()), key=str) == sorted([(d, t or "") for d, t in rows], key=str)
    assert B.digests(docs.limit(0), PATH).collect() == []
