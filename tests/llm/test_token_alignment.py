"""Token alignment: units against whole encodings, and every measure against a loop over bytes."""

import hashlib
from collections import Counter, defaultdict

import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from wingspan.llm import token_alignment as T
from wingspan.llm.bpe_transducer import Vocabulary
from wingspan.llm.common import table

A_PATH, B_PATH = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
A = Tokenizer.from_file(A_PATH)
A.encode_special_tokens = True
B = SentencePieceProcessor(model_file=B_PATH)
SPEC, MODEL = open(A_PATH, encoding="utf-8").read(), open(B_PATH, "rb").read()
A_BYTES = Vocabulary(SPEC).bytes_of
ALIGNER = T._aligner(SPEC, MODEL)
ODD = "aé ÀßZ'sll\t\n\r\x0b\x1c\x85\xa0 9½²×—€日本🙂️İ▁\x00  　.,!$"


def piece_bytes(i):
    p = B.id_to_piece(i)
    return bytes([int(p[3:5], 16)]) if p.startswith("<0x") else p.replace("▁", " ").encode()


def spans(tokens):
    at, out = 0, []
    for t in tokens:
        out.append((at, at + len(t)))
        at += len(t)
    return out


def brute(rows):
    """What the query returns for (doc_id, text) rows, from whole encodings and a loop over pairs of tokens."""
    told, count = [], Counter()
    for doc_id, text in rows:
        raw = (" " + (text or "")).encode()
        a, b = (A.encode(" " + text, add_special_tokens=False).ids, B.encode(text)) if text else ([], [])
        of_a, of_b = [A_BYTES[i] for i in a], [piece_bytes(i) for i in b]
        if not text or b"".join(of_a) != raw or b"".join(of_b) != raw:
            told.append((doc_id, [], [], [], []))
            continue
        sa, sb = spans(of_a), spans(of_b)
        ends = sorted({e for _, e in sa} & {e for _, e in sb})
        groups, begin = [], 0
        for e in ends:
            groups.append(([i for i, s in zip(a, sa, strict=True) if begin <= s[0] < e], [i for i, s in zip(b, sb, strict=True) if begin <= s[0] < e]))
            begin = e
        links = []
        for i, (s, e) in zip(a, sa, strict=True):
            links += [(i, j) for j, (u, v) in zip(b, sb, strict=True) if max(s, u) < min(e, v)]
        count.update(links)
        told.append((doc_id, a, b, groups, links))
    most = defaultdict(int)
    for (_, j), n in count.items():
        most[j] = max(most[j], n)
    out = []
    for doc_id, a, b, groups, links in told:
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        digest = hashlib.sha256(said.encode()).hexdigest() if a else ""
        best = sum(count[x] == most[x[1]] for x in links)
        out.append((doc_id, len(a), len(b), len(groups), len(links), best, sum(count[x] for x in links), digest))
    return sorted(out, key=repr)


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(alphabet=ODD, max_size=60), st.text(alphabet="aeÉt 'sl1.\n", max_size=60), st.text(max_size=40)))
def test_units_give_whole_encodings(text):
    text = text.encode("utf-8", "ignore").decode()
    units = T._UNIT.findall(" " + text)
    assert "".join(units) == " " + text
    if not text:
        return
    of_a, of_b = ALIGNER.encode(units)
    assert [i for a in of_a for i in a] == A.encode(" " + text, add_special_tokens=False).ids
    assert [i for b in of_b for i in b] == B.encode(text)


def test_special_strings_are_plain_text():
    (a,), (b,) = ALIGNER.encode([" <|endoftext|><s></s>"])
    assert 50256 not in a and not {1, 2} & set(b)


ROWS = [
    (1, "The cat sat on the mat.\nThe cat sat."), (2, None), (3, ""), (4, "a▁b"), (5, "naïve café 日本 🙂 <|endoftext|> </s>"),
    (6, "The cat sat on the mat.\nThe cat sat."), (None, "The cat"), (7, " "), (8, "\n"), (9, "  x \n\n y\t z\r\n"), (9, "  x \n\n y\t z\r\n"),
    (9, "other text"), (10, "word " * 3000), (11, "x" * 20_000), (12, "a\x1c b\xa0 c\x85"), (13, "a▁b"),
]


@pytest.mark.parametrize("bounds", [{}, {"hot_pairs": 5}, {"hot_pairs": 0, "most_units": 3}, {"most_chars": 50}])
def test_odd_rows(spark, bounds):
    docs = spark.createDataFrame([(*r, 1, 2) for r in ROWS], "doc_id long, text string, n_a int, times int")
    got = T.measures(docs, A_PATH, B_PATH, **bounds)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(ROWS)
    assert T.measures(docs.limit(0), A_PATH, B_PATH).collect() == []


@pytest.mark.parametrize("hot_pairs", [1 << 17, 1000])
def test_table(spark, hot_pairs):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect() if len(r.text or "") < 1500]
    got = T.measures(docs.filter("length(text) < 1500 OR text IS NULL"), A_PATH, B_PATH, hot_pairs=hot_pairs)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)
