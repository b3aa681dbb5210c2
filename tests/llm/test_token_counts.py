"""Offset-mapped token counts against the tokenizers library's own offsets."""

import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from wingspan.llm import token_counts as T
from wingspan.llm.common import table

PATH = P.path("byte_bpe_50k.json")
TOKENIZER = Tokenizer.from_file(PATH)
ENCODER = T.SpanEncoder(open(PATH, encoding="utf-8").read())


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aé ÀßZ'sll\t\n 9²—日本🙂́İ.,!$", max_size=60))
def test_spans(text):
    e = TOKENIZER.encode(text, add_special_tokens=False)
    ids, starts, stops = next(ENCODER.encode([text]))
    assert ids.tolist() == e.ids
    assert list(zip(starts.tolist(), stops.tolist(), strict=True)) == e.offsets


def brute(values, by_line, rule):
    whole, sections = T.laid_out(values, by_line)
    ends = [s for _, _, s in sections[1:]] + [len(whole)]
    n, crossing = [0] * len(sections), [0] * len(sections)
    for a, b in TOKENIZER.encode(whole, add_special_tokens=False).offsets:
        held = [max(0, min(b, e) - max(a, s)) for (_, _, s), e in zip(sections, ends, strict=True)]
        touched = [i for i, h in enumerate(held) if h]
        own = touched[0] if rule == "first" else max(touched, key=lambda i: (held[i], -i))
        n[own] += 1
        crossing[own] += len(touched) > 1
    return [(f, k, s, e, x, y) for (f, k, s), e, x, y in zip(sections, ends, n, crossing, strict=True)]


@pytest.mark.parametrize("rule", ["most", "first"])
def test_small_table(spark, rule):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    got = {}
    for r in T.attribute(docs, PATH, ("source", "lang", "text"), ("text",), rule).collect():
        got.setdefault(r.doc_id, []).append((r.field, r.section, r.start, r.stop, r.n_tokens, r.n_crossing))
    for r in docs.collect():
        assert got[r.doc_id] == brute({"source": r.source, "lang": r.lang, "text": r.text}, ("text",), rule)


def test_odd_rows(spark):
    rows = [(1, None, None), (2, "", "a\n\n\nb"), (None, "x", "\n"), (3, "s", "same"), (3, "s", "same"), (4, "s", "word " * 60_000)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, title string, text string, n_tokens int")
    got = [(r.doc_id, r.field, r.section, r.start, r.stop, r.n_tokens, r.n_crossing) for r in T.attribute(docs, PATH, ("title", "text"), ("text",)).collect()]
    want = [(d, *x) for d, title, text in rows for x in brute({"title": title, "text": text}, ("text",), "most")]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert T.attribute(docs.limit(0), PATH, ("text",)).collect() == []
    with pytest.raises(ValueError):
        T.attribute(docs, PATH, ("text",), rule="last")
