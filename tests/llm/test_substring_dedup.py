"""Substring dedup against brute force and SQL."""

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wingspan.llm import substring_dedup as S
from wingspan.llm.common import table
from wingspan.llm.queries import REGISTRY, SQL


def brute(rows, min_words):
    """Texts after dedup by lines, for rows (doc_id, text) with distinct pairs of id and text."""
    seen, out = set(), {}
    for d, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        kept = []
        for line in (t or "").split("\n"):
            words = tuple(line.encode().lower().split())
            if len(words) >= min_words and words in seen:
                continue
            seen.add(words)
            kept.append(line)
        out[d] = None if t is None else "\n".join(kept)
    return out


def brute_runs(rows, min_words, min_run):
    """Texts after dedup by runs of phrases, letter by letter, for rows (doc_id, text) with distinct doc_ids."""
    seen, out = set(), {}
    for d, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        units, begin, i = [], 0, 0
        text = t or ""
        while i < len(text):
            stop = i
            if text[i] == "\n":
                stop = i + 1
            elif i and text[i] in " \t" and text[i - 1] in ".!?,;:":
                while stop < len(text) and text[stop] in " \t":
                    stop += 1
            if stop > i:
                units.append((begin, i, stop))
                begin = i = stop
            else:
                i += 1
        units.append((begin, len(text), len(text)))
        words = [tuple(text[a:b].encode().lower().split()) for a, b, _ in units]
        kind = []
        for w in words:
            kind.append("-" if len(w) < min_words else "R" if w in seen else "N")
            if len(w) >= min_words:
                seen.add(w)
        gone = set()
        for a in range(len(units)):
            for b in range(a, len(units)):
                if kind[a] == kind[b] == "R" and "N" not in kind[a : b + 1] and sum(map(len, words[a : b + 1])) >= min_run:
                    gone |= set(range(a, b + 1))
        kept = [k for k in range(len(units)) if k not in gone]
        new = "".join(text[units[k][0] : units[k][2]] for k in kept)
        if kept and len(units) - 1 in gone:
            new = new[: len(new) - (units[kept[-1]][2] - units[kept[-1]][1])]
        out[d] = None if t is None else new
    return out


@settings(max_examples=15, deadline=None)
@given(st.lists(st.one_of(st.none(), st.lists(st.sampled_from(["a b.", " ", "A  b, ", "c", "\n", "é f; ", "x y z", "! ", "q r s. \t"]), max_size=9).map("".join)), max_size=6))
def test_runs(spark, texts):
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for min_run in (2, 5):
        got = {r.doc_id: r for r in S.dedup(docs, "phrase", 2, min_run).collect()}
        assert {d: r.text for d, r in got.items()} == brute_runs(rows, 2, min_run)


def test_passage_within_lines_goes_and_shared_phrases_stay(spark):
    passage = "one river bends, two hills rise; three birds sing. Four winds turn, five lamps glow: six roads meet! " * 2
    notice = "Licensed under the terms of the great and general licence, version two."
    rows = [(k, f"Opening words {k} of a line of its own {passage}and an end that nobody has {k}.\n{notice}\nAs we all know, {k} is new.") for k in range(40)]
    got = {r.doc_id: r for r in S.dedup(spark.createDataFrame(rows, "doc_id long, text string"), "phrase", 2, 30).collect()}
    assert got[0].text == rows[0][1] and got[0].spans is None
    for k, t in rows[1:]:
        assert "three birds sing" not in got[k].text and notice in got[k].text and f"Opening words {k}" in got[k].text and f"nobody has {k}" in got[k].text
        (a, b), = [tuple(s) for s in got[k].spans]
        assert t[:a] + t[b + 1 :] == got[k].text


@settings(max_examples=15, deadline=None)
@given(st.lists(st.one_of(st.none(), st.lists(st.sampled_from(["a b", "A  b ", "c", "", "é f", "x y z"]), max_size=6).map("\n".join)), max_size=6))
def test_lines(spark, texts):
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in S.dedup(docs, min_words=2).collect()}
    assert {d: r.text for d, r in got.items()} == brute(rows, 2)
    for d, t in rows:
        for s in got[d].spans or []:
            assert t[s.start : s.end] in t.split("\n") and (s.start == 0 or t[s.start - 1] == "\n")


def test_paragraphs(spark):
    rows = [(1, "one two\nthree\n\nfour five"), (2, "zero\n \n\nFour  five\n\none two three\n\nlast one"), (3, "four five")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.text, [tuple(s) for s in r.spans or []]) for r in S.dedup(docs, "paragraph", 2).collect()}
    assert got == {1: (rows[0][1], []), 2: ("zero\n \n\nlast one", [(8, 18), (20, 33)]), 3: ("", [(0, 9)])}


def test_odd_rows(spark):
    same = "one two three four five"
    rows = [(5, same), (5, same), (5, same + " six"), (None, same), (None, None), (2, None), (3, ""), (9, same + "\n" + same + "\nend"),
            (1, same + " six"), (8, "long words here and there " * 20_000)]
    docs = spark.createDataFrame([(d, t, 1, "s") for d, t in rows], "doc_id long, text string, start int, spans string")
    got = sorted(((r.doc_id, r.text) for r in S.dedup(docs).collect()), key=str)
    want = [(5, same), (5, same), (5, ""), (None, ""), (None, None), (2, None), (3, ""), (9, "end"), (1, same + " six"), (8, rows[-1][1])]
    assert got == sorted(want, key=str)
    assert S.dedup(docs.limit(0)).collect() == []
    assert S.dedup(docs, carry=("start",)).columns == ["doc_id", "start", "text", "n_units", "spans"]


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '/root/testdata/{sf}/documents.parquet'")
    df = REGISTRY["op8_substring_dedup"](spark, f"/root/testdata/{sf}")
    res = con.execute(SQL["op8_substring_dedup"])
    at = [[d[0] for d in res.description].index(c) for c in df.columns]
    assert sorted(map(tuple, df.collect())) == sorted(tuple(r[i] for i in at) for r in res.fetchall())
    docs = table(spark, f"/root/testdata/{sf}", "documents")
    want = brute_runs([(r.doc_id, r.text) for r in docs.collect()], 2, 30)
    assert {r.doc_id: r.text for r in df.collect()} == want
