"""Spelling variants: pivots, near pairs and the whole table against plain versions."""

import random
import re
import zlib
from collections import Counter
from itertools import combinations

from hypothesis import given, settings
from hypothesis import strategies as st

from wingspan.llm import spelling_variants as S
from wingspan.llm.common import table


def near(a, b):
    """Whether one inserted, deleted or replaced letter turns a into b."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 5 and c >= 3}
    by_part = {}
    for w in n:
        for part in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            by_part.setdefault(part, []).append(w)
    links = {w: {x for part in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))} for x in by_part[part] if near(w, x)} for w in n}
    form = {}
    for w, others in links.items():
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(links[w]), n.get(form[w])))
    return sorted(out)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abcé", min_size=4, max_size=12), st.dictionaries(st.text(alphabet="abcé", min_size=2, max_size=2), st.integers(0, 5)), st.integers(1, 2))
def test_pivots_are_the_rarest_without_overlap(word, counts, edits):
    prefix, pivots = S.prefix_and_pivots(word, counts, edits)
    if len(word) - 1 < 2 * edits + 1:
        assert not prefix and not pivots
        return
    cost = lambda places: sum(counts.get(word[p : p + 2], 0) for p in places)
    apart = lambda places: all(b - a >= 2 for a, b in zip(places, places[1:]))  # noqa: B905, E731
    sets = [c for c in combinations(sorted(prefix[: 2 * edits + 1]), edits + 1) if apart(c)]
    assert apart(pivots) and cost(pivots) == min(map(cost, sets)) and len(pivots) == edits + 1


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="abé", min_size=4, max_size=10), st.sampled_from(["replace", "insert", "delete"]), st.integers(0, 10), st.sampled_from("abéz"), st.dictionaries(st.text(alphabet="abéz", min_size=2, max_size=2), st.integers(0, 3)))
def test_near_words_meet(word, how, at, letter, counts):
    at = min(at, len(word) - 1)
    other = {"replace": word[:at] + letter + word[at + 1 :], "insert": word[:at] + letter + word[at:], "delete": word[:at] + word[at + 1 :]}[how]
    if len(other) < 4 or other == word:
        return
    keys = {}
    for w in (word, other):
        prefix, pivots = S.prefix_and_pivots(w, counts)
        asked = {k for p in pivots for k in S.signatures(w, p, range(len(w), len(w) + 1))}
        held = {k for p in prefix for k in S.signatures(w, p, range(len(w) - 1, len(w) + 2))}
        keys[w] = asked, held
    assert keys[word][0] & keys[other][1] or keys[other][0] & keys[word][1]


def test_near_pairs(spark):
    dice = random.Random(5)
    words = {"".join(dice.choice("abcdé") for _ in range(dice.randint(5, 8))) for _ in range(1500)}
    words |= {"a" * k for k in range(5, 40)} | {"ab" * k for k in range(3, 20)} | {"x" * 300, "x" * 301, "y" + "x" * 300}
    rows = spark.createDataFrame([(w, len(w)) for w in words], "word string, n long")
    got = sorted(map(tuple, S.near_pairs(rows).collect()))
    ordered = sorted(words)
    both = [(a, b) for a, b in combinations(ordered, 2) if near(a, b)]
    assert got == sorted((x, y, len(y)) for a, b in both for x, y in ((a, b), (b, a)))


def test_roots(spark):
    forms = [(f"w{i}", f"w{i + 1}") for i in range(40)] + [(f"x{i}", "w0") for i in range(200)]
    got = dict(map(tuple, S.roots(spark.createDataFrame(forms, "word string, form string")).collect()))
    assert got == {w: "w40" for w, _ in forms}
    assert S.roots(spark.createDataFrame([], "word string, form string")).collect() == []


def test_table(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    assert sorted(map(tuple, S.variants(docs).collect())) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "12 !"), (None, "house House HOUSE hause"), (4, "hause hause house " * 40), (4, "hause hause house " * 40),
            (5, "housé ÄÖÜßé äöüßé éclair" * 9), (6, "×÷×÷× ×÷×÷×a " * 5), (7, "ab cde fghi " * 50), (8, "mouse " * 20_000), (9, "z" * 50_000 + " " + "z" * 50_000 + " " + "z" * 50_000)]
    docs = spark.createDataFrame([(*r, "w", 1) for r in rows], "doc_id long, text string, word string, n int")
    assert sorted(map(tuple, S.variants(docs).collect())) == brute(rows)
    assert S.variants(docs.limit(0)).collect() == []
