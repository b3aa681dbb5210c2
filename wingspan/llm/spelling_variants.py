"""Spelling variants of words, found by pivotal grams.

Words are runs of Latin letters of all texts, with A-Z lowered and now and then a letter left out by a rule that depends on
the document and the word alone. Words of ``min_length`` code points that occur ``min_count`` times are compared: two are
near if one inserted, deleted or replaced code point turns one into the other. A word's form is its most frequent near word,
if that is at least ``twice`` as frequent; its root is where the forms lead to.

Pairs are found by an index of bigrams ordered by how rare they are. A word's prefix is its three rarest bigrams (2 x 1 + 1
for one edit), with the next places of the last one; its pivots are the two of those three that don't overlap and are the rarest
together, chosen by dynamic programming. One edit spoils at most one pivot, and of two near words one has an unspoilt pivot
in the other's prefix, at most one place off. Beside that bigram the words agree on one whole side of it, and on
the other side in its first or its second half; pivots and prefixes meet by a join on a hash of just that, so a group holds
only words that are all but near, however frequent their bigrams are. Every pair that meets is verified.

Cases: a null or empty text has no words; a null doc_id counts as empty in the rule. Repeated rows count each, with the rule
by their doc_id. Ties between near words of equal n go to the smallest in code-point order. A word without near words has
n_near 0 and null form and form_n. Other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wingspan.llm.common import SLICE_ROWS, cut

_RUN = re.compile("[A-Za-zÀ-ÿ]+")
#: One document in so many leaves a letter out of a word.
SLIP = 97
#: One edit touches at most this many bigrams.
GRAM = 2


def slipped(head: int, run: str) -> str:
    """The run as it counts, where ``head`` is the CRC-32 of the document's id and a colon."""
    h = zlib.crc32(run.encode(), head)
    if h % SLIP:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _count(batches: Iterator[pa.RecordBatch], min_length: int, held: int) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()

    def out() -> pa.RecordBatch:
        kept = [(w, n) for w, n in counts.items() if n and len(w) >= min_length]
        counts.clear()
        return pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], ["word", "n"])

    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            for doc_id, text in zip(*(c.to_pylist() for c in batch.slice(at, SLICE_ROWS).columns), strict=True):
                runs = _RUN.findall(text.encode().lower().decode()) if text else []  # bytes.lower changes A-Z only
                counts.update(runs)
                head, own = zlib.crc32(f"{doc_id}:".encode()), None
                for run in set(runs):
                    if not zlib.crc32(run.encode(), head) % SLIP:
                        own = own or Counter(runs)
                        counts[run] -= own[run]
                        counts[slipped(head, run)] += own[run]
            if len(counts) > held:
                yield out()
    yield out()


def word_counts(docs: DataFrame, min_length: int = 5, min_count: int = 3, held: int = 300_000) -> DataFrame:
    """(word, n) for the words to compare, counted over all rows of ``docs`` (doc_id, text)."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")).alias("doc_id"), "text")
    parts = rows.mapInArrow(partial(_count, min_length=min_length, held=held), "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()
    for batch in batches:
        for word in batch.column(0).to_pylist():
            counts.update(map(str.__add__, word, word[1:]))
    yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["gram", "n"])


def gram_counts(words: DataFrame) -> dict[str, int]:
    """How often each bigram stands in the words: at most the square of the 90 letters, 8,100 rows."""
    parts = words.select("word").mapInArrow(_count_grams, "gram string, n long")
    return {r.gram: r.n for r in parts.groupBy("gram").agg(F.sum("n").alias("n")).collect()}


def prefix_and_pivots(word: str, counts: dict[str, int], edits: int = 1) -> tuple[list[int], list[int]]:
    """The places of a word's prefix bigrams (rarest first) and of its pivots, for so many edits.

    A word too short for a prefix has None of either. Order: rarer bigrams first, ties by the bigram, then by place.
    """
    grams = list(map(str.__add__, word, word[1:]))
    order = sorted(range(len(grams)), key=lambda p: (counts.get(grams[p], 0), grams[p], p))
    size = GRAM * edits + 1
    if len(order) < size:
        return [], []
    # Of the last bigram's other places those count that can face a pivot: one of the first ``size`` of a near word, to which
    # the edits add no more than GRAM * edits before it.
    last = grams[order[size - 1]]
    same = [p for p in order if grams[p] == last][: size + GRAM * edits]
    prefix = order[:size] + [p for p in same if p not in order[:size]]
    # least[k]: (weight, places) of the cheapest k bigrams without overlap among the first of the prefix, in order of place
    places = sorted(order[:size])
    least: list[list[tuple[int, list[int]] | None]] = [[(0, [])] + [None] * (edits + 1)]
    for i, p in enumerate(places):
        before = next((j for j in range(i, 0, -1) if places[j - 1] + GRAM <= p), 0)
        row = list(least[i])
        for k in range(1, edits + 2):
            if (some := least[before][k - 1]) is not None:
                new = (some[0] + counts.get(grams[p], 0), [*some[1], p])
                row[k] = new if row[k] is None else min(row[k], new)
        least.append(row)
    return prefix, least[-1][edits + 1][1]


def _halves(kept: str, rest: str, length: int, of: int, tail: bool) -> Iterator[int]:
    """Hashes of one side kept whole and either half of the other, as a word of ``length`` with ``of`` letters there cuts it."""
    half = of // 2
    if half <= len(rest):
        yield xxhash.xxh3_64_intdigest(f"{length} {tail:d}0 {kept} {rest[:half]}") - (1 << 63)
    if of - half <= len(rest):
        yield xxhash.xxh3_64_intdigest(f"{length} {tail:d}1 {kept} {rest[len(rest) - (of - half):]}") - (1 << 63)


def signatures(word: str, at: int, lengths: range) -> Iterator[int]:
    """The hashes under which a word with a bigram at ``at`` meets words of these lengths that have it too."""
    for length in lengths:
        for tail, (kept, rest) in enumerate(((word[: at + GRAM], word[at + GRAM :]), (word[at:], word[:at]))):
            if (of := length - len(kept)) >= 0:
                yield from _halves(kept, rest, length, of, bool(tail))


def _indexed(batches: Iterator[pa.RecordBatch], counts: dict[str, int]) -> Iterator[pa.RecordBatch]:
    """(pivot, key, word, n): under the keys of its pivots a word asks, under those of its prefix it is found."""
    for batch in batches:
        for begin in range(0, batch.num_rows, 2048):
            pivot, keys, words, of_n = [], [], [], []
            for word, n in zip(*(c.to_pylist() for c in batch.slice(begin, 2048).columns), strict=True):
                prefix, pivots = prefix_and_pivots(word, counts)
                for asks, places, lengths in ((True, pivots, range(len(word), len(word) + 1)), (False, prefix, range(len(word) - 1, len(word) + 2))):
                    own = {k for p in places for k in signatures(word, p, lengths)}
                    keys += own
                    pivot += [asks] * len(own)
                    words += [word] * len(own)
                    of_n += [n] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(pivot, pa.bool_()), pa.array(keys, pa.int64()), pa.array(words, pa.string()), pa.array(of_n, pa.int64())], ["pivot", "key", "word", "n"])


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, near, near_n) for every ordered pair of near words among ``words`` (word, n), words distinct."""
    index = cut(words.select("word", "n").mapInArrow(partial(_indexed, counts=gram_counts(words)), "pivot boolean, key long, word string, n long"))
    asks = index.filter("pivot").select("key", F.col("word").alias("a"), F.col("n").alias("a_n"))
    found = index.filter("NOT pivot").select("key", F.col("word").alias("b"), F.col("n").alias("b_n"))
    met = asks.join(found, "key").filter("a <> b").filter(F.levenshtein("a", "b", 1) == 1)
    way = lambda x, y: F.struct(F.col(x).alias("word"), F.col(y).alias("near"), F.col(f"{y}_n").alias("near_n"))
    return met.select(F.explode(F.array(way("a", "b"), way("b", "a"))).alias("p")).select("p.*").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for rows (word, form): forms followed to their last, each round twice as far as the one before.

    Forms lead to words of twice the n, so a chain has no circle and at most 63 steps, and 7 rounds do.
    """
    chain = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        further = chain.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = cut(chain.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("went")))
        chain = moved.select("word", "root")
        if moved.filter("went").isEmpty():
            return chain


def variants(docs: DataFrame, min_length: int = 5, min_count: int = 3, twice: int = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of ``docs`` (doc_id, text) that is compared."""
    if min_length < 2 * GRAM:
        raise ValueError("words of under 4 code points have no prefix of three bigrams")
    words = cut(word_counts(docs, min_length, min_count))
    most = F.min(F.struct((-F.col("near_n")).alias("minus"), "near"))
    near = cut(near_pairs(words).groupBy("word").agg(F.count("*").alias("n_near"), most.alias("most")))
    told = words.join(near, "word", "left")
    form = F.when(-F.col("most.minus") >= twice * F.col("n"), F.col("most.near"))
    told = cut(told.select("word", form.alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(form.isNotNull(), -F.col("most.minus")).alias("form_n")))
    ends = roots(told.filter("form IS NOT NULL"))
    return told.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


# Rows of op12_spelling_variants. Near words by the words that one deletion leaves; CRC-32 by its table of 256 remainders.
SQL = r"""
WITH RECURSIVE remainders(i, k, c) AS (
  SELECT range::BIGINT, 0, range::BIGINT FROM range(256)
  UNION ALL
  SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM remainders WHERE k < 8
), crc AS (SELECT list(c ORDER BY i) AS t FROM remainders WHERE k = 8
), runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run
  FROM documents WHERE text <> ''
), told AS (
  SELECT doc_id, run, count(*) AS n FROM runs GROUP BY ALL
), bytes AS (
  SELECT run, n, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''), lambda s:
    CASE WHEN unicode(s) < 128 THEN [unicode(s)::BIGINT] ELSE [192 + (unicode(s) >> 6)::BIGINT, 128 + (unicode(s) & 63)::BIGINT] END)) AS b
  FROM told
), hashed AS (
  SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, b), lambda h, x: xor(h >> 8, crc.t[(xor(h, x) & 255) + 1]))) AS h
  FROM bytes, crc
), slips AS (
  SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, n FROM hashed
), words AS (
  SELECT word, sum(n)::BIGINT AS n FROM slips WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
), places AS (
  SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM words
), cuts AS (
  SELECT word, n, p, length(word) AS size, substr(word, 1, p - 1) || substr(word, p + 1) AS part FROM places
), pairs AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM cuts a JOIN cuts b ON a.part = b.part AND a.p = b.p AND a.size = b.size AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cuts a JOIN words b ON a.part = b.word
  UNION SELECT b.word, a.word, a.n FROM cuts a JOIN words b ON a.part = b.word
), near AS (
  SELECT word, count(*) AS n_near, max(near_n) AS most FROM pairs GROUP BY word
), forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 2 * w.n THEN most END AS form_n,
    CASE WHEN most >= 2 * w.n THEN (SELECT min(near) FROM pairs p WHERE p.word = w.word AND p.near_n = r.most) END AS form
  FROM words w LEFT JOIN near r USING (word)
), walk(word, place) AS (
  SELECT word, word FROM forms
  UNION ALL
  SELECT walk.word, forms.form FROM walk JOIN forms ON forms.word = walk.place WHERE forms.form IS NOT NULL
), ends AS (
  SELECT walk.word, walk.place AS root FROM walk JOIN forms ON forms.word = walk.place WHERE forms.form IS NULL
)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN ends USING (word)
"""
