"""Substring dedup by hashing lines, the phrases of lines, or paragraphs.

A text is cut into units: lines; phrases, which end at a line's end or where blanks follow one of ``. ! ? , ; :``; or
paragraphs between blank lines. A unit is normalised (A-Z lowered, white space collapsed); one with at least ``min_words``
words gets a digest. Over all documents, the earliest occurrence of a digest is kept, and the others are repeats: occurrences
rank by doc_id (null last), then by a hash of the document's text, then by offset, so there are repeats within a document
too. Repeats go where neighbours among them hold ``min_run`` words together; units of fewer than ``min_words`` words
between two repeats count and go with them. So a passage goes though it begins and ends within a line, and a short line or
phrase that many documents share by itself stays. Spans of what goes refer to the original text, in characters.

Only digests and places are shuffled for the search: a digest that stands in a third of all rows is reduced within each
task first, and the join that tells its places apart is an ordinary one, which Spark splits where it is skewed. Runs are
found in the text itself, from the places of its repeats.

Cases: a null text has no units and stays null; an empty one stays empty. Rows that share doc_id and text are one
document given twice: they keep and lose the same units. Rows that share only doc_id are documents of their own. Other
columns are not read, so their names can't clash. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wingspan.llm.common import SLICE_ROWS, cut

_BREAKS = {"line": re.compile(r"\n"), "phrase": re.compile(r"(?<=[.!?,;:])[ \t]+|\n"), "paragraph": re.compile(r"\n[ \t]*\n\s*")}
SPANS = "array<struct<start:long,end:long>>"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def units_of(text: str, unit: str) -> list[tuple[int, int]]:
    """(start, end) of every unit."""
    edges = [0]
    for m in _BREAKS[unit].finditer(text):
        edges += m.span()
    edges.append(len(text))
    return list(zip(edges[::2], edges[1::2], strict=True))


def normalised(unit: str) -> list[bytes]:
    """The words that the digest of a unit is made of."""
    return unit.encode().lower().split()


def _units(batches: Iterator[pa.RecordBatch], unit: str, min_words: int) -> Iterator[pa.RecordBatch]:
    names = ["digest", "words", "doc_id", "text_hash", "start"]
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            part = batch.slice(at, SLICE_ROWS)
            digests, sizes, row, starts = [], [], [], []
            for i, text in enumerate(part.column(2).to_pylist()):
                for a, b in units_of(text, unit) if text else ():
                    if len(words := normalised(text[a:b])) >= min_words:
                        digests.append(xxhash.xxh3_64_intdigest(b" ".join(words)))
                        sizes.append(len(words))
                        row.append(i)
                        starts.append(a)
            own = pa.array(row, pa.int64())
            halves = [pa.array(np.array(digests, np.uint64).astype(np.int64)), pa.array(sizes, pa.int32())]
            yield pa.RecordBatch.from_arrays([*halves, part.column(0).take(own), part.column(1).take(own), pa.array(starts, pa.int32())], names)


def _identified(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")


def repeats(docs: DataFrame, unit: str = "line", min_words: int = 5) -> DataFrame:
    """(doc_id, text_hash, starts): for each document with repeats, where they begin."""
    places = _identified(docs).mapInArrow(
        partial(_units, unit=unit, min_words=min_words), "digest long, words int, doc_id long, text_hash long, start int"
    )
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash", "start")
    first = places.groupBy("digest", "words").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    # Written out, so that the join stands right on two shuffles and Spark can split a digest of many places. The places
    # are cut from the texts again for it: they would take more room than the texts.
    first = cut(first)
    later = places.join(first, ["digest", "words"]).filter(place != F.col("first"))
    return later.groupBy("doc_id", "text_hash").agg(F.collect_set("start").alias("starts"))


def runs(sizes: list[int], repeated: list[bool], min_words: int, min_run: int) -> list[tuple[int, int]]:
    """(first, last) unit of every run that goes. sizes: words by unit; a run begins and ends with a repeat."""
    out: list[tuple[int, int]] = []
    first = last = -1
    held = between = 0
    for i, (n, again) in enumerate(zip([*sizes, min_words], [*repeated, False], strict=True)):  # the one at the end ends a run
        if again:
            first = i if first < 0 else first
            held, between, last = held + between + n, 0, i
        elif n < min_words:
            between += n
        else:
            if first >= 0 and held >= min_run:
                out.append((first, last))
            first, held, between = -1, 0, 0
        if first < 0:
            between = 0
    return out


def _without(batches: Iterator[pa.RecordBatch], unit: str, min_words: int, min_run: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            part = batch.slice(at, SLICE_ROWS)
            *passed, source, starts = part.columns
            kept, n_units, spans = [], [], []
            for text, again in zip(source.to_pylist(), starts.to_pylist(), strict=True):
                units = units_of(text, unit) if text else []
                n_units.append(len(units))
                found = []
                if again:
                    begun = set(again)
                    repeated = [a in begun for a, _ in units]
                    found = runs([len(normalised(text[a:b])) for a, b in units], repeated, min_words, min_run)
                    found = found if min_run else [(i, i) for i, x in enumerate(repeated) if x]
                if found:
                    gone = {i for a, b in found for i in range(a, b + 1)}
                    # a unit goes with the break that follows it
                    out = [text[a : units[i + 1][0] if i + 1 < len(units) else len(text)] for i, (a, _) in enumerate(units) if i not in gone]
                    spans.append([{"start": units[a][0], "end": units[b][1]} for a, b in found])
                    text = "".join(out)
                    if len(units) - 1 in gone and out:  # the break before a last unit that went
                        text = text[: len(text) - _last_break(units, gone)]
                else:
                    spans.append(None)
                kept.append(text)
            told = [pa.array(kept, pa.string()), pa.array(n_units, pa.int64()), pa.array(spans, _SPANS)]
            yield pa.RecordBatch.from_arrays([*passed, *told], batch.schema.names[:-2] + ["text", "n_units", "spans"])


def _last_break(units: list[tuple[int, int]], gone: set[int]) -> int:
    last = max(i for i in range(len(units)) if i not in gone)
    return units[last + 1][0] - units[last][1]


def dedup(docs: DataFrame, unit: str = "line", min_words: int = 5, min_run: int = 0, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, *carry, text, n_units, spans) for every row of ``docs``: its text without repeats, and what went, run by run.

    With ``min_run`` 0 every repeat goes, and has a span of its own.
    """
    lost = repeats(docs, unit, min_words).select(F.col("doc_id").alias("__lost_id"), F.col("text_hash").alias("__lost_hash"), "starts")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *carry, "text", F.xxhash64("text").alias("__text_hash"))
    same = F.col("__lost_id").eqNullSafe(F.col("doc_id")) & (F.col("__lost_hash") == F.col("__text_hash"))
    joined = own.join(lost, same, "left").select("doc_id", *carry, "text", F.col("starts").alias("__starts"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema[:-2])
    how = partial(_without, unit=unit, min_words=min_words, min_run=min_run)
    return joined.mapInArrow(how, f"{schema}, text string, n_units long, spans {SPANS}")


# Rows of op8_substring_dedup: phrases, two words, runs of thirty, doc_id unique; U+E000 marks the breaks and stands in no text.
SQL = r"""
WITH marked AS (
  SELECT doc_id, string_split(replace(regexp_replace(text, '([.!?,;:])([ \t]+)', '\1' || chr(57344) || '\2' || chr(57344), 'g'),
    chr(10), chr(57344) || chr(10) || chr(57344)), chr(57344)) AS parts
  FROM documents WHERE text <> ''
), units AS (
  SELECT doc_id, unnest(range((len(parts) + 1) // 2)) AS k, unnest(list_transform(range((len(parts) + 1) // 2), lambda i: parts[2 * i + 1])) AS unit,
    unnest(list_transform(range((len(parts) + 1) // 2), lambda i: coalesce(parts[2 * i + 2], ''))) AS gap
  FROM marked
), placed AS (
  SELECT doc_id, k, unit, gap, sum(length(unit) + length(gap)) OVER (PARTITION BY doc_id ORDER BY k) - length(unit) - length(gap) AS begun,
    regexp_extract_all(translate(unit, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM units
), judged AS (
  SELECT *, len(words) AS n, len(words) >= 2
    AND row_number() OVER (PARTITION BY array_to_string(words, ' ') ORDER BY doc_id, k) > 1 AS again
  FROM placed
), islands AS (
  SELECT *, sum((n >= 2 AND NOT again)::INT) OVER (PARTITION BY doc_id ORDER BY k) AS island FROM judged
), ends AS (
  SELECT *, min(CASE WHEN again THEN k END) OVER own AS first_k, max(CASE WHEN again THEN k END) OVER own AS last_k
  FROM islands WINDOW own AS (PARTITION BY doc_id, island)
), held AS (
  SELECT *, coalesce(k BETWEEN first_k AND last_k, false) AS inside FROM ends
), decided AS (
  SELECT *, inside AND sum(CASE WHEN inside THEN n ELSE 0 END) OVER (PARTITION BY doc_id, island) >= 30 AS gone FROM held
), last_kept AS (
  SELECT doc_id, max(CASE WHEN NOT gone THEN k END) AS kept_k, max(k) AS end_k FROM decided GROUP BY doc_id
), spans AS (
  SELECT doc_id, island, min(begun) AS a, max(begun + length(unit)) AS b FROM decided WHERE gone GROUP BY doc_id, island
), told AS (
  SELECT doc_id, count(*) AS n_units,
    string_agg(CASE WHEN k = kept_k AND kept_k < end_k THEN unit ELSE unit || gap END, '' ORDER BY k) FILTER (NOT gone) AS text
  FROM decided JOIN last_kept USING (doc_id) GROUP BY doc_id
), removed AS (
  SELECT doc_id, count(*) AS n_removed, string_agg(a || '-' || b, ',' ORDER BY a) AS removed FROM spans GROUP BY doc_id
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(t.text, '') END AS text,
  coalesce(n_units, 0) AS n_units, coalesce(n_removed, 0) AS n_removed, coalesce(removed, '') AS removed
FROM documents d LEFT JOIN told t USING (doc_id) LEFT JOIN removed USING (doc_id)
"""
