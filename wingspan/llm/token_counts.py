"""Token counts by field and section, from one encoding of each whole document.

The fields of a row are written one after the other, each led by a label; the whole is encoded once and every token's
character span is kept. The spans of the sections (labels, fields, and the lines of ``by_line`` fields) cut the whole into
runs, and tokens meet them in an interval join on sorted bounds. A token that crosses a boundary goes to the section that
holds most of its characters, the earliest of equal ones (rule ``most``), or to the one that holds its first character
(rule ``first``); either way each token counts once, so the sections' counts add up to the document's.

A document's spans come from the spans within its distinct words, which are merged once by the vocabulary's ranks; each
task holds a bounded number of words.

Cases: a null field counts as empty, with 0 tokens. An empty section has 0 tokens. Repeated rows, rows that share a
doc_id and rows with a null doc_id are counted one by one. Only doc_id and the named fields are read. An empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wingspan.llm.bpe_transducer import Vocabulary
from wingspan.llm.common import SLICE_ROWS
from wingspan.llm.word_ids import WordTable

SCHEMA = "doc_id long, field string, section long, start long, stop long, n_tokens long, n_crossing long"


def laid_out(values: dict[str, str | None], by_line: tuple[str, ...]) -> tuple[str, list[tuple[str, int, int]]]:
    """The whole text of a row and its sections (field, number, start), in order; labels are the field ``label``."""
    parts, sections, at = [], [], 0

    def put(field: str, number: int, text: str) -> None:
        nonlocal at
        parts.append(text)
        sections.append((field, number, at))
        at += len(text)

    for i, (field, value) in enumerate(values.items()):
        put("label", i, f"{field}: ")
        lines = (value or "").split("\n") if field in by_line else [value or ""]
        for k, line in enumerate(lines):
            put(field, k, line + "\n" * (k < len(lines) - 1))
        put("label", i, "\n\n")
    return "".join(parts), sections


def allocate(starts: np.ndarray, stops: np.ndarray, bounds: np.ndarray, length: int, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """How many tokens each section gets, and how many of those cross a boundary. bounds: where each section begins."""
    first = np.searchsorted(bounds, starts, side="right") - 1
    last = np.searchsorted(bounds, np.maximum(stops - 1, starts), side="right") - 1
    crossing = np.flatnonzero(first != last)
    owner = first.copy()
    if rule == "most":
        ends = np.r_[bounds[1:], length]
        for t in crossing.tolist():
            run = np.arange(first[t], last[t] + 1)
            held = np.minimum(ends[run], stops[t]) - np.maximum(bounds[run], starts[t])
            owner[t] = run[int(np.argmax(held))]
    n = len(bounds)
    return np.bincount(owner, minlength=n), np.bincount(owner[crossing], minlength=n)


class SpanEncoder:
    """Token ids and character spans of texts."""

    def __init__(self, spec: str) -> None:
        self.vocabulary = Vocabulary(spec)
        self.table = WordTable(self._words)

    def _words(self, words: list[str]) -> Iterator[list[int]]:
        """For each word, (id, start, stop) of its tokens, one after the other."""
        sizes = self.vocabulary.bytes_of
        for word in words:
            ids = self.vocabulary.encode_word(word)
            if word in self.vocabulary.special:
                yield [ids[0], 0, len(word)]
                continue
            char_of = range(len(word)) if word.isascii() else [i for i, c in enumerate(word) for _ in c.encode()]
            out, at = [], 0
            for x in ids:
                stop = at + len(sizes[x])
                out += [x, char_of[at], char_of[stop - 1] + 1]
                at = stop
            yield out

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(ids, starts, stops) for each text."""
        split = [self.vocabulary.split(t) for t in texts]
        for words, rows in zip(split, self.table.rows(split), strict=True):
            found = self.table.ids(rows).reshape(-1, 3)
            sizes = np.fromiter(map(len, words), np.int64, len(words))
            begin = np.repeat(np.cumsum(sizes) - sizes, self.table.count[rows] // 3)
            yield found[:, 0], found[:, 1] + begin, found[:, 2] + begin


@lru_cache(maxsize=2)
def _encoder(spec: str) -> SpanEncoder:
    return SpanEncoder(spec)


def _attributed(batches: Iterator[pa.RecordBatch], spec: str, by_line: tuple[str, ...], rule: str) -> Iterator[pa.RecordBatch]:
    encoder, names = _encoder(spec), [x.split()[0] for x in SCHEMA.split(", ")]
    for batch in batches:
        fields = batch.schema.names[1:]
        for at in range(0, batch.num_rows, SLICE_ROWS):
            ids, *columns = (c.to_pylist() for c in batch.slice(at, SLICE_ROWS).columns)
            laid = [laid_out(dict(zip(fields, values, strict=True)), by_line) for values in zip(*columns, strict=True)]
            out: tuple[list, ...] = tuple([] for _ in names)
            for doc_id, (whole, sections), (_, starts, stops) in zip(ids, laid, encoder.encode([w for w, _ in laid]), strict=True):
                bounds = np.array([s for _, _, s in sections])
                n, crossing = allocate(starts, stops, bounds, len(whole), rule)
                out[0].extend([doc_id] * len(sections))
                for column, values in zip(out[1:4], zip(*sections, strict=True), strict=True):
                    column.extend(values)
                out[4].extend([*bounds[1:].tolist(), len(whole)])
                out[5].extend(n.tolist())
                out[6].extend(crossing.tolist())
            kinds = [pa.int64(), pa.string(), *[pa.int64()] * 5]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names)


def attribute(docs: DataFrame, spec_path: str, fields: tuple[str, ...], by_line: tuple[str, ...] = (), rule: str = "most") -> DataFrame:
    """A row for each section of each row of ``docs`` (doc_id and ``fields``), in one pass without a shuffle.

    doc_id, field, section (its number in the field), start, stop (its characters in the whole), n_tokens, n_crossing.
    """
    if rule not in ("most", "first"):
        raise ValueError("rule is 'most' or 'first'")
    with open(spec_path, encoding="utf-8") as f:
        spec = f.read()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.col(f).cast("string").alias(f) for f in fields])
    return rows.mapInArrow(partial(_attributed, spec=spec, by_line=by_line, rule=rule), SCHEMA)
