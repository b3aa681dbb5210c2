"""License scans with a positional rare-token index.

Templates are short licence notices; the index lists, for every licence word, the templates and positions where it
stands. How many documents hold each licence word is counted over all documents. For each document and template, the
document's rarest words of that template (highest IDF, ``probes`` of them) are looked up; each of their places, less the
posting's position, is a place where the template would begin. Places that at least two of the words agree on, give or take
``slack`` words, are candidates; one is confirmed if every mandatory key phrase of the template stands near it and at
least ``least_cover`` of the template's words do. A template whose key phrases' words a document doesn't have is passed
over at once: it could not be confirmed.

The base phrases are found by the same positions: the places of a phrase are those of its rarest word, kept where the other
words stand at their relative positions. All places count, of whole texts.

Cases: a null or empty text has no words; first_word and last_word are null and the labels empty. A null doc_id is passed
on; repeated rows are scanned each. Other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wingspan.llm.common import texts

# Fixed values of the base: phrase, label.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# Templates of the method: label, notice, mandatory key phrases.
TEMPLATES = (
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation "
            "files to deal in the software without restriction", ("permission is hereby granted free of charge", "without restriction")),
    ("apache", "licensed under the apache license version 2 0", ("apache license", "version 2 0")),
    ("gpl", "this work is licensed under the gnu general public license version 3", ("gnu general public license",)),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license "
            "as published by the free software foundation", ("gnu general public license", "free software foundation")),
    ("lgpl", "licensed under the gnu lesser general public license", ("lesser general public license",)),
    ("cc-by", "licensed under the creative commons attribution 4 0 international license", ("creative commons attribution",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-nc", "licensed under the creative commons attribution noncommercial 4 0 international license", ("creative commons attribution noncommercial",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following "
            "conditions are met", ("redistribution and use in source and binary forms", "following conditions are met")),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
)
_TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "matches array<struct<label:string,word:long,cover:double>>"
)


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_TO_WORDS).split()


class Index:
    """Templates by their words and positions."""

    def __init__(self, df: dict[bytes, int], probes: int, slack: int, least_cover: float) -> None:
        self.df, self.probes, self.slack, self.least_cover = df, probes, slack, least_cover
        self.base = [(p.encode().split(), label) for p, label in BASE]
        self.templates = [(label, notice.encode().split(), [k.encode().split() for k in keys]) for label, notice, keys in TEMPLATES]
        self.postings: list[dict[bytes, list[int]]] = []
        for _, words, _ in self.templates:
            at = defaultdict(list)
            for i, w in enumerate(words):
                at[w].append(i)
            self.postings.append(dict(at))
        self.needed = [frozenset(w for k in keys for w in k) for _, _, keys in self.templates]
        self.words = vocabulary()

    def places(self, phrase: list[bytes], at: dict[bytes, list[int]]) -> list[int]:
        """Where the phrase's words stand one after the other."""
        if any(w not in at for w in phrase):
            return []
        k = min(range(len(phrase)), key=lambda i: len(at[phrase[i]]))
        found = [p - k for p in at[phrase[k]]]
        for i, w in enumerate(phrase):
            if i != k and found:
                there = set(at[w])
                found = [p for p in found if p + i in there]
        return found

    def candidates(self, t: int, at: dict[bytes, list[int]]) -> list[int]:
        """Places where template t would begin, that two or more of its rarest words here agree on."""
        mine = sorted((w for w in self.postings[t] if w in at), key=lambda w: (self.df.get(w, 0), w))[: self.probes]
        votes = sorted({(p - q, w) for w in mine for p in at[w] for q in self.postings[t][w]})
        found, low, held = [], 0, Counter()
        need = min(2, len(mine))
        for begin, w in votes:
            held[w] += 1
            while votes[low][0] < begin - self.slack:
                held[votes[low][1]] -= 1
                held += Counter()
                low += 1
            if len(held) >= need and (not found or votes[low][0] > found[-1] + self.slack):
                found.append(votes[low][0])
        return found

    def scan(self, text: bytes | None) -> dict:
        words = words_of(text)
        at: dict[bytes, list[int]] = defaultdict(list)
        for i, w in enumerate(words):
            if w in self.words:
                at[w].append(i)
        base = [(p, label) for phrase, label in self.base for p in self.places(phrase, at)]
        present, matches = at.keys(), []
        for t, (label, notice, keys) in enumerate(self.templates):
            if not self.needed[t] <= present:
                continue
            keyed = [self.places(k, at) for k in keys]
            if not all(keyed):
                continue
            for begin in self.candidates(t, at):
                low, high = max(0, begin - self.slack), begin + len(notice) + 2 * self.slack
                if all((i := bisect_left(k, low)) < len(k) and k[i] + len(key) <= high for k, key in zip(keyed, keys, strict=True)):
                    cover = len(self.postings[t].keys() & set(words[low:high])) / len(self.postings[t])
                    if cover >= self.least_cover:
                        matches.append({"label": label, "word": max(0, begin), "cover": cover})
        base_labels = {label for _, label in base}
        labels = base_labels | {m["label"] for m in matches}
        starts = [p for p, _ in base]
        return {
            "n_words": len(words), "n_base": len(base), "first_word": min(starts, default=None), "last_word": max(starts, default=None),
            "base_labels": ",".join(sorted(base_labels)), "labels": ",".join(sorted(labels)),
            "score": 1.0 if base else max((m["cover"] for m in matches), default=0.0), "matches": matches,
        }


def vocabulary() -> frozenset[bytes]:
    """The licence words: those of templates and base phrases."""
    return frozenset(w for t in (*(n for _, n, _ in TEMPLATES), *(p for p, _ in BASE)) for w in t.encode().split())


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, counts = vocabulary(), Counter()
    for batch in batches:
        for text in texts(batch):
            counts.update(held.intersection(words_of(text)))
    yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])


def document_counts(docs: DataFrame) -> dict[bytes, int]:
    """In how many documents each licence word stands; as many numbers as there are licence words."""
    counts = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(_document_counts, "word string, n long")
    return {r.word.encode(): r.n for r in counts.groupBy("word").agg(F.sum("n").alias("n")).collect()}


def _scanned(batches: Iterator[pa.RecordBatch], df: dict[bytes, int], probes: int, slack: int, least_cover: float) -> Iterator[pa.RecordBatch]:
    index = Index(df, probes, slack, least_cover)
    kinds = pa.schema([
        ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()),
        ("labels", pa.string()), ("score", pa.float64()),
        ("matches", pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64()), ("cover", pa.float64())]))),
    ])
    for batch in batches:
        found = pa.RecordBatch.from_pylist([index.scan(t) for t in texts(batch)], schema=kinds)
        yield pa.RecordBatch.from_arrays([batch.column(0), *found.columns], ["doc_id", *kinds.names])


def scan(docs: DataFrame, probes: int = 6, slack: int = 4, least_cover: float = 0.7) -> DataFrame:
    """A row for each row of ``docs`` (doc_id, text); score is 1 for a base phrase, else the best cover of a match."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    how = partial(_scanned, df=document_counts(docs), probes=probes, slack=slack, least_cover=least_cover)
    return rows.mapInArrow(how, SCHEMA)
