"""Alignment of two tokenizers' tokens over exact-text duplicates.

Tokenizer A (byte-level BPE) and tokenizer B (sentencepiece BPE with byte fallback) both encode a blank and the text. Where
tokens of both end at the same byte the text is cut into groups; an A and a B token are linked where their bytes overlap.

Rows are shuffled by their full text, so that each distinct text is tokenised and aligned once, with the number of its
rows; what it gives (its sizes, the digest of its groups, its distinct pairs of linked ids with their numbers) is written to
the shared folder. Counts of the pairs over the corpus, each text weighted by its rows, and then the sums of those counts
over a text's links are taken from there. The measures of a text go to all doc_ids that carry it, by a join on the text's
SHA-256.

Both tokenizers always cut before a blank or line break that follows a character which isn't white space, so a text is
aligned unit by unit between such places, and a task holds a bounded number of distinct units. The ``hot_pairs`` most
frequent pairs go with the tasks, a bounded table; links of all other pairs are joined with their counts.

Cases: a null or empty text has no tokens: zeros and an empty digest; so has a text whose bytes A's or B's tokens don't give
back (one that holds U+2581, which B reads as a blank), and such texts count in no pair. Rows that repeat a text, a doc_id or
both are rows of their own, and each counts in the pairs. A null doc_id is passed on. Other columns are not read. An empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, partial
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wingspan.llm.bpe_transducer import Vocabulary
from wingspan.llm.common import SLICE_ROWS, cut
from wingspan.session import scratch_path

#: A unit starts at a blank or line break that follows a character which isn't white space (or at the first character).
_UNIT = re.compile(r"[ \n][^ \n]*(?:(?<=\s)[ \n][^ \n]*)*")
_BYTE = re.compile(r"<0x([0-9A-F]{2})>\Z")
MEASURES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
_SIZES = MEASURES[:4]
_PAIR_BITS = 32


def align(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(group ends, A's place of each link, B's place of each link, the links' ends), from the bytes at which tokens end.

    Both sides end at the same last byte. Each run between two neighbouring ends, of either side, is the overlap of
    exactly one A and one B token, so links are as many as distinct ends.
    """
    every = np.union1d(ends_a, ends_b)
    return np.intersect1d(ends_a, ends_b, assume_unique=True), np.searchsorted(ends_a, every), np.searchsorted(ends_b, every), every


@dataclass
class Aligned:
    """Some units: by unit whether both sides give its bytes, sizes and groups as text; the links' pairs, one unit after another."""

    right: np.ndarray
    sizes: np.ndarray  # units x (n_a, n_b, n_groups, n_links)
    said: list[str]
    pairs: np.ndarray


class Aligner:
    """Units to ids, groups and links of both tokenizers."""

    def __init__(self, spec: str, model: bytes) -> None:
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(spec)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        of_a = Vocabulary(spec).bytes_of
        self.a_bytes = [of_a.get(i, b"") for i in range(max(of_a) + 1)]
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any("\n" in p or "▁" in p.lstrip("▁") for p in pieces) or self.b.encode("a", out_type=str) != ["▁a"]:
            raise ValueError("units can't be told apart: a piece of tokenizer B goes past a blank or line break")
        self.b_bytes = [bytes([int(m[1], 16)]) if (m := _BYTE.match(p)) else p.replace("▁", " ").encode() for p in pieces]
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in of]) for of in (self.a_bytes, self.b_bytes))
        numbers = range(max(len(self.a_bytes), len(self.b_bytes)))
        self.written = np.array([[f"{i}{after}" for i in numbers] for after in ",|;"], object)  # an id and what follows it

    def encode(self, units: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """The ids of both tokenizers for each unit, as they stand in any text."""
        led = self.b.encode(["a" + u for u in units], num_threads=1)  # the leading "a" keeps a unit from the start of a text
        return [x.ids for x in self.a.encode_batch_fast(units, add_special_tokens=False)], [ids[1:] for ids in led]

    def align(self, units: list[str]) -> Aligned:
        a, b = self.encode(units)
        raw = [u.encode() for u in units]
        right = np.ones(len(units), bool)
        whole = b"".join(raw)
        if any(b"".join(map(of.__getitem__, chain.from_iterable(ids))) != whole for of, ids in ((self.a_bytes, a), (self.b_bytes, b))):
            for i, x in enumerate(raw):
                right[i] = b"".join(map(self.a_bytes.__getitem__, a[i])) == x == b"".join(map(self.b_bytes.__getitem__, b[i]))
        keep = np.flatnonzero(right)
        if len(keep) < len(units):
            a, b, raw = ([x[i] for i in keep.tolist()] for x in (a, b, raw))
        n_a, n_b, n_bytes = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b, raw))
        ids_a, ids_b = (np.fromiter(chain.from_iterable(x), np.int64, int(n.sum())) for x, n in ((a, n_a), (b, n_b)))
        ends_a, ends_b, unit_ends = np.cumsum(self.a_sizes[ids_a]), np.cumsum(self.b_sizes[ids_b]), np.cumsum(n_bytes)
        groups, at_a, at_b, every = align(ends_a, ends_b)
        sizes, said = np.zeros((len(units), len(_SIZES)), np.int64), [""] * len(units)
        in_units = lambda ends: np.diff(np.searchsorted(ends, unit_ends, side="right"), prepend=0)
        sizes[keep] = np.column_stack([n_a, n_b, in_units(groups), in_units(every)])
        # ids in the order of the text form: a group's A ids, then its B ids; "|" after the last of A, ";" after the last of B
        group_a, group_b = np.searchsorted(groups, ends_a), np.searchsorted(groups, ends_b)
        order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
        after = np.concatenate([np.isin(ends_a, groups, assume_unique=True), 2 * np.isin(ends_b, groups, assume_unique=True)])
        parts = self.written[after[order], np.concatenate([ids_a, ids_b])[order]].tolist()
        stops = np.cumsum(n_a + n_b).tolist()
        for i, begin, stop in zip(keep.tolist(), [0, *stops], stops):  # noqa: B905
            said[i] = "".join(parts[begin:stop])
        return Aligned(right, sizes, said, (ids_a[at_a] << _PAIR_BITS) | ids_b[at_b])


@lru_cache(maxsize=2)
def _aligner(spec: str, model: bytes) -> Aligner:
    return Aligner(spec, model)


class Units:
    """The units met so far, by number; ``of`` starts anew once they have passed a bound."""

    def __init__(self, aligner: Aligner, most: int = 300_000, most_chars: int = 8_000_000) -> None:
        self.aligner, self.most, self.most_chars = aligner, most, most_chars
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.said: list[str] = []
        self.right = np.zeros(0, bool)
        self.sizes = np.zeros((0, len(_SIZES)), np.int64)
        self.pairs = np.zeros(0, np.int64)
        self.starts = np.zeros(0, np.int64)
        self.new: list[Aligned] = []
        self.chars = 0

    def of(self, texts: list[str]) -> list[np.ndarray]:
        """For each text the numbers of its units, in order. They hold until the next call."""
        if len(self.place) > self.most or self.chars > self.most_chars:
            self.clear()
        split = [_UNIT.findall(" " + t) for t in texts]
        place = self.place
        if new := [u for u in dict.fromkeys(chain.from_iterable(split)) if u not in place]:
            place.update(zip(new, range(len(place), len(place) + len(new)), strict=True))
            self.chars += sum(map(len, new))
            found = self.aligner.align(new)
            self.said += found.said
            self.right = np.concatenate([self.right, found.right])
            self.starts = np.concatenate([self.starts, len(self.pairs) + np.cumsum(found.sizes[:, 3]) - found.sizes[:, 3]])
            self.sizes = np.concatenate([self.sizes, found.sizes])
            self.pairs = np.concatenate([self.pairs, found.pairs])
        return [np.fromiter(map(place.__getitem__, units), np.int64, len(units)) for units in split]

    def links(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The distinct pairs of a text's links, and how many links each has."""
        n = self.sizes[own, 3]
        ends = np.cumsum(n)
        flat = self.pairs[np.repeat(self.starts[own] - (ends - n), n) + np.arange(ends[-1])]
        return np.unique(flat, return_counts=True)


TEXT_SCHEMA = "key binary, times long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, links array<int>"


def _align_texts(batches: Iterator[pa.RecordBatch], spec: str, model: bytes, **bounds: int) -> Iterator[pa.RecordBatch]:
    units = Units(_aligner(spec, model), **bounds)
    names = [x.split()[0] for x in TEXT_SCHEMA.split(", ")]
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            part = batch.slice(at, SLICE_ROWS)
            texts = part.column(0).to_pylist()
            sizes, digests, pairs, links = [], [], [], []
            for own in units.of(texts):
                if units.right[own].all():
                    sizes.append(units.sizes[own].sum(axis=0))
                    digests.append(hashlib.sha256("".join(map(units.said.__getitem__, own.tolist()))[:-1].encode()).hexdigest())
                    p, n = units.links(own)
                else:
                    sizes.append(np.zeros(len(_SIZES), np.int64))
                    digests.append("")
                    p = n = np.zeros(0, np.int64)
                pairs.append(p)
                links.append(n.astype(np.int32))
            keys = pa.array([hashlib.sha256(t.encode()).digest() for t in texts], pa.binary())
            lists = [pa.array(pairs, pa.list_(pa.int64())), pa.array(links, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([keys, part.column(1), *(pa.array(c) for c in np.array(sizes).T), pa.array(digests), *lists], names)


def _flat(part: pa.RecordBatch, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pairs, links, row) of the lists in columns ``at`` and ``at + 1``."""
    pairs, links = part.column(at), part.column(at + 1)
    sizes = np.diff(pairs.offsets.to_numpy())
    return pairs.flatten().to_numpy(), links.flatten().to_numpy(), np.repeat(np.arange(part.num_rows), sizes)


def _count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in batches:
        pairs, links, row = _flat(part, 1)
        pairs, own = np.unique(pairs, return_inverse=True)
        n = np.zeros(len(pairs), np.int64)
        np.add.at(n, own, links * part.column(0).to_numpy()[row])
        yield pa.RecordBatch.from_arrays([pa.array(pairs, pa.int64()), pa.array(n)], ["pair", "n"])


def _sum_counts(batches: Iterator[pa.RecordBatch], hot: tuple[np.ndarray, np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
    keys, counts, best = hot
    for part in batches:
        pairs, links, row = _flat(part, part.num_columns - 2)
        at = np.minimum(np.searchsorted(keys, pairs), max(len(keys) - 1, 0))
        known = keys[at] == pairs if len(keys) else np.zeros(len(pairs), bool)
        sums = np.zeros((2, part.num_rows), np.int64)
        np.add.at(sums[0], row[known], links[known] * best[at[known]])
        np.add.at(sums[1], row[known], links[known] * counts[at[known]])
        offsets = pa.array(np.r_[0, np.cumsum(np.bincount(row[~known], minlength=part.num_rows))], pa.int32())
        rest = [pa.ListArray.from_arrays(offsets, pa.array(x[~known])) for x in (pairs, links)]
        yield pa.RecordBatch.from_arrays([*part.columns[:-2], *map(pa.array, sums), *rest], [*part.schema.names[:-2], *MEASURES[4:], "pairs", "links"])


def aligned_texts(docs: DataFrame, spec_path: str, model_path: str, most_units: int = 300_000, most_chars: int = 8_000_000) -> DataFrame:
    """A row for each distinct text: key (its SHA-256), times (its rows), sizes, groups_sha256, and its pairs with their links."""
    with open(spec_path, encoding="utf-8") as f, open(model_path, "rb") as g:
        how = {"spec": f.read(), "model": g.read(), "most": most_units, "most_chars": most_chars}
    path = scratch_path(docs.sparkSession, "aligned-texts")
    texts = docs.filter("text <> ''").groupBy("text").agg(F.count("*").alias("times"))
    texts.mapInArrow(partial(_align_texts, **how), TEXT_SCHEMA).write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def pair_counts(texts: DataFrame) -> DataFrame:
    """(pair, n, best): for each linked pair of ids its links in the corpus, and whether no pair of its B id has more."""
    counts = texts.select("times", "pairs", "links").mapInArrow(_count_pairs, "pair long, n long")
    counts = cut(counts.groupBy("pair").agg(F.sum("n").alias("n")))
    b = F.col("pair").bitwiseAND(F.lit((1 << _PAIR_BITS) - 1))
    most = counts.groupBy(b.alias("b")).agg(F.max("n").alias("most"))  # a row for each id of B's vocabulary at most
    return counts.join(F.broadcast(most), b == F.col("b")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _hot(counts: DataFrame, hot_pairs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``hot_pairs`` most frequent pairs (ties: smallest pair), in order of the pairs."""
    rows = sorted((r.pair, r.n, r.best) for r in counts.orderBy(F.desc("n"), "pair").limit(hot_pairs).collect()) if hot_pairs else []
    pair, n, best = zip(*rows, strict=True) if rows else ((), (), ())
    return np.array(pair, np.int64), np.array(n, np.int64), np.array(best, bool)


def measures(docs: DataFrame, spec_path: str, model_path: str, hot_pairs: int = 1 << 17, **bounds: int) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for every row of ``docs`` (doc_id, text)."""
    texts = aligned_texts(docs, spec_path, model_path, **bounds)
    counts = cut(pair_counts(texts))
    hot = _hot(counts, hot_pairs)
    schema = TEXT_SCHEMA.replace("times long, ", "").replace("pairs", "n_best long, count_sum long, pairs")
    found = texts.drop("times").mapInArrow(partial(_sum_counts, hot=hot), schema)
    if counts.count() > len(hot[0]):  # links of the other pairs
        found = cut(found)
        cold = found.select("key", F.explode(F.arrays_zip("pairs", "links")).alias("c")).select("key", F.col("c.pairs").alias("pair"), F.col("c.links").cast("long").alias("links"))
        cold = cold.join(counts, "pair").groupBy("key")
        cold = cut(cold.agg(F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("more_best"), F.sum(F.col("links") * F.col("n")).alias("more_sum")))
        found = found.join(cold, "key", "left")
        found = found.withColumn("n_best", F.col("n_best") + F.coalesce("more_best", F.lit(0))).withColumn("count_sum", F.col("count_sum") + F.coalesce("more_sum", F.lit(0)))
    found = cut(found.select("key", *MEASURES, "groups_sha256"))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2("text", 256)).alias("key"))
    joined = own.join(found, "key", "left")
    return joined.select("doc_id", *(F.coalesce(m, F.lit(0)).cast("long").alias(m) for m in MEASURES), F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))
