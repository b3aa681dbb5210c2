"""SimHash near-duplicates, found with BK-trees over shards of fingerprints.

A fingerprint has 64 bits: bit i is set if it is set in more than half of the XXH64 values of the text's word
shingles. Two fingerprints at ``max_bits`` or fewer differing bits are linked.

Search. The 64 bits are cut into ``bands`` runs. Fingerprints that differ in at most ``max_bits`` bits agree on at
least ``bands - max_bits`` whole runs, so every choice of that many runs names a shard: all fingerprints with the
same bits there. A shard holds a BK-tree: the children of a node are keyed by their integer Hamming distance to it,
and a search for radius r around q follows from a node at distance d only the edges d - r .. d + r. A driver
broadcast of the trees would need all fingerprints on the driver, so each shard's tree is sent by a shuffle to the
tasks that hold the queries of that shard, and to no others. A shard over ``shard_rows`` fingerprints (a cluster of
near copies) is cut into chunks by hash; every chunk's tree meets the queries of every chunk in a task of its own, so
no task holds more than about two chunks and no pair is lost. A task returns the links that hold its linked
fingerprints together (a forest), not all pairs.

Cases: null and empty texts have no shingle and fingerprint zero, linked like any other. A null doc_id is kept; it
counts for a component's smallest id only if no other id is there (then the id is null). Repeated rows give repeated
result rows. Other columns of the input are not read, so their names can't clash. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wingspan.llm.common import components, cut, sorted_groups, texts

SEED = 42
#: Shingle hashes whose bits are spread out at a time.
BLOCK = 1 << 15
#: Groups up to this size are searched point by point, larger ones with all queries at once.
FEW = 48


def fingerprint(text: bytes | None, words_per_shingle: int) -> int:
    """The fingerprint of a text in UTF-8, as an unsigned number."""
    words = (text or b"").lower().split()  # bytes: lowers A-Z only, splits at space and \x09-\x0D
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    if (n := len(words) - words_per_shingle + 1) < 1:
        spans = [(0, len(joined))]
    else:
        spans = list(zip(starts[:n].tolist(), ends[words_per_shingle - 1 :].tolist(), strict=True))
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(spans), BLOCK):
        h = np.array([digest(joined[a:b], SEED) for a, b in spans[at : at + BLOCK]], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(spans), bitorder="little")
    return int(bits.view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch], words_per_shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = np.fromiter((fingerprint(t, words_per_shingle) for t in texts(batch)), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])


def _keyed_fingerprints(batches: Iterator[pa.RecordBatch], words_per_shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = np.fromiter((fingerprint(t, words_per_shingle) for t in texts(batch)), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64)), batch.column(2)], ["doc_id", "fp", "text_hash"])


def fingerprints(docs: DataFrame, words_per_shingle: int = 4) -> DataFrame:
    """(doc_id, fp) for every row; fp is the fingerprint as a signed long."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(
        partial(_fingerprints, words_per_shingle=words_per_shingle), "doc_id long, fp long"
    )


class BKTree:
    """Children keyed by integer Hamming distance to the parent."""

    def __init__(self) -> None:
        self.value: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, x: int) -> None:
        if self.value:
            at = 0
            while (d := (self.value[at] ^ x).bit_count()) in self.children[at]:
                at = self.children[at][d]
            self.children[at][d] = len(self.value)
        self.value.append(x)
        self.children.append({})

    def near(self, x: int, radius: int) -> list[int]:
        """Nodes at ``radius`` or less."""
        found, todo = [], [0] if self.value else []
        while todo:
            at = todo.pop()
            if (d := (self.value[at] ^ x).bit_count()) <= radius:
                found.append(at)
            if edges := self.children[at]:
                todo += [edges[e] for e in range(d - radius, d + radius + 1) if e in edges]
        return found

    def near_all(self, x: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
        """The same walk for all queries at once: (node, positions in x that lie at ``radius`` or less)."""
        todo = [(0, np.arange(len(x)))] if self.value else []
        while todo:
            at, who = todo.pop()
            d = np.bitwise_count(x[who] ^ np.uint64(self.value[at])).astype(np.int16)
            if len(hit := who[d <= radius]):
                yield at, hit
            for e, child in self.children[at].items():
                if len(some := who[np.abs(d - e) <= radius]):
                    todo.append((child, some))


def _forest(values: np.ndarray, in_tree: np.ndarray, radius: int) -> tuple[list[int], list[int]]:
    """Links that join what the shard's tree finds: every linked fingerprint to the first one of its group."""
    order = np.argsort(~in_tree, kind="stable")
    values, n_tree, tree = values[order], int(in_tree.sum()), BKTree()
    label = list(range(len(values)))
    if len(values) <= FEW:

        def top(i: int) -> int:
            while label[i] != i:
                label[i] = i = label[label[i]]
            return i

        for i, x in enumerate(values.tolist()):
            for j in tree.near(x, radius):
                a, b = top(i), top(j)
                label[max(a, b)] = min(a, b)
            if i < n_tree:
                tree.add(x)
        ends = [top(i) for i in range(len(values))]
    else:
        for x in values[:n_tree].tolist():
            tree.add(x)
        ends = np.arange(len(values))
        for at, hit in tree.near_all(values, radius):
            old = np.unique(ends[hit])
            old = np.union1d(old, ends[at])
            if len(old) > 1:
                ends[np.isin(ends, old)] = old[0]
        ends = ends.tolist()
    plain = values.view(np.int64).tolist()
    pairs = [(plain[i], plain[e]) for i, e in enumerate(ends) if i != e]
    return [a for a, _ in pairs], [b for _, b in pairs]


def _search(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    a: list[int] = []
    b: list[int] = []
    flush = lambda: pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
    for g in sorted_groups(batches, ["combo", "bits", "i", "j"], least=2):
        own = (g["chunk"] == g["i"]) if g["i"][0] != g["j"][0] else np.ones(len(g["fp"]), bool)
        x, y = _forest(g["fp"].view(np.uint64), own, radius)
        a += x
        b += y
        if len(a) > 100_000:
            yield flush()
            a, b = [], []
    yield flush()


def _masks(bands: int, agree: int) -> list[int]:
    edges = [round(i * 64 / bands) for i in range(bands + 1)]
    runs = [((1 << (q - p)) - 1) << p for p, q in zip(edges, edges[1:], strict=False)]
    return [sum(c) - (1 << 64 if sum(c) >= 1 << 63 else 0) for c in combinations(runs, agree)]


def links(distinct: DataFrame, max_bits: int = 4, bands: int = 6, shard_rows: int = 2048) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) whose components are those of all links."""
    if bands <= max_bits:
        raise ValueError("bands must exceed max_bits, else two near fingerprints may share no whole run of bits")
    masks = _masks(bands, bands - max_bits)
    members = distinct.select(
        "fp",
        F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m).cast("long")) for m in masks])).alias("combo", "bits"),
    )
    large = (
        members.groupBy("combo", "bits").agg(F.count("*").alias("n")).filter(F.col("n") > shard_rows)
        .select("combo", "bits", F.ceil(F.col("n") / shard_rows).cast("int").alias("chunks"))
    )
    placed = members.join(large, ["combo", "bits"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    placed = placed.withColumn("chunk", F.expr("cast(pmod(xxhash64(fp), chunks) as int)"))
    placed = placed.withColumn("other", F.explode(F.expr("sequence(0, chunks - 1)")))
    placed = placed.select("combo", "bits", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "fp")
    keys = ["combo", "bits", "i", "j"]
    return placed.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(partial(_search, radius=max_bits), "a long, b long")


def near_duplicates(
    docs: DataFrame, words_per_shingle: int = 4, max_bits: int = 4, bands: int = 6, shard_rows: int = 2048
) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs`` (columns doc_id, text).

    component_id is the smallest doc_id that links lead to, the row's own included.
    """
    prints = cut(fingerprints(docs, words_per_shingle))
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("low")))
    member_of = components(links(distinct.select("fp"), max_bits, bands, shard_rows))
    tied = distinct.join(member_of, distinct["fp"] == member_of["node"]).select("fp", "low", "root")
    lows = tied.groupBy("root").agg(F.min("low").alias("component_id"))
    small = tied.join(lows, "root").select("fp", "component_id")
    # written out, so that the last join stands right on two shuffles and Spark can split a fingerprint of many rows
    of_print = cut(distinct.join(small, "fp", "left").select("fp", F.coalesce("component_id", "low").alias("component_id")))
    return prints.join(of_print, "fp").select("doc_id", "fp", "component_id")


def hex_of(column: str) -> Column:
    return F.lpad(F.lower(F.hex(column)), 16, "0")


def one_of_each_group(
    docs: DataFrame, words_per_shingle: int = 4, max_bits: int = 4, bands: int = 6, shard_rows: int = 2048
) -> DataFrame:
    """The rows of ``docs``, all their columns kept, that stand for their group of near copies.

    A group keeps the row with its smallest doc_id; rows that share this id are told apart by a hash of their text,
    and rows that repeat id and text are repeats of one document: one of them stays. If no row of a group has an id,
    the smallest hash stays.
    """
    held = docs.withColumn("__text_hash", F.xxhash64("text"))
    prints = cut(
        held.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), "__text_hash")
        .mapInArrow(partial(_keyed_fingerprints, words_per_shingle=words_per_shingle), "doc_id long, fp long, text_hash long")
    )
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash"))
    distinct = cut(prints.groupBy("fp").agg(first.alias("low")))
    member_of = components(links(distinct.select("fp"), max_bits, bands, shard_rows))
    root = F.coalesce("root", "fp")
    rooted = distinct.join(member_of, distinct["fp"] == member_of["node"], "left").select(root.alias("root"), "low")
    keep = rooted.groupBy("root").agg(F.min("low").alias("low")).select("low.doc_id", "low.text_hash")
    keep = keep.select(F.col("doc_id").alias("__keep_id"), F.col("text_hash").alias("__keep_hash"))
    same = F.col("__keep_id").eqNullSafe(F.col("doc_id").cast("long")) & (F.col("__keep_hash") == F.col("__text_hash"))
    kept = held.join(keep, same, "left_semi")
    return kept.dropDuplicates(["doc_id", "__text_hash"]).drop("__text_hash")
