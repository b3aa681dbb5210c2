"""Hierarchical multi-length packing of tokenised documents.

Context sizes are the tiers, powers of two (2048, 1024, 512, 256). Whole windows of the largest size are cut off a long
document; what is left of it, and every shorter document, goes to the smallest tier that holds it. A tier's windows are
opened by its longest pieces; the gap of a window is filled from the shorter ones, the longest that fits first, and what
still gapes is filled by cutting the next shorter piece, so each window is full. A cut piece's rest goes back to the tier
that holds it. The full windows of a tier are dealt to step groups of about ``step_tokens`` tokens, dearest first, back
and forth, so that the groups of a tier have as many windows (give or take one) and a like attention cost.

Every task packs the rows of its input split as they come, with at most about ``pool_tokens`` tokens waiting; nothing is
shuffled, and a task that runs again gives the same rows. At its end, what doesn't fill a window is cut at powers of two,
so no window is padded.

Ids come from the tokenizers library: it encodes each distinct word once, and texts whose words can't be told apart
safely (rare characters, special tokens) as a whole.

Cases: a null or empty text is the closing id alone. A null doc_id is passed on; rows that share a doc_id, and repeated
rows, are packed one by one. Other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wingspan.llm.common import SLICE_ROWS
from wingspan.llm.word_ids import WordTable

TIERS = (2048, 1024, 512, 256)
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
# Texts of these characters are the same after NFC, and each is split in the same way with or without its neighbours.
_KNOWN = re.compile(rf"[\x00-\x7f{_LETTERS}–—‘’“”…€]*\Z")
_SPACE = r"\t\n\x0b\x0c\r "
_SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^{_SPACE}{_LETTERS}0-9]+")
SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "tier long, step_group long"
)


class Encoder:
    """Texts to ids by the tokenizers library's file, a word at a time where that is safe."""

    def __init__(self, spec: str, close_id: int) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.close = np.array([close_id], np.int32)
        self.table = WordTable(self._words)

    def _words(self, words: list[str]) -> Iterator[list[int]]:
        for at in range(0, len(words), 4096):
            for e in self.tokenizer.encode_batch_fast(words[at : at + 4096], add_special_tokens=False):
                yield e.ids

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        plain = [t is None or ("<|" not in t and _KNOWN.match(t) is not None) for t in texts]
        rows = self.table.rows([_SPLIT.findall(t.lower()) if t and p else [] for t, p in zip(texts, plain, strict=True)])
        out = []
        for t, p, r in zip(texts, plain, rows, strict=True):
            ids = self.table.ids(r) if p else np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.int32)
            out.append(np.concatenate([ids, self.close]))
        return out


@lru_cache(maxsize=2)
def _encoder(spec: str, close_id: int) -> Encoder:
    return Encoder(spec, close_id)


class Packer:
    """Packs pieces (document, start, ids) into full windows; see the module's docstring."""

    def __init__(self, tiers: tuple[int, ...] = TIERS, step_tokens: int = 131_072, first_id: int = 0) -> None:
        if any(t & (t - 1) for t in tiers) or list(tiers) != sorted(set(tiers), reverse=True):
            raise ValueError("tiers are powers of two, largest first")
        self.tiers, self.step_tokens = tiers, step_tokens
        self.next_window = self.next_group = first_id
        self.pool: list[tuple[int, int, tuple, int, np.ndarray]] = []  # length, tie-break, document, start, ids; ascending
        self.tokens = self.met = 0
        self.full: dict[int, list[list[tuple[tuple, int, np.ndarray]]]] = {}

    def add(self, doc: tuple, ids: np.ndarray) -> None:
        top, start = self.tiers[0], 0
        while len(ids) - start >= top:
            self._window(top, [(doc, start, ids[start : start + top])])
            start += top
        if start < len(ids):
            self._put(doc, start, ids[start:].copy() if start else ids, insort)

    def _put(self, doc: tuple, start: int, ids: np.ndarray, how) -> None:  # noqa: ANN001
        self.met += 1
        how(self.pool, (len(ids), self.met, doc, start, ids))
        self.tokens += len(ids)

    def _take(self, at: int) -> tuple[tuple, int, np.ndarray]:
        size, _, doc, start, ids = self.pool.pop(at)
        self.tokens -= size
        return doc, start, ids

    def _window(self, size: int, pieces: list) -> None:
        self.full.setdefault(size, []).append(pieces)

    def pack(self) -> None:
        """Fill windows, longest pieces first, until what waits can't fill the next one."""
        while self.pool:
            size = next(t for t in reversed(self.tiers) if t >= self.pool[-1][0])
            if self.tokens < size:
                return
            pieces = [self._take(-1)]
            gap = size - len(pieces[0][2])
            while gap and self.pool[0][0] <= gap:
                pieces.append(self._take(bisect_right(self.pool, gap, key=lambda x: x[0]) - 1))
                gap -= len(pieces[-1][2])
            if gap:  # every piece is longer: cut the shortest
                doc, start, ids = self._take(0)
                pieces.append((doc, start, ids[:gap]))
                self._put(doc, start + gap, ids[gap:], insort)
            self._window(size, pieces)

    def finish(self) -> None:
        """The rest, cut at powers of two."""
        self.pack()
        while self.pool:
            size = gap = 1 << (min(self.tokens, self.tiers[0]).bit_length() - 1)
            pieces = []
            while gap:
                doc, start, ids = self._take(-1)
                pieces.append((doc, start, ids[:gap]))
                if len(ids) > gap:
                    self._put(doc, start + gap, ids[gap:], insort)
                gap -= len(pieces[-1][2])
            self._window(size, pieces)

    def rows(self) -> Iterator[tuple]:
        """The pieces of the full windows, a row each, with their windows dealt to step groups."""
        for size, windows in sorted(self.full.items(), reverse=True):
            groups = max(1, len(windows) * size // self.step_tokens)
            cost = [-sum(len(p[2]) ** 2 for p in w) for w in windows]
            for place, w in enumerate(sorted(range(len(windows)), key=cost.__getitem__)):
                lap, at = divmod(place, groups)
                group = self.next_group + (groups - 1 - at if lap % 2 else at)
                offset = 0
                for (doc_id, n), start, ids in windows[w]:
                    yield doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), n, self.next_window, offset, size, group
                    offset += len(ids)
                self.next_window += 1
            self.next_group += groups
        self.full = {}


def _pack(batches: Iterator[pa.RecordBatch], spec: str, close_id: int, tiers: tuple[int, ...], step_tokens: int, pool_tokens: int) -> Iterator[pa.RecordBatch]:
    encoder = _encoder(spec, close_id)
    packer = Packer(tiers, step_tokens, TaskContext.get().partitionId() << 36)
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def out() -> Iterator[pa.RecordBatch]:
        if rows := list(packer.rows()):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)

    met = 0
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            part = batch.slice(at, SLICE_ROWS)
            for doc_id, ids in zip(part.column(0).to_pylist(), encoder.encode(part.column(1).to_pylist()), strict=True):
                packer.add((doc_id, len(ids)), ids)
                met += len(ids)
            if met >= pool_tokens:
                packer.pack()
                yield from out()
                met = 0
    packer.finish()
    yield from out()


def pack(
    docs: DataFrame, spec_path: str, close_id: int = 1, tiers: tuple[int, ...] = TIERS, step_tokens: int = 131_072, pool_tokens: int = 1 << 20
) -> DataFrame:
    """A row for each piece of each row of ``docs`` (columns doc_id, text).

    doc_id; start: ids of its document before it; length; ids_crc32 of its ids as little-endian unsigned 32-bit numbers;
    doc_tokens, closing id included; sequence_id; offset in that sequence; tier, the window's size; step_group.
    """
    with open(spec_path, encoding="utf-8") as f:
        spec = f.read()
    how = partial(_pack, spec=spec, close_id=close_id, tiers=tiers, step_tokens=step_tokens, pool_tokens=pool_tokens)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(how, SCHEMA)
