"""Token ids of texts by way of their words: each distinct word is encoded once, texts are gathered from flat arrays."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np


class _Rows(dict):
    """Row numbers of words; an unknown word gets the next number and is noted in ``new``."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list = []

    def __missing__(self, word):  # noqa: ANN001, ANN204
        self[word] = n = len(self)
        self.new.append(word)
        return n


class WordTable:
    """Ids of the words met so far. ``encode`` gives the ids of each of some words; at most about ``limit`` are held."""

    def __init__(self, encode: Callable[[list], Iterable], limit: int = 600_000, strings: bool = False) -> None:
        self.encode, self.limit, self.strings = encode, limit, strings
        self._clear()

    def _clear(self) -> None:
        self.row = _Rows()
        self.start = np.zeros(1024, np.int64)
        self.count = np.zeros(1024, np.int64)
        self.flat = np.zeros(4096, np.int32)
        self.used = 0
        self.joined: list[str] = []

    def rows(self, texts: list[list]) -> list[np.ndarray]:
        """For each text, given as its words, the words' rows. Rows hold until the next call."""
        if len(self.row) > self.limit:
            self._clear()
        known = len(self.row)
        get = self.row.__getitem__
        out = [np.fromiter(map(get, words), np.int64, len(words)) for words in texts]
        if new := self.row.new:
            self._learn(known, new)
            self.row.new = []
        return out

    def _learn(self, at: int, words: list) -> None:
        ids = list(self.encode(words))
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        total = int(sizes.sum())
        while len(self.start) < at + len(ids):
            self.start, self.count = np.r_[self.start, np.zeros_like(self.start)], np.r_[self.count, np.zeros_like(self.count)]
        while len(self.flat) < self.used + total:
            self.flat = np.r_[self.flat, np.zeros_like(self.flat)]
        self.count[at : at + len(ids)] = sizes
        self.start[at : at + len(ids)] = self.used + np.cumsum(sizes) - sizes
        self.flat[self.used : self.used + total] = np.fromiter((i for x in ids for i in x), np.int32, total)
        self.used += total
        if self.strings:
            self.joined += [",".join(map(str, x)) for x in ids]

    def ids(self, rows: np.ndarray) -> np.ndarray:
        """The ids of the words at these rows, one after the other."""
        n = self.count[rows]
        ends = np.cumsum(n)
        if not len(n) or not ends[-1]:
            return np.zeros(0, np.int32)
        return self.flat[np.repeat(self.start[rows] - (ends - n), n) + np.arange(ends[-1])]
