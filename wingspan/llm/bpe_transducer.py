"""Byte-level BPE: encoding through a minimal acyclic transducer of frequent words, and decoding.

The words of all documents are counted. The most frequent ones (every word at least as frequent as the smallest power
of two that leaves no more than ``lexicon_words``, so a bounded number, chosen from whole counts) are compiled with
their ids into a minimal acyclic automaton: words share prefixes and suffixes, and numbers on the transitions add up to
the word's place in the table of ids. The compiled file goes to the shared folder and from there, with Spark's
``addFile``, to every executor, which maps it into memory; a new executor fetches it again. A word that the automaton
does not hold is merged exactly, by the ranks of the vocabulary. So results never depend on what is in the lexicon.

Cases: a null text counts as empty (no ids, and the digests of nothing). Texts of any length are encoded whole.
The strings of special tokens inside a text give those tokens, as in the library's default. doc_id is passed on,
null and repeated ones too, a row for each row. Other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wingspan.llm.common import SLICE_ROWS, cut
from wingspan.llm.word_ids import WordTable
from wingspan.session import scratch_path

# Characters that the patterns below know: ASCII, the letters from U+00C0 to U+00FF and some punctuation. A text with
# any other character is split by the library's own splitter.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_KNOWN = re.compile(rf"[\x00-\x7f{_LETTERS}–—‘’“”…€]*\Z")
_SPACE = r"\t\n\x0b\x0c\r "
_SPLIT = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[0-9]+| ?[^{_SPACE}{_LETTERS}0-9]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
)


def _byte_of_char() -> dict[str, int]:
    """The byte that each printable stand-in of a byte-level vocabulary means: itself if printable, else the next free from 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """A byte-level BPE vocabulary from the tokenizers library's JSON."""

    def __init__(self, spec: str) -> None:
        data = json.loads(spec)
        byte_of = _byte_of_char()
        as_bytes = lambda s: bytes(byte_of[c] for c in s)
        vocab = data["model"]["vocab"]
        added = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.special = added
        self.cut_at = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.bytes_of = {i: as_bytes(t) for t, i in vocab.items() if t not in added} | {i: t.encode() for t, i in added.items()}
        self.first = np.array([vocab[c] for c, _ in sorted(byte_of.items(), key=lambda x: x[1])]).tolist()
        pairs = [m.split(" ") if isinstance(m, str) else m for m in data["model"]["merges"]]
        self.merge_of = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.rank_of = {pair: rank for pair, (rank, _) in self.merge_of.items()}
        self.made_by = {rank: new for rank, new in self.merge_of.values()}
        self._spec, self._splitter = spec, None

    def split(self, text: str) -> list[str]:
        """The words that are merged on their own, in order. Special tokens stand as words of their own."""
        if self.cut_at is not None and self.cut_at.search(text):
            parts = self.cut_at.split(text)
            return [w for i, p in enumerate(parts) for w in ([p] if i % 2 else self._words(p))]
        return self._words(text)

    def _words(self, text: str) -> list[str]:
        if _KNOWN.match(text):
            return _SPLIT.findall(text)
        if self._splitter is None:
            from tokenizers import Tokenizer

            self._splitter = Tokenizer.from_str(self._spec).pre_tokenizer
        return [text[a:b] for _, (a, b) in self._splitter.pre_tokenize_str(text)]

    def merge(self, word: bytes) -> list[int]:
        """The ids of a word, by merging the pair of lowest rank, the leftmost of equal ones, until none is left."""
        ids = [self.first[b] for b in word]
        if len(ids) > 40:
            return self._merge_long(ids)
        get, made_by, none = self.rank_of.get, self.made_by, 1 << 60
        ranks = [get(p, none) for p in zip(ids, ids[1:], strict=False)]  # of each pair of neighbours
        while ranks and (low := min(ranks)) != none:
            at = ranks.index(low)
            ids[at : at + 2] = [made_by[low]]
            del ranks[at]
            if at:
                ranks[at - 1] = get((ids[at - 1], ids[at]), none)
            if at < len(ranks):
                ranks[at] = get((ids[at], ids[at + 1]), none)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap and links, for words of any length."""
        n, get = len(ids), self.merge_of.get
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        heap = [(m[0], i, m[1], ids[i], ids[i + 1]) for i in range(n - 1) if (m := get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, new, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = new, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if m := get((new, ids[k])):
                    heapq.heappush(heap, (m[0], i, m[1], new, ids[k]))
            if (h := before[i]) >= 0 and (m := get((ids[h], new))):
                heapq.heappush(heap, (m[0], h, m[1], ids[h], new))
        return [x for x in ids if x >= 0]

    def encode_word(self, word: str) -> list[int]:
        return [self.special[word]] if word in self.special else self.merge(word.encode())

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


class Lexicon:
    """A minimal acyclic automaton that maps words to ids, in flat arrays that can lie in a mapped file.

    keys: source state * 256 + byte of every transition, ascending; target: its state; skip: how many words of the
    source state come before those of this transition; final: whether a state ends a word. The skips on a word's path,
    plus one for each shorter word passed, are its number; ids[starts[number] : starts[number + 1]] are its ids.
    """

    FIELDS = (("keys", "<i8"), ("target", "<i4"), ("skip", "<i4"), ("final", "u1"), ("starts", "<i4"), ("ids", "<i4"))

    def __init__(self, **arrays: np.ndarray) -> None:
        self.__dict__ |= arrays

    @classmethod
    def compile(cls, entries: dict[bytes, list[int]]) -> Lexicon:
        words = sorted(entries)
        nodes: list[tuple[bool, tuple[tuple[int, int], ...]]] = []
        known: dict[tuple[bool, tuple[tuple[int, int], ...]], int] = {}

        def settle(final: bool, edges: list[tuple[int, int]]) -> int:
            """The state for this ending and these transitions; equal ones are shared, so suffixes are."""
            if (n := known.get(node := (final, tuple(edges)))) is None:
                n = known[node] = len(nodes)
                nodes.append(node)
            return n

        path: list[list] = [[False, []]]  # states on the path of the last word that may still grow: final, transitions
        last = b""

        def close(to: int) -> None:
            while len(path) - 1 > to:
                final, edges = path.pop()
                path[-1][1].append((last[len(path) - 1], settle(final, edges)))

        for w in words:
            same = next((i for i, (a, b) in enumerate(zip(last, w, strict=False)) if a != b), min(len(last), len(w)))
            close(same)
            path += [[False, []] for _ in w[same:]]
            path[-1][0] = True
            last = w
        close(0)
        root = settle(*path[0])
        held: list[int] = []  # words from each state on; a state is settled after those it leads to
        skips = []
        for final, edges in nodes:
            n = int(final)
            skips.append([])
            for _, to in edges:
                skips[-1].append(n)
                n += held[to]
            held.append(n)
        place = {root: 0} | {s: i + 1 for i, s in enumerate(x for x in range(len(nodes)) if x != root)}
        rows = sorted((place[s] * 256 + b, place[to], skip) for s, (_, edges) in enumerate(nodes) for (b, to), skip in zip(edges, skips[s], strict=True))
        final = np.zeros(len(nodes), "u1")
        for s, (f, _) in enumerate(nodes):
            final[place[s]] = f
        sizes = np.fromiter((len(entries[w]) for w in words), np.int64, len(words))
        columns = list(zip(*rows, strict=True)) or [(), (), ()]
        return cls(
            keys=np.array(columns[0], "<i8"), target=np.array(columns[1], "<i4"), skip=np.array(columns[2], "<i4"), final=final,
            starts=np.r_[0, np.cumsum(sizes)].astype("<i4"), ids=np.array([i for w in words for i in entries[w]], "<i4"),
        )

    def to_bytes(self) -> bytes:
        parts = [np.ascontiguousarray(getattr(self, n), t).tobytes() for n, t in self.FIELDS]
        sizes = np.array([len(p) for p in parts], "<i8").tobytes()
        return sizes + b"".join(p + b"\0" * (-len(p) % 8) for p in parts)

    @classmethod
    def mapped(cls, path: str) -> Lexicon:
        """The automaton in a file, mapped into memory and shared by the processes of a machine."""
        data = np.memmap(path, np.uint8, mode="r")
        at, arrays = 8 * len(cls.FIELDS), {}
        for (name, kind), size in zip(cls.FIELDS, data[:at].view("<i8").tolist(), strict=True):
            arrays[name] = data[at : at + size].view(kind)
            at += size + -size % 8
        return cls(**arrays)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """The number of each word, -1 for one that is not held. All words walk together, a byte a step."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        text = np.frombuffer(b"".join(words) + b"\0", np.uint8)
        begin = np.cumsum(sizes) - sizes
        state, number = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        out, live, step = np.full(len(words), -1, np.int64), np.arange(len(words)), 0
        while len(live):
            done = live[(sizes[live] == step) & (self.final[state[live]] == 1)]
            out[done] = number[done]
            live = live[sizes[live] > step]
            if not len(live) or not len(self.keys):
                break
            key = state[live] * 256 + text[begin[live] + step]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[at] == key
            live, at = live[ok], at[ok]
            number[live] += self.skip[at] + 0
            state[live] = self.target[at]
            step += 1
        return out


def _count_words(batches: Iterator[pa.RecordBatch], spec: str, held: int) -> Iterator[pa.RecordBatch]:
    vocabulary, counts = _vocabulary(spec), Counter()
    flush = lambda: pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            for text in batch.column(0).slice(at, SLICE_ROWS).to_pylist():
                if text:
                    counts.update(vocabulary.split(text))
            if len(counts) > held:
                yield flush()
                counts.clear()
    yield flush()


@lru_cache(maxsize=2)
def _vocabulary(spec: str) -> Vocabulary:
    return Vocabulary(spec)


def word_counts(docs: DataFrame, spec: str, held: int = 200_000) -> DataFrame:
    """(word, n) over all texts."""
    parts = docs.select("text").mapInArrow(partial(_count_words, spec=spec, held=held), "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(docs: DataFrame, spec: str, lexicon_words: int) -> list[str]:
    """Words at least as frequent as the smallest power of two that leaves at most ``lexicon_words`` of them."""
    counts = cut(word_counts(docs, spec))
    by_power = counts.groupBy(F.floor(F.log2("n")).cast("int").alias("power")).agg(F.count("*").alias("words"))
    left, power = lexicon_words, 64
    for p, n in sorted(((r.power, r.words) for r in by_power.collect()), reverse=True):
        if n > left:
            break
        left, power = left - n, p
    return [r.word for r in counts.filter(F.floor(F.log2("n")) >= power).select("word").collect()]


def compile_lexicon(docs: DataFrame, spec: str, lexicon_words: int) -> Lexicon:
    vocabulary = _vocabulary(spec)
    return Lexicon.compile({w.encode(): vocabulary.encode_word(w) for w in frequent_words(docs, spec, lexicon_words)})


def share(spark: SparkSession, lexicon: Lexicon) -> str:
    """Put the compiled automaton into the shared folder and hand it to all executors; returns the file's name."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_path(spark, "lexicon") + ".bin")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    out = files.create(path)
    out.write(lexicon.to_bytes())
    out.close()
    spark.sparkContext.addFile(files.makeQualified(path).toString())
    return path.getName()


@lru_cache(maxsize=2)
def _words_of(spec: str, file: str) -> tuple[Vocabulary, WordTable]:
    vocabulary, lexicon = _vocabulary(spec), Lexicon.mapped(SparkFiles.get(file))

    def encode(words: list[str]) -> Iterator:
        for w, n in zip(words, lexicon.numbers([w.encode() for w in words]).tolist(), strict=True):
            yield vocabulary.encode_word(w) if n < 0 else lexicon.ids[lexicon.starts[n] : lexicon.starts[n + 1]].tolist()

    return vocabulary, WordTable(encode, strings=True)


def _encoded(batches: Iterator[pa.RecordBatch], spec: str, file: str, digests: bool) -> Iterator[pa.RecordBatch]:
    vocabulary, table = _words_of(spec, file)
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            part = batch.slice(at, SLICE_ROWS)
            rows = table.rows([vocabulary.split(t or "") for t in part.column(1).to_pylist()])
            ids = [table.ids(r) for r in rows]
            if not digests:
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])
                continue
            joined = table.joined
            sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array(map(len, ids), pa.int64()),
                    pa.array([sha(",".join(map(joined.__getitem__, r.tolist()))) for r in rows]),
                    pa.array([sha(vocabulary.decode(x.tolist())) for x in ids]),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )


def _prepared(docs: DataFrame, spec_path: str, lexicon_words: int) -> tuple[DataFrame, dict]:
    with open(spec_path, encoding="utf-8") as f:
        spec = f.read()
    lexicon = compile_lexicon(docs, spec, lexicon_words)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), {"spec": spec, "file": share(docs.sparkSession, lexicon)}


def encode(docs: DataFrame, spec_path: str, lexicon_words: int = 65_536) -> DataFrame:
    """(doc_id, ids) for every row of ``docs`` (columns doc_id, text)."""
    rows, how = _prepared(docs, spec_path, lexicon_words)
    return rows.mapInArrow(partial(_encoded, digests=False, **how), "doc_id long, ids array<int>")


def digests(docs: DataFrame, spec_path: str, lexicon_words: int = 65_536) -> DataFrame:
    """Per row: doc_id, n_tokens, and the SHA-256 of its ids and of the text decoded from them."""
    rows, how = _prepared(docs, spec_path, lexicon_words)
    return rows.mapInArrow(
        partial(_encoded, digests=True, **how), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )


def _decoded(batches: Iterator[pa.RecordBatch], spec: str) -> Iterator[pa.RecordBatch]:
    vocabulary = _vocabulary(spec)
    for batch in batches:
        texts = [None if x is None else vocabulary.decode(x) for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])


def decode(encoded: DataFrame, spec_path: str) -> DataFrame:
    """(doc_id, text) for rows (doc_id, ids); null ids give a null text."""
    with open(spec_path, encoding="utf-8") as f:
        spec = f.read()
    return encoded.select("doc_id", "ids").mapInArrow(partial(_decoded, spec=spec), "doc_id long, text string")
