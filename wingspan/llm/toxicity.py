"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

A text's features are densities of a learned lexicon (by rank of its words and by their weight), how near its hits stand to
words of the second person, and rates of capitals, punctuation, symbols and obfuscated spellings (digits or signs for
letters, stretched or spaced letters), each of which is also looked up in the lexicon once undone.

Everything learned comes from a bounded sample: about ``sample_rows`` labelled documents, as many of either label as there
are up to half of that, chosen by a hash of doc_id; of near copies (documents with the same smallest hash of three neighbouring words) one counts.
Words and their beginnings of 4 to 7 letters ("abcd*", so that all forms of a stem count together) are in the lexicon if they
stand in ``least_docs`` toxic documents and their log-odds are at least ``least_odds`` and ``least_z`` standard errors above
0; the ``lexicon_words`` best are kept, but for those that a better beginning of theirs covers. The sample is dealt to ``folds``: a document's features, when trees are
trained, come from a lexicon learned on the other folds, and calibration uses margins of trees that have not seen its fold.
The final lexicon and trees are learned on all of the sample. Scores are isotonic in the trees' margin.

Every document is scored where it lies, whole, in one pass; the model, of a bounded size, goes with the tasks.

Cases: a null or empty text is scored like any other, by the features of an empty text. Several labels of one doc_id: the
largest counts. Null labels and null doc_ids teach nothing; a null doc_id is scored, and is held out or not as the empty
text is. Repeated rows are scored each. With no labelled row, or one label only, every score is the share of toxic rows (0
without rows). Columns beside doc_id, text and the labels' doc_id and toxic are not read. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wingspan.llm.common import SLICE_ROWS

# Words of the second person in English, German, French and Spanish, and letters that signs stand for.
SECOND_PERSON = frozenset(
    "you your yours yourself yourselves u ur du dich dir dein deine deinen deinem deiner euch euer eure ihr "
    "tu te toi ton ta tes vous votre vos ti tus tuyo usted ustedes vosotros".split()
)
LETTER_OF = str.maketrans("0134578@$!|+", "oieastbasilt")

_WORD = re.compile(r"[^\W\d_]+")
_CAPS = re.compile(r"\b[A-Z]{3,}\b")
_RUNS = re.compile(r"[!?]{2,}")
_SIGNED = re.compile(r"\b[^\W\d_]+(?:[0-9@$!|+*]+[^\W\d_]+)+")
_STRETCHED = re.compile(r"\b\w*([^\W\d_])\1\1\w*")
_SPACED = re.compile(r"\b[^\W\d_](?:[ .\-][^\W\d_]){3,}\b")
#: Words on either side of a hit in which the second person counts as near.
NEAR = 5
#: Lengths of the beginnings that a lexicon may hold.
STEMS = range(4, 8)
#: Ranks at which the lexicon's tiers end.
TIERS = (16, 64, 1 << 30)
FEATURES = (
    "log_words", "tier_1", "tier_2", "tier_3", "log_hits", "weight_density", "largest_weight", "hidden_hits", "second_person",
    "near_second_person", "capitals", "capital_words", "punctuation", "mark_runs", "symbols", "digits", "signed", "stretched",
)
_BYTES = np.zeros((256, 4))
_BYTES[65:91, 0] = 1  # A-Z
_BYTES[list(b".,;:!?'\"()-"), 1] = 1
_BYTES[list(b"#*$%&|<>@~^=+/\\_"), 2] = 1
_BYTES[48:58, 3] = 1


def entries(word: str) -> list[str]:
    """A word and the beginnings under which a lexicon may hold it."""
    return [word, *(word[:k] + "*" for k in STEMS if k < len(word))]


class Lexicon(dict):
    """Words and beginnings with their weights, best first; looking a word up gives (weight, tier) of its best entry, or None."""

    MOST = 500_000  # looked-up words that are remembered

    def __init__(self, weight: dict[str, float]) -> None:
        super().__init__()
        self.weight = weight
        self.tier = {w: next(t for t, end in enumerate(TIERS) if i < end) for i, w in enumerate(weight)}

    def __missing__(self, word: str) -> tuple[float, int] | None:
        if len(self) > self.MOST:
            self.clear()
        held = [e for e in entries(word) if e in self.weight]
        best = min(held, key=self.tier.__getitem__, default=None)
        self[word] = found = None if best is None else (max(map(self.weight.__getitem__, held)), self.tier[best])
        return found

    def __reduce__(self):  # noqa: ANN204  without what is remembered
        return Lexicon, (self.weight,)


def revealed(spelled: str) -> set[str]:
    """The words that an obfuscated spelling may stand for."""
    plain = re.sub(r"[\W\d_]", "", spelled.lower().translate(LETTER_OF))
    return {plain, re.sub(r"(.)\1+", r"\1", plain), re.sub(r"(.)\1+", r"\1\1", plain)}


def features(text: str | None, lexicon: Lexicon) -> list[float]:
    text = text or ""
    raw = text.encode()
    capitals, marks, symbols, digits = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _BYTES
    words = _WORD.findall(text.lower())
    n, size = max(len(words), 1), max(len(raw), 1)
    found = list(map(lexicon.__getitem__, words))
    hits = [i for i, x in enumerate(found) if x is not None]
    tiers, weights = [0, 0, 0], [found[i][0] for i in hits]
    for i in hits:
        tiers[found[i][1]] += 1
    second = sum(map(SECOND_PERSON.__contains__, words))
    near = sum(not SECOND_PERSON.isdisjoint(words[max(0, i - NEAR) : i + NEAR + 1]) for i in hits) if second else 0
    signed = [m[0] for m in _SIGNED.finditer(text)] if digits or symbols or b"!" in raw else []
    stretched = [m[0] for m in _STRETCHED.finditer(text)] + [m[0] for m in _SPACED.finditer(text)]
    hidden = sum(any(lexicon[w] is not None for w in revealed(x)) for x in signed + stretched)
    return [
        np.log1p(len(words)), *(t / n for t in tiers), np.log1p(len(hits) + hidden), sum(weights) / n, max(weights, default=0.0), hidden / n,
        second / n, near / n, capitals / size, len(_CAPS.findall(text)) / n, marks / size, len(_RUNS.findall(text)) / n, symbols / size,
        digits / size, len(signed) / n, len(stretched) / n,
    ]


@dataclass
class Trees:
    """Full binary trees of one depth: at a node, larger values than ``cut`` of ``feature`` go right."""

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        depth = (self.leaf.shape[1] - 1).bit_length() if self.leaf.size else 0
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += leaf[node - len(feature)]
        return out


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 32, l2: float = 1.0, least_weight: float = 1.0) -> Trees:
    """Gradient boosting of the logistic loss with second-order gains on quantile bins."""
    share = min(max(y.mean(), 1e-6), 1 - 1e-6)
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for f in range(width)]
    edges = [np.unique(np.r_[e, x[:, f].min()]) for f, e in enumerate(edges)]
    binned = np.column_stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)])
    slots = bins + 2
    flat = binned + np.arange(width) * slots
    margin = np.full(n, np.log(share / (1 - share)))
    inner = (1 << depth) - 1
    trees = Trees(np.zeros((rounds, inner), np.int64), np.full((rounds, inner), np.inf), np.zeros((rounds, inner + 1)), float(margin[0]))
    score = lambda g, h: g * g / (h + l2)
    for t in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, many = (1 << level) - 1, 1 << level
            place = ((node - first)[:, None] * (width * slots) + flat).ravel()
            sums = [np.bincount(place, np.repeat(v, width), many * width * slots).reshape(many, width, slots).cumsum(axis=2) for v in (g, h)]
            left_g, left_h = sums[0][:, :, :-1], sums[1][:, :, :-1]
            all_g, all_h = sums[0][:, :, -1:], sums[1][:, :, -1:]
            gain = score(left_g, left_h) + score(all_g - left_g, all_h - left_h) - score(all_g, all_h)
            gain[(left_h < least_weight) | (all_h - left_h < least_weight)] = -np.inf
            for k in range(many):
                f, b = np.unravel_index(int(np.argmax(gain[k])), gain[k].shape)
                if gain[k, f, b] > 1e-9 and b < len(edges[f]):
                    trees.feature[t, first + k], trees.cut[t, first + k] = f, edges[f][b]
            node = 2 * node + 1 + (x[np.arange(n), trees.feature[t, node]] > trees.cut[t, node])
        own = node - inner
        trees.leaf[t] = rate * np.bincount(own, g, inner + 1) / (np.bincount(own, h, inner + 1) + l2)
        margin += trees.leaf[t, own]
    return trees


def isotonic(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: (margins, scores) of the blocks' ends, to be joined by straight lines."""
    at, own = np.unique(margin, return_inverse=True)
    blocks: list[list[float]] = []  # first margin, last margin, weight of rows and of toxic rows
    for m, rows, toxic in zip(at.tolist(), np.bincount(own, weight).tolist(), np.bincount(own, y * weight).tolist(), strict=True):
        blocks.append([m, m, rows, toxic])
        while len(blocks) > 1 and blocks[-2][3] * blocks[-1][2] >= blocks[-1][3] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [blocks[-1][0], last[1], blocks[-1][2] + last[2], blocks[-1][3] + last[3]]
    ends = [(m, b[3] / b[2]) for b in blocks for m in dict.fromkeys(b[:2])]
    return np.array([m for m, _ in ends]), np.array([s for _, s in ends])


@dataclass
class Model:
    lexicon: Lexicon
    trees: Trees | None
    margins: np.ndarray
    scores: np.ndarray

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), self.scores[0])
        x = np.array([features(t, self.lexicon) for t in texts]).reshape(len(texts), len(FEATURES))
        return np.clip(np.interp(self.trees.margin(x), self.margins, self.scores), 0.0, 1.0)


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves 0 by 5."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("long").cast("string"), F.lit(""))) % 5 == 0


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, toxic, signature): the smallest hash of a document's runs of three words, the same for most near copies."""
    for batch in batches:
        signatures = []
        for at in range(0, batch.num_rows, SLICE_ROWS):
            for text in batch.column(2).slice(at, SLICE_ROWS).to_pylist():
                words = _WORD.findall((text or "").lower())
                runs = map(" ".join, zip(words, words[1:], words[2:])) if len(words) > 2 else [" ".join(words)]  # noqa: B905
                signatures.append(min(map(xxhash.xxh3_64_intdigest, runs)) - (1 << 63))
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(signatures, pa.int64())], ["id", "toxic", "signature"])


def _word_counts(batches: Iterator[pa.RecordBatch], folds: int, held: int = 300_000) -> Iterator[pa.RecordBatch]:
    """(word, fold, toxic, n): in how many documents of a fold and label a word stands; an empty word counts the documents."""
    counts: Counter = Counter()

    def out() -> pa.RecordBatch:
        rows = [(*k, n) for k, n in counts.items()]
        counts.clear()
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 4, kinds, strict=True)], ["word", "fold", "toxic", "n"])

    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            for doc_id, toxic, text in zip(*(c.to_pylist() for c in batch.slice(at, SLICE_ROWS).columns), strict=True):
                fold = _fold(doc_id, folds)
                held_here = {e for w in set(_WORD.findall((text or "").lower())) for e in entries(w)}
                counts.update((e, fold, toxic) for e in {"", *held_here})
            if len(counts) > held:
                yield out()
    yield out()


def _fold(doc_id: int, folds: int) -> int:
    return xxhash.xxh3_64_intdigest(str(doc_id), 1) % folds


def _sample_features(batches: Iterator[pa.RecordBatch], lexicons: list[Lexicon]) -> Iterator[pa.RecordBatch]:
    """(id, fold, toxic, own): features by the lexicon of the other folds."""
    folds = len(lexicons)
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            ids, toxic, texts = (c.to_pylist() for c in batch.slice(at, SLICE_ROWS).columns)
            fold = [_fold(i, folds) for i in ids]
            own = [np.array(features(t, lexicons[f])).tobytes() for t, f in zip(texts, fold, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(fold, pa.int32()), pa.array(toxic, pa.int32()), pa.array(own, pa.binary())], ["id", "fold", "toxic", "own"])


def _lexicons(counts: DataFrame, folds: int, lexicon_words: int, least_docs: int, least_z: float, least_odds: float) -> list[Lexicon]:
    """For each fold the lexicon of the others, and at last the lexicon of all."""
    total = {(r.fold, r.toxic): r.n for r in counts.filter("word = ''").collect()}
    cells = [(f, t) for f in range(folds) for t in (0, 1)]
    wide = counts.filter("word <> ''").groupBy("word").agg(*(F.sum(F.when((F.col("fold") == f) & (F.col("toxic") == t), F.col("n")).otherwise(0)).alias(f"n_{f}_{t}") for f, t in cells))
    out = []
    for left_out in [*range(folds), None]:
        in_use = [f for f in range(folds) if f != left_out]
        of = {t: sum((F.col(f"n_{f}_{t}") for f in in_use), F.lit(0)).cast("double") for t in (0, 1)}
        n = {t: float(sum(total.get((f, t), 0) for f in in_use)) for t in (0, 1)}
        log_odds = F.log((of[1] + 0.5) / (n[1] - of[1] + 0.5)) - F.log((of[0] + 0.5) / (n[0] - of[0] + 0.5))
        z = log_odds / F.sqrt(1 / (of[1] + 0.5) + 1 / (of[0] + 0.5))
        best = wide.filter((of[1] >= least_docs) & (log_odds >= least_odds)).select("word", z.alias("z")).filter(F.col("z") >= least_z)
        weight: dict[str, float] = {}
        for r in best.orderBy(F.desc("z"), "word").limit(8 * lexicon_words).collect():
            if len(weight) < lexicon_words and not any(e in weight for e in entries(r.word.rstrip("*"))):
                weight[r.word] = r.z
        out.append(Lexicon(weight))
    return out


def fit(
    docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000, folds: int = 3, lexicon_words: int = 512, least_docs: int = 3, least_z: float = 2.5, least_odds: float = 2.0, **how: float
) -> Model:
    """A model from documents (doc_id, text) and labels (doc_id, toxic) of rows that are not held out."""
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").filter(~held_out())
    known = known.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    sizes = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    none = Model(Lexicon({}), None, np.zeros(1), np.array([sizes.get(1, 0) / max(sum(sizes.values()), 1)]))
    if len(sizes) < 2:
        return none
    place = F.xxhash64("id").bitwiseAND(F.lit((1 << 63) - 1))
    share = {t: min(1.0, sample_rows / 2 / n) * 2.0**63 for t, n in sizes.items()}
    chosen = known.filter(place < F.when(F.col("toxic") == 1, share[1]).otherwise(share[0]))
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    sampled = lambda ids: rows.join(F.broadcast(ids), "id").select("id", "toxic", "text")  # noqa: E731  ids: about sample_rows rows
    first = sampled(chosen).mapInArrow(_signed, "id long, toxic int, signature long").groupBy("signature", "toxic").agg(F.min("id").alias("id"))
    first = docs.sparkSession.createDataFrame(first.select("id", "toxic").collect(), "id long, toxic int")
    counts = sampled(first).mapInArrow(partial(_word_counts, folds=folds), "word string, fold int, toxic int, n long")
    counts = counts.groupBy("word", "fold", "toxic").agg(F.sum("n").alias("n")).cache()
    lexicons = _lexicons(counts, folds, lexicon_words, least_docs, least_z, least_odds)
    counts.unpersist()
    found = sampled(first).mapInArrow(partial(_sample_features, lexicons=lexicons[:-1]), "id long, fold int, toxic int, own binary")
    told = sorted(map(tuple, found.collect()))  # about sample_rows rows of 18 numbers
    if len({r[2] for r in told}) < 2:
        return none
    fold, y = (np.array([r[i] for r in told]) for i in (1, 2))
    own = np.array([np.frombuffer(r[3]) for r in told])
    margin = np.zeros(len(y))
    for f in range(folds):
        others = fold != f
        if others.all() or len(set(y[others].tolist())) < 2:
            margin[~others] = np.log(max(y.mean(), 1e-6) / max(1 - y.mean(), 1e-6))
        else:
            margin[~others] = boost(own[others], y[others].astype(float), **how).margin(own[~others])
    weight = 2.0**63 / np.array([share[t] for t in y.tolist()])  # a row stands for so many
    return Model(lexicons[-1], boost(own, y.astype(float), **how), *isotonic(margin, y.astype(float), weight))


def _scored(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            part = batch.slice(at, SLICE_ROWS)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.score(part.column(1).to_pylist()))], ["doc_id", "score"])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for every row of ``docs`` (doc_id, text)."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(partial(_scored, model=model), "doc_id long, score double")


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``, learned from the labels of rows not held out."""
    found = score(docs, fit(docs, labels))
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
