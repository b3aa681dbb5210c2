"""Language identification by sparse multinomial logistic regression on TF-IDF character n-grams.

A text's 1- to 3-grams of lower-cased letters (runs of letters with a blank at both ends) are hashed into ``dims``
features. Weights are 1 + log(count) times the inverse document frequency, which is counted over all labelled training
rows, scaled to length 1. The model is trained with follow-the-regularised-leader (per-coordinate steps, elastic-net
penalty ``l1`` and ``l2``, so most weights are exactly 0) on a bounded sample: about ``sample_rows`` labelled rows,
as many of each language, or about ``least_rows`` of each where that is more, chosen by a hash of doc_id and text. Every
label is learned, however rare; labels whose weights would pass ``most_weights`` fail the fit. A quarter of
the sample is kept from the training and sets one temperature, by which the class scores are divided before the softmax.

Rows are scored where they lie; the model (dims x languages numbers) goes with the task. Everything but the fit covers
all rows. Languages are the distinct labels, told apart by code only.

Cases: a text that is null or has no letter gets ``und`` with score 0. Rows with null label are scored, not learned from.
A null doc_id is passed on; such rows train like any other. Repeated rows are scored each. With no labelled row every
text gets ``und``; with one language all get that one, score 1. Other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from itertools import zip_longest

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wingspan.llm.common import SLICE_ROWS

UNKNOWN = "und"
#: Letters and marks of a text that are hashed at a time.
BLOCK = 1 << 16
_NO_LETTERS = re.compile(r"[\W\d_]+")


def features(text: str | None, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashed character n-grams of a text: features in order and their counts. ``dims`` is a power of two."""
    letters = _NO_LETTERS.sub(" ", text or "").strip()
    counts, shift = np.zeros(dims, np.int64), np.uint64(64 - (dims.bit_length() - 1))
    letters = f" {letters.lower()} "
    if len(letters) > 2:
        codes = np.frombuffer(letters.encode("utf-32-le", "replace"), "<u4").astype(np.uint64)
        for at in range(0, len(codes), BLOCK):
            c = codes[at : at + BLOCK + 2]
            own = min(BLOCK, len(codes) - at)  # n-grams that begin here
            h = np.zeros(len(c), np.uint64)
            for n in range(1, 4):
                if (m := min(own, len(c) - n + 1)) < 1:
                    break
                h = (h[: len(c) - n + 1] + c[n - 1 :] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
                counts += np.bincount((h[:m] >> shift).astype(np.int64), minlength=dims)
    held = np.flatnonzero(counts)
    return held, counts[held]


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # dims x languages, with most entries 0
    bias: np.ndarray
    temperature: float = 1.0

    def vector(self, held: np.ndarray, counts: np.ndarray) -> np.ndarray:
        x = (1 + np.log(counts)) * self.idf[held]
        return x / max(np.linalg.norm(x), 1e-12)

    def scores(self, held: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return self.vector(held, counts) @ self.weights[held] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0
        p = softmax(self.scores(*features(text, len(self.idf))) / self.temperature)
        best = int(np.argmax(p))
        return self.languages[best], float(min(1.0, p[best]))


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(rows: list[tuple[str, np.ndarray, np.ndarray]], idf: np.ndarray, languages: list[str], l1: float, l2: float, alpha: float, beta: float, epochs: int) -> Model:
    """Follow the regularised leader, row by row, over (language, features, counts)."""
    dims, k = len(idf), len(languages)
    place = {x: i for i, x in enumerate(languages)}
    model = Model(languages, idf, np.zeros((dims, k)), np.zeros(k))
    z, n = np.zeros((dims + 1, k)), np.zeros((dims + 1, k))  # the last one for the bias
    for _ in range(epochs):
        for lang, held, counts in rows:
            at = np.r_[held, dims]
            x = np.r_[model.vector(held, counts), 1.0]
            w = np.where(np.abs(z[at]) <= l1, 0.0, -(z[at] - np.sign(z[at]) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))
            p = softmax(x @ w)
            p[place[lang]] -= 1
            g = x[:, None] * p
            n_new = n[at] + g * g
            z[at] += g - (np.sqrt(n_new) - np.sqrt(n[at])) / alpha * w
            n[at] = n_new
    w = np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))
    model.weights, model.bias = w[:dims], w[dims]
    return model


def calibrate(model: Model, rows: list[tuple[str, np.ndarray, np.ndarray]]) -> None:
    """Set the temperature of least negative log-likelihood, between 0.01 and 10."""
    if not rows:
        return
    place = {x: i for i, x in enumerate(model.languages)}
    logits = np.array([model.scores(h, c) for _, h, c in rows])
    truth = np.array([place[lang] for lang, _, _ in rows])
    at = np.exp(np.linspace(np.log(0.01), np.log(10), 200))
    loss = [-np.log(np.maximum(softmax(logits / t)[np.arange(len(truth)), truth], 1e-300)).mean() for t in at]
    model.temperature = float(at[int(np.argmin(loss))])


def _document_counts(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[pa.RecordBatch]:
    """One row: the number of texts, and in how many each feature stands."""
    n, of = 0, np.zeros(dims, np.int64)
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            for text in batch.column(0).slice(at, SLICE_ROWS).to_pylist():
                of[features(text, dims)[0]] += 1
                n += 1
    held = np.flatnonzero(of)
    yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, held]), pa.array(np.r_[n, of[held]])], ["feature", "n"])


def _sampled(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[pa.RecordBatch]:
    names = ["lang", "hash", "doc_id", "held", "counts"]
    for batch in batches:
        for lang, h, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            held, counts = features(text, dims)
            both = [pa.array([x.astype("<i4").tobytes()]) for x in (held, counts)]
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([h], pa.int64()), pa.array([doc_id], pa.int64()), *both], names)


def fit(
    labelled: DataFrame,
    dims: int = 1 << 13,
    sample_rows: int = 1600,
    train_share: float = 0.75,
    least_rows: int = 25,
    most_weights: int = 1 << 23,
    l1: float = 0.02,
    l2: float = 0.5,
    alpha: float = 1.0,
    beta: float = 1.0,
    epochs: int = 2,
) -> Model:
    """A model from rows (doc_id, text, lang); rows without lang or without a letter are left out.

    The bound of the fit: about ``sample_rows`` rows, as many of each label, and about ``least_rows`` of each if that is
    more, chosen by a hash of doc_id and text; at least one row of each. Document frequencies are counted over all rows.
    A ValueError where labels times ``dims`` are over ``most_weights``, before anything is trained.
    """
    spark = labelled.sparkSession
    rows = labelled.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    rows = rows.select(F.col("lang").cast("string").alias("lang"), F.xxhash64("doc_id", "text").alias("hash"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    place = F.col("hash").bitwiseAND(F.lit((1 << 63) - 1))
    most = most_weights // dims
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"), F.min(place).alias("first")).limit(most + 1).collect()
    if len(sizes) > most:
        raise ValueError(f"more than {most} distinct labels: their weights on {dims} features pass most_weights = {most_weights}")
    counts = rows.select("text").mapInArrow(partial(_document_counts, dims=dims), "feature long, n long")
    of = {r.feature: r.n for r in counts.groupBy("feature").agg(F.sum("n").alias("n")).collect()}  # dims + 1 rows at most
    idf = np.ones(dims)
    for feature, n in of.items():
        if feature >= 0:
            idf[feature] = np.log((1 + of[-1]) / (1 + n)) + 1
    if not sizes:
        return Model([], idf, np.zeros((dims, 0)), np.zeros(0))
    wanted = max(least_rows, sample_rows // len(sizes))
    # rows whose hash lies in a share of all hashes that leaves about ``wanted`` rows of their language, and the first one
    shares = spark.createDataFrame([(r.lang, min(1.0, wanted / r.n) * 2.0**63, r["first"]) for r in sizes], "lang string, below double, first long")
    chosen = rows.join(F.broadcast(shares), "lang").filter((place < F.col("below")) | (place == F.col("first")))
    sample = chosen.select("lang", "hash", "doc_id", "text").mapInArrow(
        partial(_sampled, dims=dims), "lang string, hash long, doc_id long, held binary, counts binary"
    )
    sample = sample.dropDuplicates(["lang", "hash", "doc_id"]).orderBy("hash", "doc_id", "lang").limit(2 * max(sample_rows, wanted * len(sizes)))
    of_language: dict[str, list] = {}
    for r in sample.collect():
        of_language.setdefault(r.lang, []).append((r.lang, np.frombuffer(r.held, "<i4"), np.frombuffer(r.counts, "<i4")))
    parts = [(x[: max(1, round(train_share * len(x)))], x[max(1, round(train_share * len(x))) :]) for _, x in sorted(of_language.items())]
    in_turn = [r for group in zip_longest(*(a for a, _ in parts)) for r in group if r is not None]
    model = train(in_turn, idf, sorted(of_language), l1, l2, alpha, beta, epochs)
    calibrate(model, [r for _, rest in parts for r in rest])
    return model


def _predicted(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        passed = batch.schema.names[:-1]
        for at in range(0, batch.num_rows, SLICE_ROWS):
            part = batch.slice(at, SLICE_ROWS)
            lang, score = zip(*map(model.predict, part.column(part.num_columns - 1).to_pylist()), strict=True)
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(lang), pa.array(score)], [*passed, "lang_pred", "score"])


def _sure(batches: Iterator[pa.RecordBatch], model: Model, least_score: float) -> Iterator[pa.RecordBatch]:
    at = None
    for batch in batches:
        at = batch.schema.get_field_index("text") if at is None else at
        for begin in range(0, batch.num_rows, SLICE_ROWS):
            part = batch.slice(begin, SLICE_ROWS)
            told = map(model.predict, part.column(at).to_pylist())
            yield part.filter(pa.array([lang != UNKNOWN and score >= least_score for lang, score in told], pa.bool_()))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) for every row of ``docs`` (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(partial(_predicted, model=model), "doc_id long, lang_pred string, score double")


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document is kept from training: crc32 of its id as text, by 4, leaves 2. A null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 4 == 2


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of ``docs`` (doc_id, text, lang), learned from those not held out."""
    model = fit(docs.filter(~held_out()).select("doc_id", "text", "lang"))
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def sure_documents(docs: DataFrame, least_score: float = 0.4) -> DataFrame:
    """The rows of ``docs`` whose language the model tells with at least this probability, with all their columns."""
    model = fit(docs.filter(~held_out()).select("doc_id", "text", "lang"))
    return docs.mapInArrow(partial(_sure, model=model, least_score=least_score), docs.schema)
