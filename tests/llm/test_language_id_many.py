"""Language identification with more labels than a fixed number of languages."""

import random

import pytest

from wingspan.llm import language_id as L


def texts(n_languages, n_rows):
    """Rows of made-up languages, each with its own letters; the higher ones are rarer."""
    draw = random.Random(5)
    word = lambda k: "".join(chr(0x4E00 + 12 * k + draw.randrange(12)) for _ in range(4))
    rows = [(f"l{k:03}", " ".join(word(k) for _ in range(30))) for k in range(n_languages) for _ in range(n_rows + (k < 70) * 4)]
    return [(i, text, lang) for i, (lang, text) in enumerate(rows)]


def test_every_label_is_learned(spark):
    rows = texts(90, 12)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = L.fit(docs)
    assert model.languages == sorted({lang for _, _, lang in rows})
    truth = {i: lang for i, _, lang in rows}
    got = L.identify(docs).collect()
    rare = [r.lang_pred == truth[r.doc_id] for r in got if r.held_out and truth[r.doc_id] >= "l070"]
    assert len(rare) > 20 and sum(rare) / len(rare) > 0.9


def test_a_label_on_copies_of_one_row_is_learned(spark):
    rows = texts(2, 40) + [(1000, "über öl " * 9, "copies")] * 9000
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert "copies" in L.fit(docs, sample_rows=3, least_rows=1).languages


def test_too_many_labels_fail(spark):
    docs = spark.createDataFrame(texts(5, 1), "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="more than 4 distinct labels"):
        L.fit(docs, most_weights=4 << 13)
