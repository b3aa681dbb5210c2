"""The corpus pipeline: documents through five operators of wingspan.llm, stage by stage.

Every stage works on all rows that its predecessor kept; each is written as Parquet and read again. All but the last
return the columns of ``documents``; the last one returns the packed pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wingspan.llm import language_id, packing, quality_rules, simhash_dedup, substring_dedup
from wingspan.llm.common import table
from wingspan.session import scratch_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.kept_documents(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or whose language no probability of 0.4 or more speaks for, go."""
    return language_id.sure_documents(docs.select(*COLUMNS), least_score=0.4)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest doc_id."""
    return simhash_dedup.one_of_each_group(docs.select(*COLUMNS), words_per_shingle=4, max_bits=4)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Runs of 30 words and more of phrases that stand in an earlier place go; n_chars follows the text. No document goes."""
    kept = substring_dedup.dedup(docs, unit="phrase", min_words=2, min_run=30, carry=("lang", "source"))
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all sequences."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality),
    ("language_id", language),
    ("simhash_dedup", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("packing", packed),
]

#: SQL can't express the hashes, the model and the tokenizer; tests/llm/test_pipeline.py has the brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. What a stage wrote goes once the next one is written."""
    docs, old = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if old is not None:
            gone = spark._jvm.org.apache.hadoop.fs.Path(old)
            gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)
        old = path
    return STAGES[-1][1](spark, docs, sf_dir)
