"""The thin queries of the operators, one for each, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wingspan.llm import (
    bpe_transducer,
    chat_perspectives,
    embedding_dedup,
    language_id,
    license_scan,
    packing,
    quality_rules,
    simhash_dedup,
    spelling_variants,
    substring_dedup,
    token_alignment,
    token_counts,
    toxicity,
)
from wingspan.llm.common import table


def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), words_per_shingle=4, max_bits=4)
    return found.select("doc_id", simhash_dedup.hex_of("fp").alias("fingerprint"), "component_id")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = public_tokenizers.path("byte_bpe_50k.json")
    return token_counts.attribute(table(spark, sf_dir, "documents"), spec, ("source", "lang", "text"), by_line=("text",), rule="most")


def op3_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chat_perspectives.views(table(spark, sf_dir, "conversations"), block_turns=512)
    return found.withColumn("mask", chat_perspectives.spans_as_text("mask"))


def op4_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_transducer.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge_left_out(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.dedup(table(spark, sf_dir, "documents"), unit="phrase", min_words=2, min_run=30)
    spans = F.coalesce("spans", F.array())
    return found.select(
        "doc_id", "text", "n_units", F.size(spans).cast("long").alias("n_removed"),
        F.array_join(F.transform(spans, lambda s: F.concat_ws("-", s["start"], s["end"])), ",").alias("removed"),
    )


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.98)


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.variants(table(spark, sf_dir, "documents"), min_length=5, min_count=3, twice=2)


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return token_alignment.measures(table(spark, sf_dir, "documents"), *both)


REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_simhash_dedup,
        op2_token_counts,
        op3_chat_perspectives,
        op4_bpe_transducer,
        op5_license_scan,
        op6_quality_rules,
        op7_language_id,
        op8_substring_dedup,
        op9_packing,
        op10_embedding_dedup,
        op11_toxicity,
        op12_spelling_variants,
        op13_token_alignment,
    )
}

SQL: dict[str, str] = {
    "op3_chat_perspectives": chat_perspectives.SQL,
    "op8_substring_dedup": substring_dedup.SQL,
    "op12_spelling_variants": spelling_variants.SQL,
}
