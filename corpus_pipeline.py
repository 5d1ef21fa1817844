"""The corpus pipeline: language ID, near-dedup, suffix-array dedup, decontamination, mixing to source weights.

Each stage is a function of (spark, docs, sf_dir) that works on all documents its predecessor kept; run() writes each
result as Parquet to the shared folder and reads it again for the next, and deletes what no later stage reads.

All stages take null texts, ids and labels, empty tables (which give empty tables), repeated rows, columns of any name,
and texts of any length. Reruns on the same rows agree: models are fitted from fixed seeds on documents picked by hash,
and ties go to the smaller doc_id or hash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import decontaminate, language_id, mix_sources, simhash, suffix_dedup
from graphloom.llm.base import discard, table, written

#: Least share of a text's letters in its language.
LEAST_SHARE = 0.4


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters (null and empty texts too), and those that no learned language has LEAST_SHARE of.
    Rows that repeat are judged each, and alike. A table without labelled documents loses all: no language is known."""
    return language_id.keep_identified(docs, language_id.fit_on_rest(docs), LEAST_SHARE)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest doc_id of each group of near copies (shingles of five words, 0.8 or more). Rows
    that repeat a kept doc_id all stay; a null doc_id goes before all others."""
    return simhash.keep_one(docs)


def suffix_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes every byte that a string of 200 bytes with a second occurrence covers; documents of which nothing is left
    go. n_chars follows the text. Repeated rows repeat each other, so of such a group nothing is left; null texts stay."""
    return suffix_dedup.drop_repeats(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of whose words a twentieth or more lies in benchmark windows. Null texts and an empty benchmark hit
    nothing; repeated rows are judged alike."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), remove="documents")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken of every document left. A null source is a source of its
    own, the last; null texts have size 0; repeated rows are documents of their own."""
    return mix_sources.mix(docs)


STAGES = [
    ("language_id", language_stage),
    ("simhash_near_dedup", near_dedup_stage),
    ("suffix_array_dedup", suffix_dedup_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("source_mixing", mixing_stage),
]

#: Networks, chained fingerprints and byte strings have no SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
