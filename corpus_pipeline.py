"""A corpus from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns what stays of ``docs``, all columns; the last
one returns the packed pieces. Stages are independent: each is written and read again before
the next.

Defined cases: null and empty texts have too few words and end at the first stage; very long
texts go through whole; rows are never merged, so of repeated rows those that carry the id
that stays all stay; rows with a null doc_id stay unless they are copies of one with an id (or
of each other: then all stay, none being told from another); ties are those of the operators;
extra columns, whatever their names, are kept to the last stage; empty tables give no pieces.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from memlake.llm import exact_dedup, language_id, near_dedup, packing, quality_rules
from memlake.llm.common import drop_table, kept_table, scratch, table

#: A document below this share for its likeliest language is in none of the learned ones.
LEAST_LANGUAGE_SCORE = 0.4
SHINGLE_WORDS, SIMILARITY_PERCENT = 5, 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_documents(docs, table(spark, sf_dir, "labels"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep_documents(docs, LEAST_LANGUAGE_SCORE)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_documents(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_documents(docs, SHINGLE_WORDS, SIMILARITY_PERCENT)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("language ID", language),
    ("exact dedup", exact),
    ("near dedup", near),
    ("packing", pack),
]

#: Learned rules, models and MinHash have no SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        with scratch():  # a stage's own tables go once its result is written, and its input with them
            before, docs = docs, kept_table(stage(spark, docs, sf_dir))
        drop_table(before)
    return STAGES[-1][1](spark, docs, sf_dir)
