"""Corpus pipeline: drop documents of poor quality, near copies and repeated passages, then pack the rest into sequences."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlens.llm import neighbours, packing, prob_minhash, suffix_groups
from sessionlens.llm.common import read
from sessionlens.session import stage

CAPACITY = 2048
#: Bytes of the least passage that is cut. In the tables at hand, documents that share a passage of over 50 words share 200 bytes
#: (843 of 843 of 9,252 documents without near copies); with 400 bytes it is 642 of them, with 300 835.
PASSAGE = 200


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose neighbours vote for quality; the rest go."""
    model = neighbours.fit(docs, read(spark, sf_dir, "labels"))
    return docs.where(model.score_column(F.col("text")) >= 0.5)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: five-word shingles, similarity 0.8 or more."""
    return prob_minhash.without_near_copies(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of ``PASSAGE`` bytes or more that stand elsewhere too; ``n_chars`` follows the text."""
    return suffix_groups.without_repeats(docs, PASSAGE).withColumn("n_chars", F.char_length("text").cast("long"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents with their place in sequences of 2048 tokens: ``ids`` and where they stand."""
    return packing.pack(packing.token_pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), CAPACITY, end_id=0), CAPACITY)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("near_copies", near_copies),
    ("repeated_passages", repeated_passages),
    ("best_fit_packing", best_fit_packing),
]

#: Votes, signatures and packing are not expressible in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
