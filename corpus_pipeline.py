"""The corpus pipeline: from documents to packed training sequences, one operator per stage.

Quality classifier, near duplicates, repeated passages, benchmark passages, packing. Every stage works on all rows
its predecessor kept, and all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from curate.llm import decontam, jaccard, packing, quality, substring
from curate.llm.queries import vocabulary
from curate.llm.registry import importable, table
from curate.storage import stage


def accept_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts. It learns from the labelled rows of ``documents`` outside the held-out fold."""
    model = quality.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality.accepted(docs, model)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8)."""
    return jaccard.one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 35 words that stand elsewhere too; ``n_chars`` follows the text."""
    return substring.without_repeats(docs, length_col="n_chars")


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without ten consecutive words of a benchmark item."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces placed in sequences of 2048."""
    return packing.pack(packing.pieces(docs, vocabulary(), end_id=0))


STAGES = [
    ("quality", accept_quality),
    ("near_duplicates", one_of_each_group),
    ("substrings", cut_repeats),
    ("decontamination", drop_leaks),
    ("packing", pack_sequences),
]
#: The classifier and the tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next."""
    importable(spark)
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
