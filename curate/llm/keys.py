"""Row identity and joins back to the documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Identity of a document inside the operators: its id (may be NULL) and the hash of its text (never NULL).
KEY = ["_id", "_th"]


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: str) -> DataFrame:
    """(_id, _th, _text, more...) of every row; nothing else is read."""
    return docs.select(
        F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_th"), F.col(text_col).alias("_text"), *more
    )


def same_key(left: DataFrame, right: DataFrame) -> Column:
    """Equal identity, NULL ids included."""
    return left["_id"].eqNullSafe(right["_id"]) & (left["_th"] == right["_th"])


def with_facts(rows: DataFrame, facts: DataFrame, how: str = "left") -> DataFrame:
    """Join ``facts`` (one row per key) to ``rows`` by identity; the key columns of ``rows`` stay."""
    facts = facts.withColumnsRenamed({"_id": "_fid", "_th": "_fth"})
    match = rows["_id"].eqNullSafe(facts["_fid"]) & (rows["_th"] == facts["_fth"])
    joined = rows.join(facts, match, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop("_fid", "_fth")


def only(docs: DataFrame, keys: DataFrame, keep: bool, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all their columns, whose identity is in ``keys`` (or, with keep=False, is not)."""
    keys = keys.select(F.col("_id").alias("_fid"), F.col("_th").alias("_fth"))
    match = docs[id_col].eqNullSafe(keys["_fid"]) & (F.xxhash64(docs[text_col]) == keys["_fth"])
    return docs.join(keys, match, "left_semi" if keep else "left_anti")
