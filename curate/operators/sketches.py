"""Unique counts that are kept per batch and united on reading, so that no old batch is read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curate.functions.base import cols

#: 2^LG_K registers: an error of about 0.4 percent, in at most 64 kB per batch.
LG_K = 16
SCHEMA = "n_rows long, sketch binary, batch string"


def key_sketch(df: DataFrame, key) -> DataFrame:
    """(n_rows, sketch) of the keys of a batch, in one map-combined pass. Keys that hold a NULL are rows, but no keys."""
    key = cols(key)
    whole = F.xxhash64(*key)
    for c in key:
        whole = F.when(F.col(c).isNotNull(), whole)
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.hll_sketch_agg(whole, F.lit(LG_K)).alias("sketch"))


def write_sketch(df: DataFrame, key, path: str, batch: str) -> None:
    """Store the sketch of one batch under its name; a batch that is written again replaces its own."""
    key_sketch(df, key).coalesce(1).write.mode("overwrite").parquet(f"{path}/batch={batch}")


def read_sketches(spark: SparkSession, path: str) -> DataFrame:
    """(n_rows, sketch, batch) of every batch so far."""
    return spark.read.schema(SCHEMA).option("basePath", path).parquet(path)


def unique_estimate(sketches: DataFrame) -> DataFrame:
    """(n_rows, n_unique): all rows, and about how many keys they have between them."""
    united = F.hll_sketch_estimate(F.hll_union_agg("sketch"))
    return sketches.agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows"), F.coalesce(united, F.lit(0)).alias("n_unique"))


def worklist_estimate(wanted: DataFrame, done: DataFrame) -> DataFrame:
    """(n_rows, n_unique, n_todo) of a work list from the sketches of its batches and of the annotations'.

    What is left to do is what the union has beyond the annotated keys, so its error is a share of the union, not of itself.
    """
    both = unique_estimate(wanted.select("n_rows", "sketch").unionByName(done.select("n_rows", "sketch"))).select(F.col("n_unique").alias("_all"))
    known = unique_estimate(done).select(F.col("n_unique").alias("_known"))
    # One row each.
    rows = unique_estimate(wanted).join(F.broadcast(both)).join(F.broadcast(known))
    return rows.select("n_rows", "n_unique", F.greatest(F.col("_all") - F.col("_known"), F.lit(0)).alias("n_todo"))
