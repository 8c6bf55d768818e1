"""Encoded training chunks: Parquet, partitioned by chunk."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curate.functions.labels import BLEND
from curate.functions.positions import encode_sample
from curate.operators.sampling import SEED, with_shuffle_key


def encode_samples(df: DataFrame, lam: float = BLEND) -> DataFrame:
    """Add planes, soft value target and policy weight; the policy itself stays the sparse move_idx."""
    return df.withColumns(encode_sample("fen", "move_idx", "wdl", "w", "d", "l", lam))


def dense_policy(move_idx: str = "move_idx", size: int = 1858):
    """The policy target as a dense array, for export only: all zero without a move."""
    one = F.lit(1.0).cast("float")
    zero = F.lit(0.0).cast("float")
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.when(i == F.col(move_idx), one).otherwise(zero))


def write_chunks(
    df: DataFrame,
    path: str,
    key,
    seed: int = SEED,
    chunk: str = "chunk_id",
    encode: Callable[[DataFrame], DataFrame] | None = None,
) -> None:
    """One folder per chunk, rows in the chunk's random order.

    Rows are range-partitioned by (chunk, shuffle key): a large chunk is spread over several tasks, and
    a task holds few open files. ``encode`` (``encode_samples``, say) runs after that, just before the
    write: the shuffle and its sampling pass then move position texts and not the arrays made of them.
    """
    keyed = with_shuffle_key(df, chunk, key, seed)
    ranged = keyed.repartitionByRange(chunk, "shuffle_key").sortWithinPartitions(chunk, "shuffle_key")
    rows = ranged.drop("shuffle_key")
    rows = rows if encode is None else encode(rows)
    rows.write.partitionBy(chunk).parquet(path)


def read_chunks(spark: SparkSession, path: str, chunks: list | None = None, chunk: str = "chunk_id") -> DataFrame:
    """All chunks, or the named ones; the filter prunes whole folders."""
    rows = spark.read.parquet(path)
    return rows if chunks is None else rows.where(F.col(chunk).isin(*chunks))


def stored_chunk_sizes(spark: SparkSession, path: str, chunk: str = "chunk_id") -> DataFrame:
    """Rows per stored chunk; the scan reads no data column."""
    return spark.read.parquet(path).groupBy(chunk).agg(F.count(F.lit(1)).alias("n_rows"))
