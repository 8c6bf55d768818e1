"""Pools to balanced, annotated, encoded training chunks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curate.functions.labels import BLEND
from curate.operators.joins import join_annotations, worklist
from curate.operators.ranking import seeded_histogram
from curate.operators.sampling import CHUNK_SIZE, QUOTAS, SEED, plan_chunks, route, union_pools
from curate.sources.chunks import encode_samples, write_chunks
from curate.storage import stage


@dataclass
class RoutedSet:
    """The plan (one row per stratum) and the routed rows."""

    plan: DataFrame
    rows: DataFrame


def plan_and_route(
    pools: DataFrame, key, quotas: dict = QUOTAS, chunk_size: int | None = CHUNK_SIZE, max_chunks: int | None = None, seed: int = SEED
) -> RoutedSet:
    """Count the strata, plan the chunks, draw and route the rows: two passes over the pools.

    The first pass counts rows per stratum and hash bucket. That table (strata x buckets rows) is
    staged; it gives both the stratum counts of the plan and the ranks of the draw.
    """
    strata = ["source", "wdl"]
    histogram = stage(seeded_histogram(pools, strata, key, seed), "histogram")
    counts = histogram.groupBy(*strata).agg(F.sum("_size").alias("n_rows"))
    plan = plan_chunks(counts, quotas, max_chunks, chunk_size)
    return RoutedSet(plan, route(pools, plan, key, seed, histogram=histogram))


def build_training_set(
    pools: dict[str, DataFrame], annotations: DataFrame, out: str, key, lam: float = BLEND, **plan_args
) -> RoutedSet:
    """Route the pools, join the annotations, encode, and write the chunks to ``out``.

    Boards are encoded last, on the drawn rows only; rows of skipped sources keep their one-hot target.
    Pools carry fen, move_idx, wdl, source_id and the row key.
    """
    routed = plan_and_route(union_pools(pools), key, **plan_args)
    joined = join_annotations(routed.rows, annotations)
    write_chunks(joined, out, key, encode=lambda rows: encode_samples(rows, lam))
    return routed


def annotation_worklist(routed: RoutedSet, annotations: DataFrame, order: list) -> DataFrame:
    """Keys of the routed rows that still need an annotation."""
    return worklist(routed.rows, annotations, "fen", order)
