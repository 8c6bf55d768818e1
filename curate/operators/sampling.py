"""Balancing, chunk routing, sampling, splitting and shuffling, all repeatable by seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from curate.functions.base import ColumnLike, col, cols
from curate.functions.positions import mirror_fen
from curate.functions.seeded import seeded_int, seeded_key
from curate.operators.ranking import DIGITS, dedupe_first, ordered_rank, seeded_rank, select_first, top_per_group
from curate.sources.pools import read_first
from curate.storage import stage

# Chunk size, rows per chunk of (source, class), seeds, windows.
CHUNK_SIZE = 50_000
QUOTAS = {
    ("game", 0): 13_334,
    ("game", 1): 15_834,
    ("game", 2): 13_332,
    ("puzzle", 0): 2_500,
    ("puzzle", 1): 0,
    ("puzzle", 2): 2_500,
    ("tablebase", 0): 833,
    ("tablebase", 1): 833,
    ("tablebase", 2): 834,
}
SEED = 7
VAL_CHUNKS = 2
REPLAY_ITERATIONS, REPLAY_ROWS = 4, 8_000
CLOCK_JITTER = 30


def stratum_counts(df: DataFrame, strata=("source", "wdl")) -> DataFrame:
    """Rows per (source, class), per source and overall; ``level`` tells a total from a NULL value (0: no total)."""
    cells = df.groupBy(*strata).agg(F.count(F.lit(1)).alias("_n"))
    return cells.rollup(*strata).agg(F.grouping_id().alias("level"), F.sum("_n").alias("n_rows"))


def quota_table(spark, quotas: dict, strata=("source", "wdl"), chunk_size: int | None = None) -> DataFrame:
    """The per-chunk quotas as a table; they must be non-negative and fill the chunk exactly."""
    if any(q < 0 for q in quotas.values()):
        raise ValueError("a quota is negative")
    if chunk_size is not None and sum(quotas.values()) != chunk_size:
        raise ValueError(f"quotas sum to {sum(quotas.values())}, not to the chunk size {chunk_size}")
    rows = [(*k, int(q)) for k, q in quotas.items()]
    return spark.createDataFrame(rows, f"{strata[0]} string, {strata[1]} int, quota int")


def plan_chunks(
    counts: DataFrame, quotas: dict, max_chunks: int | None = None, chunk_size: int | None = None, strata=("source", "wdl")
) -> DataFrame:
    """(stratum, quota, n_rows, n_chunks, keep): as many chunks as the scarcest stratum allows.

    ``counts`` has a row per stratum, and may have totals marked by ``level``. No whole chunk is an error. The result has one
    row per quota, so it is small by construction.
    """
    table = quota_table(counts.sparkSession, quotas, strata, chunk_size)
    sizes = counts.where("level = 0") if "level" in counts.columns else counts
    planned = table.join(sizes.select(*strata, "n_rows"), list(strata), "left")
    rows = planned.withColumn("n_rows", F.coalesce("n_rows", F.lit(0)))
    fits = F.when(F.col("quota") > 0, F.floor(F.col("n_rows") / F.when(F.col("quota") > 0, F.col("quota"))))
    n = F.min(fits).over(Window.partitionBy(F.lit(1)))
    n = n if max_chunks is None else F.least(n, F.lit(max_chunks))
    none = F.raise_error(F.lit("pools too small or too unbalanced for one chunk")).cast("long")
    return rows.withColumn("_n", n).select(
        *strata,
        "quota",
        "n_rows",
        F.when(F.col("_n") > 0, F.col("_n")).otherwise(none).alias("n_chunks"),
        (F.col("_n") * F.col("quota")).alias("keep"),
    )


def route(
    df: DataFrame,
    plan: DataFrame,
    key,
    seed: int = SEED,
    strata=("source", "wdl"),
    assign: str = "hash",
    order: list | None = None,
    histogram: DataFrame | None = None,
    digits: int = DIGITS,
) -> DataFrame:
    """Draw exactly n_chunks x quota rows of every stratum and give each its chunk_id.

    The draw is by seeded hash, without replacement. assign "hash" cuts chunks along the same hash;
    "stream" cuts them along ``order``, so that a chunk is a contiguous part of each pool.
    ``histogram`` is the ``seeded_histogram`` of the pools, if there is one already.
    """
    by = list(strata)
    quotas = plan.where(F.col("quota") > 0).select(*by, "quota", "keep")
    drawn = seeded_rank(df, by, key, seed, quotas, histogram, digits)
    if assign == "stream":
        drawn = ordered_rank(drawn.drop("rank"), by, order)
    placed = drawn.join(F.broadcast(quotas.drop("keep")), by)
    chunk = F.floor((F.col("rank") - 1) / F.col("quota")).cast("int")
    return placed.withColumn("chunk_id", chunk).drop("quota", "rank")


def with_shuffle_key(df: DataFrame, by: str, key, seed: int = SEED) -> DataFrame:
    """Add the key that orders the rows of each group at random: seed + group number, then the row key."""
    return df.withColumn("shuffle_key", seeded_key((F.lit(seed) + F.col(by)).cast("string"), *cols(key)))


def shuffle_in(df: DataFrame, by: str, key, seed: int = SEED) -> DataFrame:
    """Rows clustered by group and in random, repeatable order inside it."""
    keyed = with_shuffle_key(df, by, key, seed)
    return keyed.repartitionByRange(by, "shuffle_key").sortWithinPartitions(by, "shuffle_key").drop("shuffle_key")


def capped_fill(
    df: DataFrame, caps: dict[int, int], cls: str, priority: str, order: list[str], fill_classes=(0,)
) -> DataFrame:
    """Priority rows first, then the other rows of the fill classes, up to the cap of each class, in order."""
    allowed = df.where(F.col(priority) | F.col(cls).isin(*fill_classes))
    passes = allowed.where(F.col(cls).isin(*caps)).withColumn("_second", F.when(F.col(priority), 0).otherwise(1))
    return select_first(passes, cls, order, _kept(df, cls, caps), then="_second").drop("_second")


def _kept(df: DataFrame, group: str, quotas: dict) -> DataFrame:
    """(group, keep) of the quotas."""
    shape = T.StructType([T.StructField(group, df.schema[group].dataType), T.StructField("keep", T.LongType())])
    return df.sparkSession.createDataFrame([(g, int(n)) for g, n in quotas.items()], shape)


def sample_per_group(
    df: DataFrame, group, key, cls: str, k: int, per_class: int, seed: int = SEED
) -> DataFrame:
    """k random rows per group, then at most 2 x per_class rows per class, then exactly per_class of them at random.

    The cap takes groups in a seeded order of their own; the rows come back with their shuffle_key.
    """
    picked = top_per_group(
        df.withColumn("_draw", seeded_key(seed, *cols(key))), group, ["_draw", *cols(key)], k, "_pick"
    ).drop("_pick", "_draw")
    # Both caps read their input twice, so the picks, and then the few capped rows, are stored in between.
    pool = stage(_seeded_cap(stage(picked, "picked"), cls, key, seed + 1, 2 * per_class), "pool")
    final = _seeded_cap(pool, cls, key, seed + 2, per_class)
    return final.withColumn("shuffle_key", seeded_key(seed + 3, *cols(key)))


def _seeded_cap(df: DataFrame, cls: str, key, seed: int, n: int) -> DataFrame:
    return seeded_rank(df, cls, key, seed, n).drop("rank")


def head_per_group(df: DataFrame, group: str, quotas: dict, order: list[str]) -> DataFrame:
    """The first rows of each named group, up to its quota, in stream order."""
    return select_first(df.where(F.col(group).isin(*quotas)), group, order, _kept(df, group, quotas))


def head_of_pool(spark, path: str, group: str, quotas: dict, order: list[str]) -> DataFrame:
    """``head_per_group`` of a pool stored by ``write_pool`` with the same group and first order column.

    The catalogue says where the quotas are full, and files behind that are never opened.
    """
    keep = _kept(spark.read.parquet(path), group, quotas)
    return select_first(read_first(spark, path, group, keep), group, order, keep)


def drop_ambiguous(df: DataFrame, score: ColumnLike, exact_draw_only: bool = False) -> DataFrame:
    """Without the scores +-1 (a win or loss only outside the 50-move rule); or exact draws only."""
    return df.where(col(score) == 0) if exact_draw_only else df.where(F.abs(col(score)) != 1)


def chunk_sizes(df: DataFrame, chunk: str = "chunk_id") -> DataFrame:
    return df.groupBy(chunk).agg(F.count(F.lit(1)).alias("n_rows"))


def split_chunks(sizes: DataFrame, full: int = CHUNK_SIZE, val: int = VAL_CHUNKS, chunk: str = "chunk_id") -> DataFrame:
    """Add ``split``: tail (not full), val (the last ``val`` full chunks) or train; no val if that would leave no train.

    ``sizes`` has one row per chunk. The last chunks are found by a top-k, not by a global window.
    """
    whole = sizes.where(F.col("n_rows") >= full)
    last = whole.orderBy(F.desc(chunk)).limit(val).select(chunk, F.lit(1).alias("_last"))
    n_whole = whole.agg(F.count(F.lit(1))).scalar()
    marked = sizes.join(F.broadcast(last), chunk, "left")
    split = (
        F.when(F.col("n_rows") < full, "tail")
        .when(F.col("_last").isNotNull() & (n_whole > val) & F.lit(val > 0), "val")
        .otherwise("train")
    )
    return marked.withColumn("split", split).drop("_last")


def epoch_order(
    chunks: DataFrame, epoch: int, limit: int | None = None, skip: int = 0, seed: int = 42, chunk: str = "chunk_id"
) -> DataFrame:
    """Chunks with their ``position`` in the epoch's permutation; first ``limit`` only, minus the ``skip`` done ones."""
    keyed = chunks.select(chunk).withColumn("_order", seeded_key(seed + epoch, chunk))
    ranked = ordered_rank(keyed, [], ["_order", chunk], "_rank").withColumn("position", F.col("_rank") - 1)
    kept = ranked.where(F.col("position") >= skip)
    kept = kept if limit is None else kept.where(F.col("position") < limit)
    return kept.drop("_order", "_rank")


def replay_sample(df: DataFrame, iteration: str, key, iters: int = REPLAY_ITERATIONS, k: int = REPLAY_ROWS, seed: int = SEED) -> DataFrame:
    """k rows, uniform over the last ``iters`` iterations; with replacement only where the window holds fewer.

    Adds ``draw`` 0..k-1. The last iteration and the window's rows are counted inside the query; no job runs while the plan is
    made, and at most ``k`` rows leave the scan.
    """
    recent = df.where(F.col(iteration) > df.agg(F.max(iteration)).scalar() - iters)
    n = recent.agg(F.count(F.lit(1))).scalar()
    rows = seeded_rank(recent, [], key, seed, k, name="_rank").withColumn("_row", F.col("_rank") - 1).drop("_rank")
    once = rows.where(n >= k).select(*df.columns, F.col("_row").cast("int").alias("draw"))
    draws = df.sparkSession.range(k).select(F.col("id").cast("int").alias("draw")).where(n < k)
    again = draws.withColumn("_row", seeded_int(seed + 1, F.greatest(n, F.lit(1)), "draw").cast("long")).join(rows, "_row")
    return once.unionByName(again.select(*df.columns, "draw"))


def unique_sequences(df: DataFrame, moves: str, order: list, n: int | None = None) -> DataFrame:
    """Distinct move sequences, the first of each kept; an error if fewer than ``n``."""
    unique = dedupe_first(df.withColumn("_seq", F.array_join(moves, " ")), "_seq", order).drop("_seq")
    if n is None:
        return unique
    found = unique.orderBy(*order).limit(n)
    have = found.count()
    if have < n:
        raise ValueError(f"only {have} unique sequences, wanted {n}")
    return found


def mirror_half(df: DataFrame, key, seed: int = SEED, fen: str = "fen") -> DataFrame:
    """Mirror about half of the rows, chosen by hash; a side-relative label stays true."""
    flip = seeded_int(seed, 2, *cols(key)) == 1
    return df.withColumn("mirrored", flip).withColumn(fen, F.when(flip, mirror_fen(fen)).otherwise(F.col(fen)))


def jitter(df: DataFrame, name: str, low: int, high: int, key, seed: int = SEED, where: Column | None = None) -> DataFrame:
    """Replace a column by a draw from low..high, on the rows asked for."""
    draw = low + seeded_int(seed, high - low + 1, *cols(key))
    return df.withColumn(name, draw if where is None else F.when(where, draw).otherwise(F.col(name)))


def shortcut_audit(df: DataFrame, source: str = "source", cls: str = "wdl") -> DataFrame:
    """Class shares per source; ``max_share`` 1 marks a source that gives its class away."""
    counts = df.groupBy(source, cls).agg(F.count(F.lit(1)).alias("n_rows"))
    whole = Window.partitionBy(source)
    share = F.col("n_rows") / F.sum("n_rows").over(whole)
    rows = counts.withColumn("share", share).withColumn("max_share", F.max("share").over(whole))
    return rows.withColumn("give_away", F.col("max_share") == 1.0)


def union_pools(pools: dict[str, DataFrame]) -> DataFrame:
    """The pools of all sources as one table with a source tag."""
    out = None
    for source, pool in pools.items():
        tagged = pool.withColumn("source", F.lit(source))
        out = tagged if out is None else out.unionByName(tagged)
    return out


def wanted_minus_done(wanted: DataFrame, done: DataFrame, key) -> DataFrame:
    """Distinct wanted keys that are not done."""
    return wanted.select(*cols(key)).distinct().join(done.select(*cols(key)), cols(key), "left_anti")


def distinct_keys(df: DataFrame, key) -> DataFrame:
    return df.select(*cols(key)).distinct()
