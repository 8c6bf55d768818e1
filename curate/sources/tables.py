"""Puzzle, manifest, routed and annotation rows, id lists and persisted sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curate.functions.base import cols
from curate.functions.labels import source_of
from curate.operators.ranking import dedupe_first

# Fixed values.
PUZZLE_SCHEMA = "PuzzleId string, FEN string, Moves string, Themes string"
MANIFEST_SCHEMA = "fen string, move_idx int, wdl int"
SHARDS = 64
BUCKETS = 64


def read_puzzles(spark: SparkSession, path, schema: str = PUZZLE_SCHEMA, limit: int | None = None) -> DataFrame:
    """Puzzle CSV with a header; columns are matched by name, moves come as an array. ``limit``: first rows only."""
    raw = spark.read.option("header", True).option("maxCharsPerColumn", -1).csv(path)
    wanted = [part.split()[0] for part in schema.split(",")]
    rows = raw.select(*wanted)
    rows = rows if limit is None else rows.limit(limit)
    return rows.withColumn("Moves", F.split(F.trim("Moves"), " +"))


def _field(text: Column, i: int, n: int) -> Column:
    """Field i of 'rest,f1..fn' counted from the right end, so commas in the rest do no harm."""
    parts = F.split(text, ",")
    if i == 0:
        return F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - n, F.lit(0))), ",")
    return F.get(parts, F.size(parts) - n + i - 1)


def read_manifest(spark: SparkSession, path, with_source: bool = False) -> DataFrame:
    """Manifest rows fen,move_idx,wdl, parsed from the right; move_idx -1 becomes NULL.

    with_source adds the source taken from the pool file's name.
    """
    raw = spark.read.text(path).where(F.col("value") != "")
    value = F.col("value")
    rows = raw.select(
        _field(value, 0, 2).alias("fen"),
        F.nullif(_field(value, 1, 2).cast("int"), F.lit(-1)).alias("move_idx"),
        _field(value, 2, 2).cast("int").alias("wdl"),
        *([source_of("_metadata.file_path").alias("source")] if with_source else []),
    )
    return rows


def write_manifest(df: DataFrame, path: str) -> None:
    """Write fen,move_idx,wdl lines; a missing move is -1."""
    move = F.coalesce("move_idx", F.lit(-1))
    df.select(F.concat_ws(",", "fen", move.cast("string"), F.col("wdl").cast("string")).alias("value")).write.text(path)


def parse_routed(df: DataFrame, value: str = "value") -> DataFrame:
    """fen,move_idx,wdl,source_id[,w,d,l] -> typed columns; -1 becomes NULL.

    The field count of each line decides, so a joined line is never read with its loss share as source.
    """
    text = F.col(value)
    joined = F.size(F.split(text, ",")) >= 7
    n = F.when(joined, 6).otherwise(3)
    parts = F.split(text, ",")

    def field(i: int) -> Column:
        return F.get(parts, F.size(parts) - n + i - 1)

    def soft(i: int) -> Column:
        share = F.when(joined, field(i).cast("int"))
        return F.when(field(4).cast("int") != -1, share)

    return df.select(
        F.array_join(F.slice(parts, F.lit(1), F.size(parts) - n), ",").alias("fen"),
        F.nullif(field(1).cast("int"), F.lit(-1)).alias("move_idx"),
        field(2).cast("int").alias("wdl"),
        field(3).cast("int").alias("source_id"),
        soft(4).alias("w"),
        soft(5).alias("d"),
        soft(6).alias("l"),
    )


def read_routed(spark: SparkSession, path) -> DataFrame:
    return parse_routed(spark.read.text(path).where(F.col("value") != ""))


def routed_line(joined: bool) -> Column:
    """The text line of a routed row, with or without the annotation fields."""
    names = ["move_idx", "wdl", "source_id"] + (["w", "d", "l"] if joined else [])
    return F.concat_ws(",", "fen", *[F.coalesce(F.col(n), F.lit(-1)).cast("string") for n in names])


def write_routed(df: DataFrame, path: str, joined: bool = True) -> None:
    df.select(routed_line(joined).alias("value")).write.text(path)


def parse_annotations(df: DataFrame, value: str = "value") -> DataFrame:
    """fen,cp,w,d,l lines -> typed rows; a malformed or cut-off line is dropped."""
    text = F.col(value)
    parts = F.split(text, ",")
    rows = df.where(F.size(parts) >= 5).select(
        *[c for c in df.columns if c != value],
        _field(text, 0, 4).alias("fen"),
        *[_field(text, i, 4).try_cast("int").alias(n) for i, n in enumerate(("cp", "w", "d", "l"), 1)],
    )
    return rows.where("fen <> '' and w is not null and d is not null and l is not null")


def read_annotations(spark: SparkSession, path) -> DataFrame:
    """All annotation shards as one table, the first row of each key kept (by shard file, then position in it)."""
    raw = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        (F.monotonically_increasing_id() % (1 << 33)).alias("_line"),
    )
    rows = parse_annotations(raw)
    return dedupe_first(rows, "fen", ["_file", "_block", "_line"]).drop("_file", "_block", "_line")


def read_eval_cache(spark: SparkSession, path) -> DataFrame:
    """(fen, depth, cp, sf_e) of evaluation caches with a header; of a (fen, depth) that stands twice the last line counts."""
    raw = spark.read.option("header", True).option("escape", '"').csv(path)
    rows = raw.select(
        "fen",
        F.col("depth").cast("int").alias("depth"),
        F.col("cp").cast("int").alias("cp"),
        F.col("sf_e").cast("double").alias("sf_e"),
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        (F.monotonically_increasing_id() % (1 << 33)).alias("_line"),
    )
    last = [F.desc("_file"), F.desc("_block"), F.desc("_line")]
    return dedupe_first(rows, ["fen", "depth"], last).drop("_file", "_block", "_line")


def read_positions(spark: SparkSession, path) -> DataFrame:
    """(fen, group, true_cls, puzzle_id, ply, pieces) of position files of one kind, by their header; columns a kind lacks are NULL."""
    raw = spark.read.option("header", True).option("escape", '"').csv(path)
    kinds = {"fen": "string", "group": "string", "true": "int", "puzzle_id": "string", "ply": "int", "pieces": "int"}
    return raw.select(
        *[
            (F.col(c) if c in raw.columns else F.lit(None)).cast(kind).alias("true_cls" if c == "true" else c)
            for c, kind in kinds.items()
        ]
    )


def write_positions(df: DataFrame, path: str) -> None:
    """Write position rows as CSV with a header."""
    df.withColumnRenamed("true_cls", "true").write.option("header", True).option("escape", '"').csv(path)


def shard_of(key: str, shards: int = SHARDS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(shards)).cast("int")


def write_annotations(df: DataFrame, path: str, shards: int = SHARDS) -> None:
    """Append fen,cp,w,d,l lines, one folder per shard."""
    line = F.concat_ws(",", "fen", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("cp", "w", "d", "l")])
    df.select(line.alias("value"), shard_of("fen", shards).alias("shard")).write.mode("append").partitionBy("shard").text(path)


def save_store(annotations: DataFrame, table: str, key="fen", buckets: int = BUCKETS, order=None, path: str | None = None) -> None:
    """Save the annotations as a table of one row per key, bucketed and sorted by the key.

    Joins and work lists against it (``join_store``) then shuffle the other side alone, however often they run. ``order`` says
    which row of a key counts (the first); ``path`` keeps the files where the table is forgotten with its catalogue.
    """
    key = cols(key)
    rows = dedupe_first(annotations, key, cols(order) if order is not None else [c for c in annotations.columns if c not in key])
    # Each task holds whole buckets, so there is one file per bucket.
    writer = rows.repartition(buckets, *key).write.bucketBy(buckets, *key).sortBy(*key).mode("overwrite")
    (writer if path is None else writer.option("path", path)).saveAsTable(table)


def read_ids(spark: SparkSession, path) -> DataFrame:
    """Held-out ids: trimmed non-empty lines, each once; a missing list is an empty one."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    exists = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    if not exists:
        return spark.createDataFrame([], "id string")
    return spark.read.text(path).select(F.trim("value").alias("id")).where("id <> ''").distinct()


def write_ids(df: DataFrame, path: str, key: str = "id") -> None:
    """Write each id once, sorted over the files."""
    df.select(F.col(key).cast("string").alias("value")).distinct().sort("value").write.text(path)


def materialize(df: DataFrame, path: str, regen: bool = False) -> DataFrame:
    """Reuse the table at ``path`` if a finished one is there, else write it; every run then sees the same rows."""
    spark = df.sparkSession
    marker = spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    done = marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker)
    if regen or not done:
        df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
