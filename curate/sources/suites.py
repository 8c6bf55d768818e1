"""Annotated suites and sweep results (nested JSON)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values.
MIN_SPREAD = 50
MOVES_TYPE = "array<array<string>>"
SUITE_SCHEMA = (
    "meta struct<created:string,suite_size:int,sf_depth:int,seed:int>, "
    f"positions array<struct<fen:string,phase:string,moves:{MOVES_TYPE}>>"
)
SNAP_TYPE = "struct<move:string,elapsed:double,sims:int,topvis:double>"
SWEEP_TYPE = (
    "struct<meta:map<string,string>,cells:map<string,struct<c_puct:double,fpu:double,"
    f"rows:array<struct<fen:string,snaps:map<string,{SNAP_TYPE}>>>,wall:double>>>"
)


def suite_moves(positions: DataFrame, min_spread: int = MIN_SPREAD) -> DataFrame:
    """(fen, phase, moves [[uci, cp]...] best first) -> one row per move: uci, cp, rank, best_cp.

    Positions whose best and worst move differ by less than ``min_spread`` are dropped.
    """
    first = F.get(F.get("moves", F.lit(0)), F.lit(1)).cast("int")
    last = F.get(F.element_at("moves", -1), F.lit(1)).cast("int")
    kept = positions.where((F.size("moves") > 0) & (first - last >= min_spread))
    rows = kept.select(
        "fen", F.coalesce("phase", F.lit("?")).alias("phase"), first.alias("best_cp"), F.posexplode("moves").alias("_i", "_m")
    )
    return rows.select(
        "fen",
        "phase",
        F.get("_m", F.lit(0)).alias("uci"),
        F.get("_m", F.lit(1)).cast("int").alias("cp"),
        (F.col("_i") + 1).alias("rank"),
        "best_cp",
    )


def read_suite(spark: SparkSession, path, min_spread: int = MIN_SPREAD, multi_line: bool = True) -> DataFrame:
    """Suite files to (fen, phase, uci, cp, rank, best_cp). A large suite comes as JSON lines (multi_line false)."""
    blobs = spark.read.schema(SUITE_SCHEMA).option("multiLine", multi_line).option("mode", "FAILFAST").json(path)
    return suite_moves(blobs.select(F.explode("positions").alias("p")).select("p.*"), min_spread)


def suite_meta(spark: SparkSession, path, multi_line: bool = True) -> DataFrame:
    """(field, value) of a suite's identity, for the compatibility check."""
    blobs = spark.read.schema(SUITE_SCHEMA).option("multiLine", multi_line).option("mode", "FAILFAST").json(path)
    pairs = F.create_map(
        *[x for f in ("created", "suite_size", "sf_depth", "seed") for x in (F.lit(f), F.col(f"meta.{f}").cast("string"))]
    )
    return blobs.select(F.explode(pairs).alias("field", "value")).distinct()


def read_sweep(spark: SparkSession, path, whole_files: bool = True) -> DataFrame:
    """Sweep results to (cell, c_puct, fpu, fen, milestone, move, elapsed, sims, topvis)."""
    raw = spark.read.text(path, wholetext=whole_files)
    blob = raw.select(F.from_json("value", SWEEP_TYPE, {"mode": "FAILFAST"}).alias("b"))
    cells = blob.select(F.explode("b.cells").alias("cell", "c"))
    rows = cells.select("cell", "c.c_puct", "c.fpu", F.explode("c.rows").alias("r"))
    snaps = rows.select("cell", "c_puct", "fpu", "r.fen", F.explode("r.snaps").alias("milestone", "s"))
    return snaps.select("cell", "c_puct", "fpu", "fen", F.col("milestone").cast("int").alias("milestone"), "s.*")
