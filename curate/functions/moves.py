"""UCI move text as column expressions, and the table of policy indices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from curate.functions.base import ColumnLike, col

# Plane layout of the 8 x 8 x 73 policy tensor, steps as (rank, file).
N_PLANES = 73
SLIDE_STEPS = [(1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1)]
KNIGHT_STEPS = [(2, 1), (1, 2), (-1, 2), (-2, 1), (-2, -1), (-1, -2), (1, -2), (2, -1)]
KNIGHT_BASE, PROMOTION_BASE = 56, 64
PROMOTION_PIECES = "nbr"
INDEX_ROWS = 1858


def mirror_uci(uci: ColumnLike) -> Column:
    """Flip the ranks of a move, keep its promotion letter; applied twice it is the identity."""
    return F.translate(col(uci), "12345678", "87654321")


def _steps(uci: ColumnLike) -> tuple[Column, Column, Column, Column]:
    def part(i: int, base: str) -> Column:
        return F.ascii(F.substring(col(uci), i, 1)) - F.ascii(F.lit(base))

    file, rank = part(1, "a"), part(2, "1")
    return rank, file, part(4, "1") - rank, part(3, "a") - file


def _lookup(table: dict[int, int], size: int, code: Column) -> Column:
    """A literal table by position; NULL for codes without an entry."""
    cells = F.array(*[F.lit(table.get(i)).cast("int") for i in range(size)])
    return F.get(cells, code.cast("int"))


def policy_plane(uci: ColumnLike, strict: bool = True) -> Column:
    """Plane 0-72 of a move in the mover's frame: 56 sliding, 8 knight, 9 under-promotion planes.

    A null move, a move along no line, or another promotion letter is an error (NULL if not strict).
    """
    _, _, dr, df = _steps(uci)
    far = F.greatest(F.abs(dr), F.abs(df))
    direction = _lookup(
        {(r + 1) * 3 + f + 1: i for i, (r, f) in enumerate(SLIDE_STEPS)}, 9, (F.signum(dr) + 1) * 3 + F.signum(df) + 1
    )
    straight = (dr == 0) | (df == 0) | (F.abs(dr) == F.abs(df))
    jump = _lookup({(r + 2) * 5 + f + 2: i for i, (r, f) in enumerate(KNIGHT_STEPS)}, 25, (dr + 2) * 5 + df + 2)
    slot = F.position(F.substring(col(uci), 5, 1), F.lit(PROMOTION_PIECES)) - 1
    plane = (
        F.when(F.length(col(uci)) == 5, F.when((slot >= 0) & (F.abs(df) <= 1), PROMOTION_BASE + 3 * (df + 1) + slot))
        .when(straight, direction * 7 + far - 1)
        .when(far == 2, KNIGHT_BASE + jump)
    )
    if not strict:
        return plane.cast("int")
    message = F.concat(F.lit("no policy plane for move "), col(uci))
    return F.coalesce(plane, F.when(col(uci).isNotNull(), F.raise_error(message).cast("int"))).cast("int")


def gather_index(uci: ColumnLike, strict: bool = True) -> Column:
    """Flat cell of a move in the row-major (rank, file, plane) policy tensor."""
    rank, file, _, _ = _steps(uci)
    return (rank * (8 * N_PLANES) + file * N_PLANES + policy_plane(uci, strict)).cast("int")


def _square(number: Column) -> Column:
    return F.concat(F.char(F.lit(97) + number % 8), (F.floor(number / 8) + 1).cast("string"))


def move_index(spark: SparkSession) -> DataFrame:
    """(move_idx, uci): 1456 sliding, 336 knight and 66 under-promotion moves, 1858 in all.

    Block by block; inside a block by source square a1..h8, then by descending target square, then by
    promotion letter r, b, n. A fixed table, so the one ordering window is over 1858 rows.
    """
    pairs = spark.range(64 * 64).select(
        F.floor(F.col("id") / 64).cast("int").alias("src"), (F.col("id") % 64).cast("int").alias("dst")
    )
    dr = F.floor(F.col("dst") / 8) - F.floor(F.col("src") / 8)
    df = F.col("dst") % 8 - F.col("src") % 8
    line = (F.col("src") != F.col("dst")) & ((dr == 0) | (df == 0) | (F.abs(dr) == F.abs(df)))
    knight = F.abs(dr * df) == 2
    promotes = (F.floor(F.col("src") / 8) == 6) & (dr == 1) & (F.abs(df) <= 1)
    base = F.concat(_square(F.col("src")), _square(F.col("dst")))
    block = F.explode(
        F.filter(
            F.array(
                F.struct(line.alias("on"), F.lit(0).alias("block"), F.lit(0).alias("piece"), base.alias("uci")),
                F.struct(knight.alias("on"), F.lit(1).alias("block"), F.lit(0).alias("piece"), base.alias("uci")),
                *[
                    F.struct(
                        promotes.alias("on"),
                        F.lit(2).alias("block"),
                        F.lit(i).alias("piece"),
                        F.concat(base, F.lit(letter)).alias("uci"),
                    )
                    for i, letter in enumerate("rbn")
                ],
            ),
            lambda m: m["on"],
        )
    )
    rows = pairs.select("src", "dst", block.alias("m"))
    # A pawn's captures come before its push: higher targets first, the push last.
    push_last = F.when((F.col("m.block") == 2) & (df == 0), 1).otherwise(0)
    order = Window.orderBy("m.block", "src", push_last, F.desc("dst"), "m.piece")
    return rows.select((F.row_number().over(order) - 1).alias("move_idx"), F.col("m.uci").alias("uci"))


def index_key(uci: ColumnLike, turn: ColumnLike) -> Column:
    """The look-up text of a move: mirrored when black moves, a queen promotion without its letter."""
    seen = F.when(col(turn) == "b", mirror_uci(uci)).otherwise(col(uci))
    return F.regexp_replace(seen, "q$", "")


def with_move_idx(
    df: DataFrame, uci: str = "uci", turn: str = "turn", name: str = "move_idx"
) -> DataFrame:
    """Add the policy index of a move; NULL where the move has none. The index side is 1858 rows."""
    index = move_index(df.sparkSession).select(F.col("move_idx").alias(name), F.col("uci").alias("_index_key"))
    keyed = df.withColumn("_index_key", index_key(uci, turn))
    return keyed.join(F.broadcast(index), "_index_key", "left").drop("_index_key")
