"""Operators over ordered rows of a game, puzzle line, conversation or any keyed sequence.

``key`` names the sequence, ``order`` an integer position that is unique within it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curate.functions.base import ColumnLike, col, cols
from curate.functions.labels import LOSS, WIN, is_priority, wdl_class
from curate.operators.ranking import top_per_group
from curate.operators.skew import SPAN, join_unique, running

# Fixed values.
TEMPERATURE_PLIES = 30
RESIGN_STREAK = 4
FIFTY_MOVES, REPEAT_FLOOR, THREEFOLD = 100, 8, 3


def explode_plies(games: DataFrame, moves: str = "moves", result: str = "result") -> DataFrame:
    """One row per played move: ply, move, side to move and side-relative class; no row for the end position."""
    rows = games.select(*[c for c in games.columns if c != moves], F.posexplode(moves).alias("ply", "move"))
    turn = F.when(F.col("ply") % 2 == 0, "w").otherwise("b")
    return rows.withColumn("turn", turn).withColumn("wdl", wdl_class(result, turn))


def explode_lines(df: DataFrame, moves: str = "moves", themes: str | None = None, want_defenders: bool = True) -> DataFrame:
    """Puzzle lines to steps: step 0 sets up and goes, odd steps are the solver's (win), even ones the defender's (loss).

    Defender steps are kept only where wanted and, if a themes column is named, only for priority
    puzzles. Lines of fewer than two moves give nothing.
    """
    lines = df.where(F.size(moves) >= 2)
    defender = F.lit(want_defenders)
    if themes is not None:
        # Judged per line, before the steps are made, so no step carries the themes text for it.
        lines = lines.withColumn("_priority", is_priority(themes))
        defender = defender & F.col("_priority")
    rows = lines.select(*[c for c in lines.columns if c != moves], F.posexplode(moves).alias("step", "move"))
    solver = F.col("step") % 2 == 1
    return (
        rows.where((F.col("step") >= 1) & (solver | defender))
        .withColumn("role", F.when(solver, "solver").otherwise("defender"))
        .withColumn("wdl", F.when(solver, WIN).otherwise(LOSS))
        .drop("_priority")
    )


def take_while_valid(df: DataFrame, key, order: str, ok: ColumnLike) -> DataFrame:
    """Rows before the first one that is not ok (or NULL); later rows of that sequence go."""
    key = cols(key)
    bad = df.where(~F.coalesce(col(ok), F.lit(False))).groupBy(*key).agg(F.min(order).alias("_bad"))
    marked = join_unique(df, bad, key)
    return marked.where(F.col("_bad").isNull() | (F.col(order) < F.col("_bad"))).drop("_bad")


def complete_only(df: DataFrame, key, order: str, terminal: ColumnLike, valid: ColumnLike | None = None) -> DataFrame:
    """All rows of the sequences whose last row is terminal and, if asked, whose every row is valid."""
    key = cols(key)
    last = F.max_by(F.coalesce(col(terminal), F.lit(False)), order)
    whole = last if valid is None else last & F.min(F.coalesce(col(valid), F.lit(False)))
    kept = df.groupBy(*key).agg(whole.alias("_whole")).where("_whole").drop("_whole")
    return join_unique(df, kept, key, "left_semi")


def with_position(df: DataFrame, key, order: str, name: str = "i", span: int = SPAN) -> DataFrame:
    """Add the 1-based position of each row in its sequence."""
    return running(df, key, order, {name: ("count", F.lit(1))}, span)


def assign_targets(df: DataFrame, key, order: str, result: str, turn: str, span: int = SPAN) -> DataFrame:
    """value_target (+1/0/-1 for the mover) and moves_left_target (n for the first of n rows, 1 for the last)."""
    white = F.when(F.col(result) == "1-0", 1.0).when(F.col(result) == "0-1", -1.0).otherwise(0.0)
    value = F.when(white == 0, 0.0).when(F.col(turn) == "w", white).otherwise(-white)
    # Counting from the end needs neither the length nor the position of a row.
    backwards = running(df.withColumn("_back", -F.col(order)), key, "_back", {"moves_left_target": ("count", F.lit(1))}, span)
    return backwards.withColumn("value_target", value).drop("_back")


def resign_events(
    df: DataFrame, key, order: str, q: ColumnLike, turn: str, threshold: float, k: int = RESIGN_STREAK, span: int = SPAN
) -> DataFrame:
    """(key, fire_at, side): the first row that ends k rows in a row, of either side, with q below the threshold."""
    key = cols(key)
    low = F.coalesce(col(q) < threshold, F.lit(False))
    marked = running(df.withColumn("_low", low), key, order, {"_reset": ("max", F.when(~F.col("_low"), F.col(order)))}, span)
    # Low rows with the same last reset form one streak; its k-th row is where it fires.
    kth = top_per_group(marked.where("_low"), [*key, "_reset"], [order], k, "_nth").where(F.col("_nth") == k)
    return kth.groupBy(*key).agg(F.min(order).alias("fire_at"), F.min_by(turn, order).alias("side"))


def truncate_at(df: DataFrame, events: DataFrame, key, order: str, playout: str | None = None) -> DataFrame:
    """Drop the rows from the firing row on, except in sequences marked as played out."""
    key = cols(key)
    marked = join_unique(df, events.select(*key, "fire_at"), key)
    keep = F.col("fire_at").isNull() | (F.col(order) < F.col("fire_at"))
    if playout is not None:
        keep = keep | F.col(playout)
    return marked.where(keep).drop("fire_at")


def repetition(df: DataFrame, key, position: str, order: str, span: int = SPAN) -> DataFrame:
    """Add ``seen``: how often the row's position has occurred in its sequence so far, this row included."""
    return running(df, [*cols(key), position], order, {"seen": ("count", F.lit(1))}, span)


def claimable_draw(clock: ColumnLike, seen: ColumnLike) -> Column:
    return (col(clock) >= FIFTY_MOVES) | ((col(clock) >= REPEAT_FLOOR) & (col(seen) >= THREEFOLD))


def game_status(
    df: DataFrame,
    clock: str,
    seen: str,
    insufficient: ColumnLike,
    mate: ColumnLike,
    stalemate: ColumnLike,
    ply: str | None = None,
    max_plies: int | None = None,
) -> DataFrame:
    """Add ``status`` (first rule that holds) and ``claimable`` draw flag; the ply cap comes last, as a draw."""
    status = (
        F.when(col(mate), "checkmate")
        .when(col(stalemate), "stalemate")
        .when(F.col(clock) >= FIFTY_MOVES, "fifty_move")
        .when(F.col(seen) >= THREEFOLD, "threefold")
        .when(col(insufficient), "insufficient")
    )
    if max_plies is not None:
        status = status.when(F.col(ply) >= max_plies, "ply_cap")
    return df.withColumn("status", status.otherwise("ongoing")).withColumn("claimable", claimable_draw(clock, seen))


def with_temperature(df: DataFrame, ply: str = "ply", n: int = TEMPERATURE_PLIES) -> DataFrame:
    return df.withColumn("temperature", F.when(F.col(ply) < n, 1.0).otherwise(0.0))


def best_candidate(
    df: DataFrame, position: str, move: str, own: str, after: str, dtz: str, seen: str, mate: str
) -> DataFrame:
    """One move per position: a mate first; a winner keeps the win with the nearest zeroing, unvisited first on a
    tie; a loser takes the longest resistance; anything else the first move.

    ``own`` is the mover's tablebase score before, ``after`` the mover's score after the move.
    """
    keeps = (F.col(own) >= 2) & (F.col(after) >= 2)
    loses = F.col(own) <= -2
    tier = F.when(F.col(mate), 0).when(keeps | loses, 1).otherwise(2)
    distance = F.when(keeps, F.abs(F.col(dtz))).when(loses, -F.abs(F.col(dtz))).otherwise(0)
    repeat = F.when(keeps, F.col(seen).cast("int")).otherwise(0)
    nearest = F.when(tier == 1, distance).otherwise(0)
    again = F.when(tier == 1, repeat).otherwise(0)
    return top_per_group(df, position, [tier, nearest, again, move], 1, "_rank").drop("_rank")


def visit_distribution(edges: DataFrame, position, move: str, n: str, temperature: float = 1.0) -> DataFrame:
    """Add ``prob``: N^(1/T) over its sum; T=0 all on the most visited (first on a tie); no visits -> uniform."""
    position = cols(position)
    if temperature == 0:
        facts = edges.groupBy(*position).agg(F.min(F.struct((-F.col(n)).alias("_n"), F.col(move).alias("_m"))).alias("_best"))
        rows = join_unique(edges, facts, position)
        return rows.withColumn("prob", (F.col(move) == F.col("_best._m")).cast("double")).drop("_best")
    weight = F.col(n).cast("double") if temperature == 1 else F.pow(F.col(n).cast("double"), 1.0 / temperature)
    facts = edges.groupBy(*position).agg(F.sum(weight).alias("_sum"), F.count(F.lit(1)).alias("_edges"))
    rows = join_unique(edges, facts, position)
    prob = F.when(F.col("_sum") == 0, 1.0 / F.col("_edges")).otherwise(weight / F.col("_sum"))
    return rows.withColumn("prob", prob).drop("_sum", "_edges")


def paired_schedule(openings: DataFrame, opening: str, mode: str = "paired") -> DataFrame:
    """Games of a match: each opening once with A white and once with A black.

    mode "halves": one game per opening; A is white in the first half of the openings (``opening`` then
    is their number 0..n-1).
    """
    if mode == "paired":
        return openings.withColumn("a_is_white", F.explode(F.array(F.lit(True), F.lit(False))))
    total = openings.agg(F.count(F.lit(1))).scalar()
    return openings.withColumn("a_is_white", F.col(opening) < F.floor(total / 2))


def sweep_grid(c_values: DataFrame, fpu_values: list, done: DataFrame, c: str = "c_puct", fpu: str = "fpu") -> DataFrame:
    """Every (c, fpu) cell that is not done yet; a NULL fpu is a value of its own. ``fpu_values`` is a short list."""
    options = F.array(*[F.lit(v).cast("double") for v in fpu_values])
    grid = c_values.select(F.col(c)).distinct().withColumn(fpu, F.explode(options))
    finished = done.select(F.col(c).alias("_c"), F.col(fpu).alias("_f")).distinct()
    match = grid[c].eqNullSafe(F.col("_c")) & grid[fpu].eqNullSafe(F.col("_f"))
    return grid.join(finished, match, "left_anti")
