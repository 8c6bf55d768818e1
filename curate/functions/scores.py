"""Centipawn, expected-score and rating arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from curate.functions.base import ColumnLike, col

# Fixed values.
MATE_CP = 32000
ADVANTAGE_SLOPE = 0.00368
OPENING_PIECES, MIDDLEGAME_PIECES = 25, 13
CHECKPOINT_ALL, CHECKPOINT_MID, CHECKPOINT_MID_EVERY, CHECKPOINT_EVERY = 12, 40, 4, 40


def clip_cp(cp: ColumnLike, mate: ColumnLike | None = None) -> Column:
    """Clip a score to +-32000; a non-zero mate distance counts as a full +-32000."""
    # least and greatest pass over NULL, so an unknown score is kept apart.
    clipped = F.when(col(cp).isNotNull(), F.greatest(F.least(col(cp), F.lit(MATE_CP)), F.lit(-MATE_CP)))
    if mate is None:
        return clipped
    return F.when(col(mate) > 0, MATE_CP).when(col(mate) < 0, -MATE_CP).otherwise(clipped)


def expected_score(cp: ColumnLike) -> Column:
    """1 / (1 + 10^(-cp/400)); with a rating difference in place of cp, the expected result."""
    return 1.0 / (1.0 + F.pow(F.lit(10.0), -col(cp) / 400.0))


def win_advantage(cp: ColumnLike) -> Column:
    """Winning advantage in percentage points, -50..50."""
    return 100.0 * (1.0 / (1.0 + F.exp(-ADVANTAGE_SLOPE * col(cp))) - 0.5)


def elo_diff(score: ColumnLike, cap: float | None = None) -> Column:
    """Rating difference from a score share. At 0 and 1: NULL, or +-cap where a cap is given."""
    s = col(score)
    inside = (s > 0) & (s < 1)
    raw = -400.0 * F.log10(1.0 / F.when(inside, s) - 1.0)
    if cap is None:
        return raw
    return (
        F.when(s <= 0, F.lit(-float(cap)))
        .when(s >= 1, F.lit(float(cap)))
        .when(inside, F.greatest(F.least(raw, F.lit(float(cap))), F.lit(-float(cap))))
    )


def points(result: ColumnLike, a_is_white: ColumnLike | None = None) -> Column:
    """White's points 1 / 0.5 / 0, or A's points where ``a_is_white`` tells A's colour."""
    white = F.when(col(result) == "1-0", 1.0).when(col(result) == "1/2-1/2", 0.5).when(col(result) == "0-1", 0.0)
    if a_is_white is None:
        return white
    return F.when(col(a_is_white), white).otherwise(1.0 - white)


def phase(pieces: ColumnLike) -> Column:
    """opening 25-32, middlegame 13-24, endgame 2-12 pieces; otherwise NULL."""
    p = col(pieces)
    return (
        F.when(p.between(OPENING_PIECES, 32), "opening")
        .when(p.between(MIDDLEGAME_PIECES, OPENING_PIECES - 1), "middlegame")
        .when(p.between(2, MIDDLEGAME_PIECES - 1), "endgame")
    )


def should_checkpoint(step: ColumnLike) -> Column:
    """Every step to 12, then each 4th to 40, then each 40th."""
    n = col(step)
    return (
        F.when(n <= CHECKPOINT_ALL, True)
        .when(n <= CHECKPOINT_MID, (n - CHECKPOINT_ALL) % CHECKPOINT_MID_EVERY == 0)
        .otherwise((n - CHECKPOINT_MID) % CHECKPOINT_EVERY == 0)
    )


def disagree(q: ColumnLike, raw: ColumnLike, floor: float = 0.15) -> Column:
    """Both values clear of zero by more than the floor, with opposite signs."""
    return (F.abs(col(q)) > floor) & (F.abs(col(raw)) > floor) & ((col(q) > 0) != (col(raw) > 0))
