"""Filters over game tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curate.sources.games import RESULTS

# Fixed values.
MIN_ELO, MIN_PLIES = 2700, 8


def filter_games(
    df: DataFrame,
    min_elo: int = MIN_ELO,
    white: str = "white_elo",
    black: str = "black_elo",
    result: str = "result",
    event: str | None = "event",
    skip_event: str = "%Bullet%",
    moves: str | None = None,
    min_plies: int = MIN_PLIES,
) -> DataFrame:
    """Games of two strong players with a known result, without one kind of event; where a moves column is named,
    of ``min_plies`` moves at least. Unknown ratings do not pass; an unknown event is not one to skip."""
    keep = (F.col(white) >= min_elo) & (F.col(black) >= min_elo) & F.col(result).isin(*RESULTS[:3])
    if event is not None:
        keep = keep & ~F.coalesce(F.col(event).ilike(skip_event), F.lit(False))
    if moves is not None:
        keep = keep & (F.size(moves) >= min_plies)
    return df.where(keep)
