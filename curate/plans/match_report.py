"""Per-game results to the match report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from curate.operators.matches import anchored_elo, gauntlet, match_summary, running_score


@dataclass
class MatchReport:
    summary: DataFrame
    curve: DataFrame
    progress: DataFrame
    rating: DataFrame | None


def match_report(games: DataFrame, opponent: str, order: str, score: str = "points", anchor: str | None = None, player: str | None = None) -> MatchReport:
    """Summary and gauntlet record per opponent, running score, and the anchored rating where anchors are given."""
    rating = None if anchor is None else anchored_elo(games, player, anchor, score)
    return MatchReport(
        match_summary(games, opponent, score),
        gauntlet(games, opponent, score),
        running_score(games, opponent, order, score),
        rating,
    )
