"""Match statistics: summaries, ratings, gates, resign rates and advantage curves."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curate.functions.base import ColumnLike, col, cols
from curate.functions.scores import elo_diff, phase, win_advantage
from curate.operators.ranking import ordered_rank
from curate.operators.skew import running

# Fixed values.
Z95 = 1.96
ELO_CAP = 800.0
GATE_MIN_SCORE = 10.5
MIN_CURVE_GAMES = 3
LIKELIHOOD_DROP = 1.92
GRID_LOW, GRID_HIGH, GRID_STEP = 0, 4000, 1
COARSE = 50


def match_summary(df: DataFrame, by, score: str = "points") -> DataFrame:
    """Games, W-D-L, points, score, sample variance, standard error, 95% interval, rating difference and verdict.

    One game has variance 0; no game has no row. elo is NULL at scores 0 and 1.
    """
    s = F.col(score)
    n = F.count(s)
    base = df.groupBy(*cols(by)).agg(
        n.alias("games"),
        F.count_if(s == 1.0).alias("wins"),
        F.count_if(s == 0.5).alias("draws"),
        F.count_if(s == 0.0).alias("losses"),
        F.sum(s).alias("points"),
        F.avg(s).alias("score"),
        F.coalesce(F.var_samp(s), F.lit(0.0)).alias("variance"),
    )
    summary = (
        base.where(F.col("games") > 0)
        .withColumn("se", F.sqrt(F.col("variance") / F.col("games")))
        .withColumn("ci_low", F.col("score") - Z95 * F.col("se"))
        .withColumn("ci_high", F.col("score") + Z95 * F.col("se"))
        .withColumn("elo", elo_diff("score"))
    )
    verdict = (
        F.when(F.col("ci_low") > 0.5, "A stronger").when(F.col("ci_high") < 0.5, "B stronger").otherwise("not significant")
    )
    return summary.withColumn("verdict", verdict)


def order_labels(df: DataFrame, label: str = "label", place: str | None = None) -> DataFrame:
    """Digit labels by their number, then the other labels in text order; ``place`` names a column for their place from 1."""
    numeric = F.col(label).rlike("^[0-9]+$")
    order = [numeric.desc(), F.when(numeric, F.col(label)).try_cast("long").asc(), F.col(label).asc()]
    return df.orderBy(*order) if place is None else ordered_rank(df, [], order, place)


def gauntlet(df: DataFrame, label: str = "label", score: str = "points", cap: float = ELO_CAP) -> DataFrame:
    """One record per opponent with the rating difference clamped to +-cap, in label order."""
    record = match_summary(df, label, score).select(label, "games", "wins", "draws", "losses", "score")
    return order_labels(record.withColumn("elo", elo_diff("score", cap)), label)


def running_score(df: DataFrame, match, order: str, score: str = "points") -> DataFrame:
    """Add points and games so far, and their ratio, per match."""
    rows = running(df, match, order, {"points_so_far": ("sum", F.col(score)), "games_so_far": ("count", F.col(score))})
    return rows.withColumn("score_so_far", F.col("points_so_far") / F.when(F.col("games_so_far") > 0, F.col("games_so_far")))


def _log_likelihood(matches: Column, rating: Column) -> Column:
    def one(acc: Column, m: Column) -> Column:
        gap = (m["anchor"] - rating) / 400.0
        win = -F.log1p(F.pow(F.lit(10.0), gap))
        loss = -F.log1p(F.pow(F.lit(10.0), -gap))
        return acc + m["points"] * win + (m["games"] - m["points"]) * loss

    return F.aggregate(matches, F.lit(0.0), one)


def _curve(low: ColumnLike, high: ColumnLike, step: int) -> Column:
    """Likelihoods on a grid, as (ll, -rating, rating): the maximum is the likeliest, the lowest on a tie."""
    grid = F.sequence(col(low), col(high), F.lit(step))
    return F.transform(
        grid,
        lambda r: F.struct(
            _log_likelihood(F.col("_matches"), r.cast("double")).alias("ll"), (-r).alias("neg"), r.alias("rating")
        ),
    )


def anchor_totals(df: DataFrame, by, anchor: str = "anchor", score: str = "points") -> DataFrame:
    """Games and points per (player, anchor): all that a rating fit needs, at most one row per anchor level."""
    return df.groupBy(*cols(by), anchor).agg(
        F.count(score).cast("double").alias("games"), F.sum(score).cast("double").alias("points")
    )


def anchored_elo(
    df: DataFrame,
    by,
    anchor: str = "anchor",
    score: str = "points",
    low: int = GRID_LOW,
    high: int = GRID_HIGH,
    step: int = GRID_STEP,
    method: str = "grid",
) -> DataFrame:
    """One rating per player by the logistic likelihood of its results against rated anchors.

    method "grid": best grid rating, and the interval of grid ratings whose log-likelihood is within
    1.92 of the best; ``at_edge`` marks intervals that the grid's ends may have cut. The likelihood is concave, so a coarse grid brackets the maximum and both interval
    ends, and the fine grid is evaluated inside the brackets only; the result is that of the full grid.
    method "newton": the exact maximum and its curvature standard error, solved per player in pandas over
    at most one row per anchor; NULL for all-win and all-loss records, which have no finite maximum, and
    where the steps do not settle.
    """
    by = cols(by)
    totals = anchor_totals(df, by, anchor, score)
    if method == "newton":
        return _newton(totals, by, anchor)
    if method != "grid":
        raise ValueError(f"unknown method {method!r}")
    one = F.struct(F.col(anchor).cast("double").alias("anchor"), "games", "points")
    players = totals.groupBy(*by).agg(
        F.array_sort(F.collect_list(one)).alias("_matches"),
        F.sum("games").cast("long").alias("games"),
        F.sum("points").alias("points"),
    )
    lo, hi, wide = F.lit(low), F.lit(high), COARSE * step
    coarse = players.withColumn("_coarse", _curve(lo, hi, wide))
    near = F.array_max("_coarse")["rating"]
    fine = coarse.withColumn("_near", near).withColumn(
        "_fine", _curve(F.greatest(F.col("_near") - wide, lo), F.least(F.col("_near") + wide, hi), step)
    )
    best = fine.withColumn("_best", F.array_max("_fine")).withColumn("_cut", F.col("_best.ll") - LIKELIHOOD_DROP)
    rating, cut = F.col("_best.rating"), F.col("_cut")
    below = F.filter("_coarse", lambda c: (c["ll"] < cut) & (c["rating"] < rating))
    above = F.filter("_coarse", lambda c: (c["ll"] < cut) & (c["rating"] > rating))
    edges = best.withColumns({"_below": F.array_max(_ratings(below)), "_above": F.array_min(_ratings(above))})
    low_from = F.coalesce("_below", lo)
    high_to = F.coalesce("_above", hi)
    last_coarse = F.lit(low + (high - low) // wide * wide)
    high_from = F.greatest(F.coalesce(F.col("_above") - wide, last_coarse), rating)
    interval = edges.withColumns(
        {
            "_lows": _curve(low_from, F.least(low_from + wide, rating), step),
            "_highs": _curve(F.least(high_from, high_to), high_to, step),
        }
    )
    rows = interval.select(
        *by,
        "games",
        "points",
        rating.alias("rating"),
        F.array_min(_ratings(F.filter("_lows", lambda c: c["ll"] >= cut))).alias("ci_low"),
        F.array_max(_ratings(F.filter("_highs", lambda c: c["ll"] >= cut))).alias("ci_high"),
    )
    last = low + (high - low) // step * step
    return rows.withColumn("at_edge", (F.col("ci_low") == low) | (F.col("ci_high") == last))


def _ratings(curve: Column) -> Column:
    return F.transform(curve, lambda c: c["rating"])


def _newton(totals: DataFrame, by: list[str], anchor: str) -> DataFrame:
    fields = {f.name: f.dataType.simpleString() for f in totals.schema.fields}
    schema = ", ".join(f"{b} {fields[b]}" for b in by) + ", rating double, std_error double"

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        slope = 2.302585092994046 / 400.0
        games, points, anchors = rows["games"].to_numpy(), rows["points"].to_numpy(), rows[anchor].to_numpy()
        keys = rows[by].iloc[[0]].reset_index(drop=True)
        if points.sum() <= 0 or points.sum() >= games.sum():
            return keys.assign(rating=float("nan"), std_error=float("nan"))
        rating = float((anchors * games).sum() / games.sum())
        for _ in range(100):
            expected = 1.0 / (1.0 + 10.0 ** ((anchors - rating) / 400.0))
            gradient = slope * (points - games * expected).sum()
            curvature = slope**2 * (games * expected * (1.0 - expected)).sum()
            move = max(-400.0, min(400.0, gradient / curvature))
            rating += move
            if abs(move) < 1e-10 * max(1.0, abs(rating)):
                return keys.assign(rating=rating, std_error=curvature**-0.5)
        return keys.assign(rating=float("nan"), std_error=float("nan"))

    solved = totals.groupBy(*by).applyInPandas(solve, schema)
    return solved.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in ("rating", "std_error")})


def gate(df: DataFrame, iteration: str = "iteration", score: str = "points", min_score: float = GATE_MIN_SCORE, start: int = 0) -> DataFrame:
    """Candidate points per iteration, accepted or not, and the generation after it."""
    totals = df.groupBy(iteration).agg(F.sum(score).alias("cand_score"))
    judged = totals.withColumn("accepted", F.col("cand_score") >= min_score)
    counted = running(judged, [], iteration, {"_accepted": ("sum", F.col("accepted").cast("long"))})
    return counted.withColumn("generation", F.lit(start) + F.col("_accepted")).drop("_accepted")


def advantage_curve(
    df: DataFrame, game: str, move_no: str, cp: ColumnLike, a_is_white: ColumnLike, by=(), min_games: int = MIN_CURVE_GAMES
) -> DataFrame:
    """Mean winning advantage of A per move number, over the positions of at least ``min_games`` games.

    Rows are first reduced to one sum per (game, move), so the game count needs no distinct set.
    """
    oriented = F.when(col(a_is_white), win_advantage(cp)).otherwise(-win_advantage(cp))
    per_game = df.groupBy(*cols(by), move_no, game).agg(F.sum(oriented).alias("_sum"), F.count(F.lit(1)).alias("_n"))
    curve = per_game.groupBy(*cols(by), move_no).agg(
        F.count(F.lit(1)).alias("games"), (F.sum("_sum") / F.sum("_n")).alias("advantage")
    )
    return curve.where(F.col("games") >= min_games)


def phase_advantage(df: DataFrame, cp: ColumnLike, a_is_white: ColumnLike, pieces: ColumnLike, by=()) -> DataFrame:
    """Mean winning advantage of A per game phase."""
    oriented = F.when(col(a_is_white), win_advantage(cp)).otherwise(-win_advantage(cp))
    return df.groupBy(*cols(by), phase(pieces).alias("phase")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.avg(oriented).alias("advantage")
    )


def resign_fp(ledger: DataFrame, by=()) -> DataFrame:
    """Of the played-out games in which resigning would have fired: the share that side did not lose."""
    fired = F.col("resign_playout") & F.col("would_resign_side").isNotNull()
    lost = F.when(F.col("would_resign_side") == "white", F.col("result") == "0-1").otherwise(F.col("result") == "1-0")
    return ledger.groupBy(*cols(by)).agg(
        F.count_if(F.col("resign_playout")).alias("playout_games"),
        F.count_if(fired).alias("fired"),
        F.count_if(fired & ~lost).alias("false_positives"),
        (F.count_if(fired & ~lost) / F.when(F.count_if(fired) > 0, F.count_if(fired))).alias("fp_rate"),
    )
