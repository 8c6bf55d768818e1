"""Class labels from results, tablebase scores and outcomes; soft label blends."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from curate.functions.base import ColumnLike, col

# Class codes, source ids, theme words.
WIN, DRAW, LOSS = 0, 1, 2
CLASS_NAMES = ("win", "draw", "loss")
SOURCE_IDS = {"game": 0, "puzzle": 1, "tablebase": 2}
POOL_PREFIXES = {"pool_games": "game", "pool_puzzles": "puzzle", "pool_tablebase": "tablebase"}
PRIORITY_THEMES = ("mate", "endgame")
BLEND = 0.5


def wdl_class(result: ColumnLike, turn: ColumnLike) -> Column:
    """Result string and side to move ('w'/'b') -> 0 win, 1 draw, 2 loss; other results NULL."""
    winner = F.when(col(result) == "1-0", "w").when(col(result) == "0-1", "b")
    return (
        F.when(col(result) == "1/2-1/2", DRAW)
        .when(winner == col(turn), WIN)
        .when(winner != col(turn), LOSS)
    )


def tb_class(score: ColumnLike) -> Column:
    """Tablebase score -2..2 -> class; the 50-move results (+1, -1) count as draws."""
    return F.when(col(score) >= 2, WIN).when(col(score) <= -2, LOSS).when(col(score).isNotNull(), DRAW)


def outcome_onehot(value: ColumnLike) -> Column:
    """1 / 0 / -1 -> one-hot [win, draw, loss]; any other value -> all zero."""
    return F.array(*[F.when(col(value) == v, 1.0).otherwise(0.0) for v in (1, 0, -1)])


def class_onehot(cls: ColumnLike) -> Column:
    return F.array(*[F.when(col(cls) == k, 1.0).otherwise(0.0) for k in (WIN, DRAW, LOSS)])


def wdl_scalar(values: ColumnLike) -> Column:
    """Value-head vector -> scalar in [-1, 1]: w - l; one-element vectors pass through."""
    v = col(values)
    return (
        F.when(F.size(v) == 3, F.get(v, F.lit(0)) - F.get(v, F.lit(2)))
        .when(F.size(v) == 1, F.get(v, F.lit(0)))
        .when(
            F.size(v) >= 0,
            F.raise_error(F.concat(F.lit("value vector of size "), F.size(v))).cast("double"),
        )
    )


def wdl_expect(values: ColumnLike) -> Column:
    """[w, d, l] -> expected score w + d/2."""
    v = col(values)
    return F.get(v, F.lit(0)) + 0.5 * F.get(v, F.lit(1))


def blend(cls: ColumnLike, w: ColumnLike, d: ColumnLike, l: ColumnLike, lam: float = BLEND) -> Column:
    """(1-lam) * one-hot(class) + lam * annotation shares; the pure one-hot where w is NULL."""
    hot = class_onehot(cls)
    total = F.greatest((col(w) + col(d) + col(l)).cast("double"), F.lit(1e-9))
    share = F.array(col(w) / total, col(d) / total, col(l) / total)
    mixed = F.zip_with(hot, share, lambda h, s: (1.0 - lam) * h + lam * s)
    return F.when(col(w).isNull(), hot).otherwise(mixed)


def source_of(path: ColumnLike) -> Column:
    """Source name from the name of the pool's file, or of its folder where the pool is a set of part files.

    A name of no known prefix is an error.
    """
    last = F.element_at(F.split(col(path), "/"), -1)
    folder = F.regexp_extract(col(path), r"/(pool_[^/]*)/[^/]*$", 1)
    name = F.when(folder == "", last).otherwise(folder)
    out = None
    for prefix, source in POOL_PREFIXES.items():
        hit = name.startswith(prefix)
        out = F.when(hit, source) if out is None else out.when(hit, source)
    return out.when(
        name.isNotNull(),
        F.raise_error(F.concat(F.lit("unknown pool file: "), name)).cast("string"),
    )


def source_id(source: ColumnLike) -> Column:
    out = F.lit(None).cast("int")
    for name, number in SOURCE_IDS.items():
        out = F.when(col(source) == name, number).otherwise(out)
    return out


def is_priority(themes: ColumnLike, words=PRIORITY_THEMES) -> Column:
    """True where the themes text holds any of the words (case-sensitive substring)."""
    hit = F.lit(False)
    for word in words:
        hit = hit | col(themes).contains(word)
    return hit
