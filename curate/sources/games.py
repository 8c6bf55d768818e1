"""Multi-game text files (headers in brackets, then the moves): one row per game."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from curate.functions.base import let

# Header order of written games, results.
TAGS = ("Event", "Site", "Date", "Round", "White", "Black", "Result")
RESULTS = ("1-0", "0-1", "1/2-1/2", "*")
GAME_BREAK = "\n[Event "
#: A header line after a line of moves, blank lines between them or not.
NEXT_GAME = r'(\n(?!\[\w+\s+")[^\s][^\n]*)\n\s*(?=\[\w+\s+")'
HEADER_BLOCK = r"^((?:\s*\[[^\n]*(?:\n|$))*)"
HEADER = r'(?m)^\[(\w+)\s+"(.*?)"\]\s*$'
UNKNOWN = "?"


def _header_map(text: Column) -> Column:
    """All header pairs of a game; of a repeated header the last counts."""
    pairs = F.struct(
        F.regexp_extract_all(text, F.lit(HEADER), F.lit(1)).alias("k"),
        F.regexp_extract_all(text, F.lit(HEADER), F.lit(2)).alias("v"),
    )

    def build(p: Column) -> Column:
        def last(key: Column) -> Column:
            return F.get(p["v"], F.size(p["v"]) - F.array_position(F.reverse(p["k"]), key).cast("int"))

        names = F.array_distinct(p["k"])
        return F.map_from_arrays(names, F.transform(names, last))

    return let(pairs, build)


def _head(texts: DataFrame) -> DataFrame:
    return texts.withColumn("head", F.regexp_extract("text", HEADER_BLOCK, 1))


def _columns() -> list[Column]:
    """headers and movetext of a game's text with its header block."""
    moves = F.substring(F.col("text"), F.length("head") + 1, F.length("text"))
    return [_header_map(F.col("head")).alias("headers"), F.trim(moves, F.lit(" \n\t")).alias("movetext")]


def _known(games: DataFrame) -> DataFrame:
    """The games that have headers and moves, with their result."""
    result = F.col("headers")["Result"]
    known = F.when(result.isin(*RESULTS), result).otherwise("*")
    return games.where((F.size("headers") > 0) & (F.col("movetext") != "")).select("headers", known.alias("result"), "movetext", "file")


def _parsed(texts: DataFrame) -> DataFrame:
    return _known(_head(texts).select(*_columns(), "file"))


def _fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines of a task put together to games, or parts of games at the ends of a split.

    A part says whether it surely begins a game (``starts`` 1), surely not (0), or begins one if moves came before it (NULL),
    whether it surely ends there, and what the last line of weight in it is (``last`` 1: moves, 0: header, NULL: none).
    """
    import pyarrow.compute as pc

    names = ["file", "block", "idx", "text", "starts", "ends", "last"]
    types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.bool_(), pa.int32()]
    place, idx, held, starts, last, headed = None, 0, [], 0, None, False

    def part(ends: bool) -> tuple:
        return (*place, idx, "\n".join(held), starts, ends, last)

    def grouped(made: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in made], t) for i, t in enumerate(types)], names=names)

    for batch in batches:
        value = pc.replace_substring_regex(batch.column("value"), r"^%.*$", "")
        lines, n = value.to_pylist(), batch.num_rows
        header = pc.match_substring_regex(value, r'^\[\w+\s+"').to_numpy(zero_copy_only=False)
        moves = pc.match_substring_regex(value, r"^\S").to_numpy(zero_copy_only=False) & ~header
        # The last line of weight before each line.
        heavy = np.maximum.accumulate(np.where(header | moves, np.arange(n), -1)) if n else np.zeros(0, int)
        where = list(zip(batch.column("file").to_pylist(), batch.column("block").to_pylist(), strict=True))
        splits = [i for i in range(n) if i == 0 or where[i] != where[i - 1]]
        made = []
        for lo, hi in zip(splits, [*splits[1:], n], strict=True):
            if where[lo] != place:
                if held:
                    made.append(part(False))
                place, idx, held, starts, last, headed = where[lo], 0, [], 0, None, False
            at = lo
            for h in (lo + np.flatnonzero(header[lo:hi])).tolist():
                k = heavy[h - 1] if h > lo else -1
                before = int(moves[k]) if k >= lo else last
                if before != 1 and headed:
                    continue
                # The first header of a split begins a game if moves stand before it, here or in the split before.
                held += lines[at:h]
                if k >= at:
                    last = int(moves[k])
                if held:
                    made.append(part(before == 1))
                    idx += 1
                held, starts, last, headed, at = [], 1 if before == 1 else None, None, True, h
            held += lines[at:hi]
            if heavy[hi - 1] >= at:
                last = int(moves[heavy[hi - 1]])
        if made:
            yield grouped(made)
    if held:
        yield grouped([part(False)])


def _by_line(spark: SparkSession, paths) -> DataFrame:
    """(text, file) of every game, from files that Spark splits at lines.

    A task puts the games inside its split together; only the parts at the ends of splits, at most three per split, meet again,
    in the order of their file.
    """
    lines = spark.read.text(paths).select(
        F.make_valid_utf8("value").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")
    )
    parts = lines.mapInArrow(_fragments, "file string, block long, idx long, text string, starts int, ends boolean, last int")
    whole = (F.col("starts") == 1) & F.col("ends")
    inside = parts.where(F.coalesce(whole, F.lit(False))).select("text", "file")
    order = Window.partitionBy("file").orderBy("block", "idx")
    ends = parts.where(~F.coalesce(whole, F.lit(False)))
    before = F.last("last", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    # A header at the start of a file begins a game; a game that ended inside its split ends with moves.
    begins = F.when(F.col("starts").isNotNull(), F.col("starts")).otherwise(F.when(F.coalesce(before, F.lit(1)) == 1, 1).otherwise(0))
    told = ends.withColumn("begins", begins)
    told = told.withColumn("game", F.sum("begins").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    joined = told.groupBy("file", "game").agg(F.array_sort(F.collect_list(F.struct("block", "idx", "text"))).alias("p"))
    return inside.unionByName(joined.select(F.array_join(F.transform("p", lambda x: x["text"]), "\n").alias("text"), "file"))


def read_games(spark: SparkSession, paths, event_first: bool = True) -> DataFrame:
    """One row per game: headers map, result, movetext, file.

    Files split over tasks at headers named Event; inside such a stretch a game begins at any header after moves. A header
    block that an Event header interrupts (Event not first) is an error, as its games would be cut apart. Bytes that are no
    UTF-8 are replaced; lines starting with % are comments; text without headers or moves is skipped. A result that is
    none of the four known ones becomes '*'.

    Files whose games begin with other headers (or none named Event at all) would be one task each: with ``event_first`` false
    files are split at any line, and a game begins at any header after moves, wherever the split fell.
    """
    if not event_first:
        return _parsed(_by_line(spark, paths))
    raw = spark.read.option("lineSep", GAME_BREAK).text(paths).select(
        F.make_valid_utf8("value").alias("value"), F.col("_metadata.file_path").alias("file")
    )
    clean = F.regexp_replace(F.regexp_replace("value", "\r\n", "\n"), r"(?m)^%.*$", "")
    headless = ~F.ltrim(clean).startswith("[")
    # The break swallowed the first header's opening, except at the start of a file.
    text = F.when(F.col("_starts"), clean).otherwise(F.concat(F.lit("[Event "), clean))
    rows = raw.withColumn("_starts", F.ltrim(F.regexp_replace("value", r"(?m)^%.*$", "")).rlike(r'^\s*\[\w+\s+"'))
    rows = rows.where(F.col("_starts") | (headless & F.col("value").rlike(r'^"')))
    each = F.split(F.regexp_replace(text, NEXT_GAME, "$1\u0001"), "\u0001")
    parsed = _head(rows.select(F.explode(each).alias("text"), "file"))
    games = parsed.select(*_columns(), "file")
    torn = (F.size("headers") > 0) & (F.col("movetext") == "") & F.col("headers")["Event"].isNull()
    wrong = F.raise_error(F.concat(F.lit("headers without moves, or before Event, in "), F.col("file"))).cast("string")
    games = games.withColumn("movetext", F.when(torn, wrong).otherwise(F.col("movetext")))
    return _known(games)


def _drop_variations(text: Column) -> Column:
    """Remove bracketed side lines of any depth: keep what stands at depth 0."""
    # The innermost lines go first, so there are as many rounds as brackets are deep, each in proportion to the text.
    brackets = F.split(F.regexp_replace(text, "[^()]+", ""), "")
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("deepest"))

    def step(acc: Column, bracket: Column) -> Column:
        depth = F.when(bracket == "(", acc["depth"] + 1).when(bracket == ")", F.greatest(acc["depth"] - 1, F.lit(0))).otherwise(acc["depth"])
        return F.struct(depth.alias("depth"), F.greatest(acc["deepest"], depth).alias("deepest"))

    deepest = F.aggregate(brackets, start, step, lambda acc: acc["deepest"])
    rounds = F.sequence(F.lit(0), deepest)
    inner = F.aggregate(rounds, text, lambda kept, _: F.regexp_replace(kept, r"\([^()]*+\)", ""))
    # A line that never ends takes the rest of the text; an end without a beginning is nothing.
    return F.translate(F.regexp_replace(inner, r"(?s)\(.*", ""), ")", "")


def with_moves(df: DataFrame, movetext: str = "movetext", name: str = "moves") -> DataFrame:
    """Add the main line as an array of moves: comments, side lines, numbers, glyphs and the result are removed."""
    text = F.regexp_replace(movetext, r"\{[^}]*\}", " ")
    text = F.regexp_replace(text, r"(?m);.*$", " ")
    text = F.when(F.contains(text, F.lit("(")), _drop_variations(text)).otherwise(text)
    text = F.regexp_replace(text, r"\$\d+", " ")
    text = F.regexp_replace(text, r"\d+\.+", " ")
    tokens = F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " ")
    moves = F.filter(tokens, lambda t: (t != "") & ~t.isin(*RESULTS))
    return df.withColumn(name, F.transform(moves, lambda t: F.regexp_replace(t, "[!?]+$", "")))


def numbered_moves(moves: Column) -> Column:
    """['e4', 'e5', 'Nf3'] -> '1. e4 e5 2. Nf3'."""
    numbered = F.transform(
        moves,
        lambda m, i: F.when(i % 2 == 0, F.concat((F.floor(i / 2) + 1).cast("string"), F.lit(". "), m)).otherwise(m),
    )
    return F.array_join(numbered, " ")


def game_text(headers: Column, moves: Column, result: Column) -> Column:
    """One game as text: the header block in tag order, a blank line, the moves and the result."""
    lines = [
        F.concat(F.lit(f"[{t} \""), F.coalesce(headers[t], F.lit(UNKNOWN)), F.lit('"]')) for t in TAGS if t != "Result"
    ]
    body = F.concat_ws(" ", F.nullif(numbered_moves(moves), F.lit("")), result)
    return F.concat(F.concat_ws("\n", *lines, F.concat(F.lit('[Result "'), result, F.lit('"]'))), F.lit("\n\n"), body, F.lit("\n"))


def write_games(df: DataFrame, path: str, summary: str | None = None) -> None:
    """Write games (headers, moves, result) as text; a match summary goes first in each file, in % lines."""
    games = df.select(game_text(F.col("headers"), F.col("moves"), F.col("result")).alias("value"))
    if summary is None:
        games.write.text(path)
        return
    comment = "\n".join(f"% {line}" for line in summary.splitlines()) + "\n\n"
    # The first row of every file carries the comment; its position in the file is fixed by the write itself.
    first = F.monotonically_increasing_id() % (1 << 33) == 0
    games.withColumn("value", F.when(first, F.concat(F.lit(comment), F.col("value"))).otherwise(F.col("value"))).write.text(path)
