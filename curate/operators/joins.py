"""Look-ups, annotation joins, work lists, exclusions and comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curate.functions.base import ColumnLike, col, cols
from curate.functions.scores import expected_score
from curate.operators.ranking import dedupe_first
from curate.operators.skew import join_unique
from curate.sources.tables import BUCKETS

# Fixed values.
SKIP_SOURCES = (2,)
LR_STEPS = ((0.0, 1e-4), (0.7, 1e-5), (0.9, 1e-6))
CP_CAP = 1000

ANNOTATION = ("w", "d", "l")


def annotatable(source: str, skip) -> Column:
    """Whether a row's source is annotated; rows of an unknown source are."""
    return ~F.coalesce(F.col(source).isin(*skip), F.lit(False)) if skip else F.lit(True)


def one_per_key(annotations: DataFrame, key, values, order=None, depth: int | None = None) -> DataFrame:
    """(key..., values...): of each key the first annotation by ``order``, else the one of least values; of one search depth if asked for."""
    key, values = cols(key), cols(values)
    rows = annotations if depth is None else annotations.where(F.col("depth") == depth)
    return dedupe_first(rows, key, cols(order) if order is not None else values).select(*key, *values)


def join_annotations(
    df: DataFrame, annotations: DataFrame, key="fen", source: str = "source_id", skip=SKIP_SOURCES, values=ANNOTATION, order=None, depth: int | None = None
) -> DataFrame:
    """Left join of the annotation values; rows of a skipped source stay without.

    Values from an earlier join are dropped first, so a second run refreshes them and adds nothing. A key that is annotated
    several times counts once (``one_per_key``: say by ``order`` which was written first), so no row is ever multiplied.
    Rows of an unknown source are annotated; a NULL key matches nothing. ``depth`` picks one search depth out of several.
    """
    key = cols(key)
    base = df.drop(*values)
    joined = join_unique(base, one_per_key(annotations, key, values, order, depth).hint("shuffle_hash"), key)
    wanted = annotatable(source, skip)
    return joined.withColumns({v: F.when(wanted, F.col(v)) for v in values})


def join_store(df: DataFrame, table: str, key="fen", source: str = "source_id", skip=SKIP_SOURCES, values=ANNOTATION, buckets: int | None = None) -> DataFrame:
    """``join_annotations`` with the bucketed table of ``save_store``: one shuffle, of ``df`` alone, into the table's buckets.

    The table holds one row per key, so nothing is dropped or counted again. Say ``buckets`` if it was not saved with the default
    number. A table of measured small size is broadcast instead. For keys without a hot one: the table's side is not shuffled, so
    adaptive execution cannot split a bucket; ``join_annotations`` can.
    """
    key = cols(key)
    base = df.drop(*values).repartition(buckets or BUCKETS, *key)
    joined = base.join(df.sparkSession.table(table).select(*key, *values), key, "left")
    wanted = annotatable(source, skip)
    return joined.withColumns({v: F.when(wanted, F.col(v)) for v in values}).select(*[c for c in df.columns if c not in values], *values)


def annotation_report(joined: DataFrame, source: str = "source_id", skip=SKIP_SOURCES, value: str = "w") -> DataFrame:
    """hit, miss and hit percent over the annotatable rows, those of an unknown source included."""
    rows = joined.where(annotatable(source, skip))
    hit = F.count(value)
    total = F.count(F.lit(1))
    return rows.agg(
        hit.alias("hit"),
        (total - hit).alias("miss"),
        F.round(100.0 * hit / F.greatest(total, F.lit(1)), 6).alias("percent"),
    )


def worklist(
    df: DataFrame, annotations: DataFrame, key="fen", order: list | None = None, source: str = "source_id", skip=SKIP_SOURCES, depth: int | None = None
) -> DataFrame:
    """(key, order...) of the distinct keys still to annotate, each at its first occurrence.

    Sorting the result by the order columns gives first-seen order. Copies are cut before the
    difference, so both sides hold a key once. Rows of an unknown source are on the list; keys that hold a NULL are not. With
    ``depth`` only annotations of that search depth count as done.
    """
    order, key = order or [], cols(key)
    wanted = df.where(annotatable(source, skip)) if source else df
    first = dedupe_first(wanted.select(*key, *order).dropna(subset=key), key, order or key)
    done = annotations if depth is None else annotations.where(F.col("depth") == depth)
    return first.join(done.select(*key), key, "left_anti")


def worklist_report(df: DataFrame, annotations: DataFrame, key="fen", approximate: bool = False) -> DataFrame:
    """rows, unique keys and keys left to do; the unique count can be approximate. Keys may be annotated several times."""
    key = cols(key)
    per_key = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    marked = per_key.join(annotations.select(*key).distinct().withColumn("_done", F.lit(1)), key, "left")
    unique = F.approx_count_distinct(F.struct(*key)) if approximate else F.count(F.lit(1))
    return marked.agg(
        F.sum("_n").alias("n_rows"),
        unique.alias("n_unique"),
        F.sum(F.when(F.col("_done").isNull(), 1).otherwise(0)).alias("n_todo"),
    )


def exclude_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose id is not held out."""
    return df.join(ids.select(key), key, "left_anti")


def skipped_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """How many rows and ids the exclusion removes."""
    gone = df.join(ids.select(key), key, "left_semi")
    return gone.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("rows_skipped"), F.count(F.lit(1)).alias("ids_skipped")
    )


def score_choice(
    choices: DataFrame, suite: DataFrame, position="position", move: str = "move", cp_cap: int = CP_CAP, strict: bool = True
) -> DataFrame:
    """Score chosen moves by the suite: rank, raw and capped centipawn loss, expected-score loss.

    ``suite`` holds (position, move, cp, rank, best_cp), one row per move; a chosen move that it holds twice is an error. A
    move the suite does not hold is an error, or a row with ``found`` false if not strict; it is never scored 0.

    A suite's moves come out of arrays, and what comes out of an array is planned with the size of the array's table. The join is
    therefore asked to merge: by that size a suite of millions of rows would be collected for a broadcast.
    """
    key = [*cols(position), move]
    facts = suite.groupBy(*key).agg(F.min(F.struct("cp", "rank", "best_cp")).alias("_f"), F.count(F.lit(1)).alias("_times"))
    twice = F.concat(F.lit("move twice in the suite: "), F.concat_ws(" ", *[F.col(k).cast("string") for k in key]))
    joined = join_unique(choices, facts.hint("merge"), key)
    joined = joined.withColumns({v: F.col(f"_f.{v}") for v in ("rank", "best_cp")})
    joined = joined.withColumn("cp", F.when(F.col("_times") > 1, F.raise_error(twice).cast("int")).otherwise(F.col("_f.cp"))).drop("_f", "_times")
    raw = F.col("best_cp") - F.col("cp")
    if strict:
        message = F.concat(F.lit("move not in the suite: "), F.concat_ws(" ", *[F.col(k).cast("string") for k in key]))
        raw = F.when(F.col("cp").isNull(), F.raise_error(message).cast("int")).otherwise(raw)
    else:
        joined = joined.withColumn("found", F.col("cp").isNotNull())
    scored = joined.withColumn("cp_loss_raw", raw)
    return (
        scored.withColumn("cp_loss", F.least(F.col("cp_loss_raw"), F.when(F.col("cp_loss_raw").isNotNull(), cp_cap)))
        .withColumn("esc_loss", expected_score("best_cp") - expected_score("cp"))
        .drop("cp", "best_cp")
    )


def paired(df: DataFrame, baseline: str, cell: str = "cell", on="position", value: str = "cp_loss") -> DataFrame:
    """Every other cell's rows next to the baseline's value on the same position; common positions only.

    Rows without a value pair with nothing. Repeated measurements of the baseline on a position count as their mean;
    those of the other cells are rows of their own.
    """
    on = cols(on)
    known = df.where(F.col(value).isNotNull())
    base = known.where(F.col(cell) == baseline).groupBy(*on).agg(F.avg(value).alias("base_value"))
    others = known.where(F.col(cell) != baseline)
    joined = join_unique(others, base, on, "inner")
    return joined.withColumn("delta", F.col(value) - F.col("base_value"))


def compare_runs(a: DataFrame, b: DataFrame) -> DataFrame:
    """(metric, value) of two runs side by side: every metric of a, b's value and the difference where b has it."""
    left = a.select("metric", F.col("value").alias("value_a"))
    right = b.select("metric", F.col("value").alias("value_b"))
    return left.join(right, "metric", "left").withColumn("delta", F.col("value_b") - F.col("value_a"))


def asof_step(df: DataFrame, fraction: ColumnLike, steps=LR_STEPS, name: str = "step_value") -> DataFrame:
    """Add the value of the last step whose threshold is not above the fraction; below all, the first value.

    ``steps`` is a short (threshold, value) schedule, so it becomes a literal array and no join.
    """
    ordered = sorted(steps)
    table = F.array(*[F.struct(F.lit(float(t)).alias("at"), F.lit(float(v)).alias("value")) for t, v in ordered])
    reached = F.filter(table, lambda s: s["at"] <= col(fraction))
    value = F.coalesce(F.get(reached, F.size(reached) - 1)["value"], F.lit(float(ordered[0][1])))
    return df.withColumn(name, value)


def join_predictions(df: DataFrame, predictions: DataFrame, key: str, seq: str, values) -> DataFrame:
    """Inner join of predictions by key; of several for one key the last by ``seq`` counts."""
    values = cols(values)
    last = predictions.groupBy(key).agg(F.max(F.struct(seq, *values)).alias("_p"))
    facts = last.select(key, *[F.col(f"_p.{v}").alias(v) for v in values])
    return join_unique(df, facts, key, "inner")


def pending(df: DataFrame, done: DataFrame, key: str = "label", force: bool = False, only: list | None = None) -> DataFrame:
    """Rows still to run: not done yet unless forced, and among the named labels if any are."""
    wanted = df.where(F.col(key).isin(*only)) if only is not None else df
    return wanted if force else wanted.join(done.select(key), key, "left_anti")


def check_compat(have: DataFrame, want: DataFrame) -> DataFrame:
    """(field, have, want) for every wanted field whose recorded value differs; NULL equals NULL only."""
    h = have.select("field", F.col("value").alias("have"))
    w = want.select("field", F.col("value").alias("want"))
    return w.join(h, "field", "left").where(~F.col("have").eqNullSafe(F.col("want"))).select("field", "have", "want")


def missing_annotations(work: DataFrame, annotations: DataFrame, key: str = "fen") -> DataFrame:
    """done and missing counts of a work list."""
    marked = work.select(key).join(annotations.select(key).distinct().withColumn("_done", F.lit(1)), key, "left")
    return marked.agg(
        F.count("_done").alias("done"), (F.count(F.lit(1)) - F.count("_done")).alias("missing")
    )


def require_complete(work: DataFrame, annotations: DataFrame, key: str = "fen") -> None:
    """Raise unless every key of the work list is annotated; a partial run must not be joined."""
    missing = work.select(key).join(annotations.select(key), key, "left_anti").count()
    if missing:
        raise ValueError(f"{missing} keys are not annotated yet; join after the annotation run is complete")
