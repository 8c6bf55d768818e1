"""Parameter sweeps and throughput runs: metrics per configuration, paired differences, disagreements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from curate.functions.base import cols
from curate.operators.joins import CP_CAP, paired
from curate.operators.reports import share


def _percent(flag: Column) -> Column:
    return 100.0 * share(flag)


def cell_metrics(df: DataFrame, by=("cell", "milestone"), cap: int = CP_CAP) -> DataFrame:
    """Loss, blunder, rank, visit and time figures per cell and milestone, over scored choices.

    Rows without a score are left out. The exact median is over integer losses of at most ``cap``, so
    its partial state is a short value-count table whatever the number of rows.
    """
    loss = F.least(F.col("cp_loss_raw"), F.lit(cap))
    rows = df.where(F.col("cp_loss_raw").isNotNull()).withColumn("_loss", loss)
    return rows.groupBy(*cols(by)).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("_loss").alias("mean_cp"),
        F.median("_loss").alias("med_cp"),
        (100.0 * F.avg("esc_loss")).alias("esc_loss"),
        _percent(F.col("cp_loss_raw") > 100).alias("blun100"),
        _percent(F.col("cp_loss_raw") > 300).alias("blun300"),
        _percent(F.col("rank") == 1).alias("top1"),
        _percent(F.col("rank") <= 3).alias("top3"),
        F.avg("rank").alias("mean_rank"),
        (100.0 * F.avg("topvis")).alias("topvis"),
        F.avg("elapsed").alias("elapsed"),
    )


def paired_delta(df: DataFrame, baseline: str, cell: str = "cell", on="position", value: str = "cp_loss") -> DataFrame:
    """Per cell against the baseline on common positions: pairs, mean delta, better / worse / tie; best first.

    A pair is a (cell, position): repeated measurements are averaged first.
    """
    means = df.groupBy(cell, *cols(on)).agg(F.avg(value).alias(value))
    pairs = paired(means, baseline, cell, on, value)
    out = pairs.groupBy(cell).agg(
        F.count(F.lit(1)).alias("npair"),
        F.avg("delta").alias("mean_delta"),
        F.count_if(F.col("delta") < 0).alias("better"),
        F.count_if(F.col("delta") > 0).alias("worse"),
        F.count_if(F.col("delta") == 0).alias("tie"),
    )
    return out.orderBy("mean_delta", cell)


def best_milestone(metrics: DataFrame, cell: str = "cell", milestone: str = "milestone", value: str = "mean_cp") -> DataFrame:
    """Per cell its lowest value and the first milestone that has it, the place among the cells, and whether the
    last milestone is the best. ``metrics`` has one row per (cell, milestone) of the grid."""
    per_cell = metrics.groupBy(cell).agg(
        F.min(F.struct(F.col(value).alias("v"), F.col(milestone).alias("m"))).alias("_best"),
        F.max(milestone).alias("last_milestone"),
    )
    rows = per_cell.select(
        cell,
        F.col("_best.m").alias("best_milestone"),
        F.col("_best.v").alias("best_value"),
        "last_milestone",
        (F.col("_best.m") == F.col("last_milestone")).alias("last_is_best"),
    )
    return rows.withColumn("place", F.row_number().over(Window.orderBy("best_value", cell)))


def best_cell_trend(metrics: DataFrame, cell: str = "cell", milestone: str = "milestone", value: str = "mean_cp") -> DataFrame:
    """The value per milestone of the cell with the lowest value anywhere."""
    best = best_milestone(metrics, cell, milestone, value).where(F.col("place") == 1).select(cell)
    return metrics.join(F.broadcast(best), cell, "left_semi").select(cell, milestone, value).orderBy(milestone)


def throughput(df: DataFrame, config: str = "batch", cap: int = CP_CAP) -> DataFrame:
    """Per configuration: searches, searches per second, losses, top-k counts, and the speed-up over the first one."""
    loss = F.when(F.col("cp_loss").isNotNull(), F.least(F.col("cp_loss"), F.lit(cap)))
    rows = df.withColumn("_loss", loss)
    out = rows.groupBy(config).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("sims").alias("mean_sims"),
        (F.sum("sims") / F.sum("seconds")).alias("sims_per_s"),
        F.avg("_loss").alias("mean_cp"),
        F.median("_loss").alias("med_cp"),
        F.count_if(F.col("rank") <= 1).alias("top1"),
        F.count_if(F.col("rank") <= 3).alias("top3"),
        F.count_if(F.col("rank") <= 10).alias("top10"),
        F.avg("rank").alias("mean_rank"),
        (100.0 * F.avg("top_visit_frac")).alias("topvis"),
    )
    first = Window.orderBy(config).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return out.withColumn("speed_up", F.col("sims_per_s") / F.first("sims_per_s").over(first))


def disagreements(df: DataFrame, position: str = "position", config: str = "batch", move: str = "move", details=("rank", "cp_loss")) -> DataFrame:
    """Positions on which the configurations chose different moves, with each one's choice.

    A configuration that was measured repeatedly on a position chose its most frequent move there (of equals the
    least), with the least details. A position's list is thus as long as the list of configurations. Positions
    without disagreement are dropped before any list is built; rows without a move count for nothing.
    """
    seen = df.where(F.col(move).isNotNull()).groupBy(position, config, move)
    seen = seen.agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct(*details)).alias("_d"))
    best = F.min(F.struct((-F.col("_n")).alias("n"), F.col(move).alias("m"), F.col("_d").alias("d")))
    chosen = seen.groupBy(position, config).agg(best.alias("_best"))
    chosen = chosen.select(position, config, F.col("_best.m").alias(move), *[F.col(f"_best.d.{c}").alias(c) for c in details])
    span = chosen.groupBy(position).agg(F.min(move).alias("_a"), F.max(move).alias("_b"))
    differ = span.where(F.col("_a") != F.col("_b")).select(position)
    entry = F.struct(config, F.struct(move, *details).alias("choice"))
    rows = chosen.join(differ, position, "left_semi")
    return rows.groupBy(position).agg(
        F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("choices"),
        F.count_distinct(move).alias("n_moves"),
    )
