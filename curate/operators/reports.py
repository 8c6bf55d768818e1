"""Aggregates over predictions, targets and pools: audits of labels and models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curate.functions.base import ColumnLike, col, cols
from curate.functions.scores import phase
from curate.functions.vectors import argmax, entropy, hard_ce

# Fixed values.
MIN_SEGMENT_ROWS = 25
CALIBRATION_BINS = 10
WEIGHT_FLOOR = 1e-9


def share(flag: Column) -> Column:
    return F.avg(flag.cast("double"))


def total(name: str) -> Column:
    """1 on the row of all values of ``name``, 0 on the row of one value, NULL included."""
    return F.grouping(name).cast("int").alias("overall")


def composition(df: DataFrame, chunk: str = "chunk_id", source: str = "source", cls: str = "wdl") -> DataFrame:
    """Rows per chunk x source x class with every total; ``level`` tells a total from a NULL value (0: no total).

    Rows are counted once per cell; only the cells are copied for the totals.
    """
    cells = df.groupBy(chunk, source, cls).agg(F.count(F.lit(1)).alias("_n"))
    return cells.cube(chunk, source, cls).agg(F.grouping_id().alias("level"), F.sum("_n").alias("n_rows"))


def coverage(df: DataFrame, by=(), value: str = "w") -> DataFrame:
    """Rows that carry a soft label, and their percentage."""
    return df.groupBy(*cols(by)).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count(value).alias("n_soft"),
        F.round(100.0 * F.count(value) / F.greatest(F.count(F.lit(1)), F.lit(1)), 6).alias("percent"),
    )


def agreement_matrix(df: DataFrame, outcome: str = "wdl", w: str = "w", d: str = "d", l: str = "l") -> DataFrame:
    """Outcome class against the annotation's likeliest class.

    One row per outcome class plus a total (``overall`` 1): counts per annotated class, the share judged
    drawn and the share that agrees. Rows without an annotation do not count.
    """
    judged = argmax(F.array(w, d, l))
    rows = df.where(F.col(w).isNotNull()).select(F.col(outcome).alias("outcome"), judged.alias("judged"))
    counts = [F.count_if(F.col("judged") == k).alias(n) for k, n in enumerate(("judged_win", "judged_draw", "judged_loss"))]
    # The grouping column is NULL on the total row, so agreement is computed before the rollup.
    flagged = rows.withColumn("agrees", F.col("outcome") == F.col("judged"))
    return flagged.rollup("outcome").agg(
        total("outcome"),
        F.count(F.lit(1)).alias("n_rows"),
        *counts,
        share(F.col("judged") == 1).alias("share_drawn"),
        share(F.col("agrees")).alias("agreement"),
    )


def group_report(df: DataFrame, by, probs: str = "probs", cls: str = "true_cls") -> DataFrame:
    """Per group: n, mean W/D/L, argmax shares, mean probability of the true class, share of true argmax."""
    p = [F.get(F.col(probs), F.lit(k)) for k in range(3)]
    best = argmax(probs)
    rows = df.select(
        *cols(by),
        *[v.alias(f"_p{k}") for k, v in enumerate(p)],
        best.alias("_best"),
        F.get(F.col(probs), F.col(cls)).alias("_true"),
        (best == F.col(cls)).alias("_hit"),
    )
    names = ("win", "draw", "loss")
    return rows.groupBy(*cols(by)).agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.avg(f"_p{k}").alias(f"mean_{n}") for k, n in enumerate(names)],
        *[share(F.col("_best") == k).alias(f"argmax_{n}") for k, n in enumerate(names)],
        F.avg("_true").alias("p_true"),
        share(F.col("_hit")).alias("acc"),
    )


def segment_table(
    df: DataFrame, by, probs: str = "probs", group: str | None = None, prefix: str = "draw", min_n: int = MIN_SEGMENT_ROWS
) -> DataFrame:
    """Per segment of the drawn groups: n, mean P(draw), share with argmax = draw; segments of min_n rows or more, largest first."""
    rows = df if group is None else df.where(F.col(group).startswith(prefix))
    out = rows.groupBy(*cols(by)).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.avg(F.get(F.col(probs), F.lit(1))).alias("p_draw"),
        share(argmax(probs) == 1).alias("acc"),
    )
    return out.where(F.col("n_rows") >= min_n).orderBy(F.desc("n_rows"), *cols(by))


def calibration(df: DataFrame, p: ColumnLike, hit: ColumnLike, bins: int = CALIBRATION_BINS, by=()) -> DataFrame:
    """Equal-width bins of p (the last includes 1): n, mean p and actual share.

    Empty bins have no row. Rows without p or hit, and rows whose p is not a number from 0 to 1, are in no bin.
    """
    b = F.least(F.floor(col(p) * bins), F.lit(bins - 1)).cast("int")
    rows = df.select(*cols(by), b.alias("bin"), col(p).alias("_p"), col(hit).cast("double").alias("_hit"))
    # NaN compares as larger than 1.
    rows = rows.where("_p >= 0 and _p <= 1 and _hit is not null and not isnan(_hit)")
    return rows.groupBy(*cols(by), "bin").agg(
        F.count(F.lit(1)).alias("n_rows"), F.avg("_p").alias("mean_p"), F.avg("_hit").alias("actual")
    )


def ece(df: DataFrame, p: ColumnLike, hit: ColumnLike, bins: int = CALIBRATION_BINS, by=()) -> DataFrame:
    """Expected calibration error: the bins' absolute gaps, weighted by their rows."""
    gap = F.col("n_rows") * F.abs(F.col("mean_p") - F.col("actual"))
    table = calibration(df, p, hit, bins, by)
    return table.groupBy(*cols(by)).agg((F.sum(gap) / F.sum("n_rows")).alias("ece"), F.sum("n_rows").alias("n_rows"))


def value_ce(df: DataFrame, by=(), probs: str = "probs", cls: str = "true_cls") -> DataFrame:
    """Mean cross-entropy on the true class and argmax accuracy, over the rows whose class and probabilities are known."""
    return df.where(hard_ce(cls, probs).isNotNull()).groupBy(*cols(by)).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.avg(hard_ce(cls, probs)).alias("value_ce"),
        share(argmax(probs) == F.col(cls)).alias("acc"),
    )


def agreement(df: DataFrame, predicted: ColumnLike, reference: ColumnLike, pieces: ColumnLike) -> DataFrame:
    """Mean absolute error and correlation of two expected scores: ``overall`` 1 for all rows, and per phase.

    The correlation is NULL where one side does not vary.
    """
    rows = df.select(col(predicted).alias("_p"), col(reference).alias("_r"), phase(pieces).alias("phase"))
    return rows.rollup("phase").agg(
        total("phase"),
        F.count(F.lit(1)).alias("n_rows"),
        F.avg(F.abs(F.col("_p") - F.col("_r"))).alias("mae"),
        F.try_divide(F.covar_pop("_p", "_r"), F.stddev_pop("_p") * F.stddev_pop("_r")).alias("corr"),
    )


def weighted_metrics(
    df: DataFrame, source: str = "source", ploss="ploss", pmatch="pmatch", vloss="vloss", vmatch="vmatch", weight="weight"
) -> DataFrame:
    """Loss and accuracy over all rows (``overall`` 1) and per source, in one pass.

    The policy loss divides by the row count, the policy accuracy by the weight sum: rows without a
    move dilute the first and do not touch the second.
    """
    rows = df.select(
        F.col(source).alias("source"),
        (F.col(ploss) * F.col(weight)).alias("_pl"),
        (F.col(pmatch).cast("double") * F.col(weight)).alias("_pm"),
        F.col(weight).alias("_w"),
        F.col(vloss).alias("_vl"),
        F.col(vmatch).cast("double").alias("_vm"),
    )
    n = F.count(F.lit(1))
    out = rows.rollup("source").agg(
        total("source"),
        n.alias("n_rows"),
        (F.sum("_pl") / F.greatest(n, F.lit(1))).alias("policy_loss"),
        (F.sum("_pm") / F.greatest(F.sum("_w"), F.lit(WEIGHT_FLOOR))).alias("policy_acc"),
        F.avg("_vl").alias("value_loss"),
        F.avg("_vm").alias("value_acc"),
    )
    return out.withColumn("loss", F.col("policy_loss") + F.col("value_loss"))


def entropy_floor(df: DataFrame, target: str, loss: ColumnLike, source: str = "source") -> DataFrame:
    """Mean target entropy over all rows (``overall`` 1) and per source, and the excess of the loss over it."""
    rows = df.select(F.col(source).alias("source"), entropy(target).alias("_h"), col(loss).alias("_loss"))
    out = rows.rollup("source").agg(
        total("source"), F.count(F.lit(1)).alias("n_rows"), F.avg("_h").alias("floor"), F.avg("_loss").alias("loss")
    )
    return out.withColumn("excess", F.col("loss") - F.col("floor"))


def ledger_totals(
    df: DataFrame, by=(), result: str = "result", positions: str = "n_positions", skipped: str = "n_skipped", seconds: str = "seconds", moves: str = "n_moves"
) -> DataFrame:
    """Games, positions, skipped positions, results and mean seconds per move."""
    return df.groupBy(*cols(by)).agg(
        F.count(F.lit(1)).alias("games"),
        F.sum(positions).alias("positions"),
        F.sum(skipped).alias("skipped"),
        F.count_if(F.col(result) == "1-0").alias("white_wins"),
        F.count_if(F.col(result) == "0-1").alias("black_wins"),
        F.count_if(F.col(result) == "1/2-1/2").alias("draws"),
        (F.sum(seconds) / F.when(F.sum(moves) > 0, F.sum(moves))).alias("seconds_per_move"),
    )


def batch_stats(df: DataFrame, by=(), rows: str = "n_rows", hits: str = "hits") -> DataFrame:
    """Scoring calls, rows, mean batch, cache hits and misses; one input row per call."""
    return df.groupBy(*cols(by)).agg(
        F.count(F.lit(1)).alias("calls"),
        F.sum(rows).alias("rows"),
        F.avg(rows).alias("mean_batch"),
        F.sum(hits).alias("hits"),
        (F.sum(rows) - F.sum(hits)).alias("misses"),
    )
