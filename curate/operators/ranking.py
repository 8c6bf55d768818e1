"""Exact ranks without putting a group into one task, top-k and first-row picks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from curate.functions.base import ColumnLike, col, cols
from curate.functions.seeded import seeded_key
from curate.operators.skew import null_safe
from curate.storage import stage

DIGITS = 3
QUANTILES = 1000
CUT_MARGIN = 0.002
#: Quantiles of each level of ``select_first``.
STEPS = 200
PARTITION_BITS = 33


def _buckets(df: DataFrame, key, seed: int, digits: int) -> DataFrame:
    keyed = df.withColumn("_key", F.coalesce(seeded_key(seed, *cols(key)), F.lit("")))
    return keyed.withColumn("_bucket", F.substring("_key", 1, digits))


def seeded_histogram(df: DataFrame, by, key, seed: int, digits: int = DIGITS) -> DataFrame:
    """(by..., _bucket, _size): rows per group and hash prefix, at most groups x 16^digits rows.

    One map-combined pass over the group and key columns; the group sizes are its sums.
    """
    return _buckets(df, key, seed, digits).groupBy(*cols(by), "_bucket").agg(F.count(F.lit(1)).alias("_size"))


def seeded_rank(
    df: DataFrame,
    by,
    key,
    seed: int,
    keep: DataFrame | int | None = None,
    histogram: DataFrame | None = None,
    digits: int = DIGITS,
    name: str = "rank",
) -> DataFrame:
    """Rank rows 1..n within each of a few groups in the order of their seeded hash.

    Each group is cut by the first hex digits of the hash: the rank is the number of rows with a lower
    prefix plus the rank inside the prefix. Hashes are uniform, so the parts are even however large one
    group is: a window holds about a 4096th of its group (3 digits; 4 digits from some 10^12 rows on).
    With ``keep`` (one number, or by..., keep: one row per group, other groups are dropped) only ranks up to it are
    returned; prefixes beyond it, and groups without it, go before the shuffle. ``key`` must identify a
    row. ``digits`` must be the histogram's.
    """
    by = cols(by)
    sizes = seeded_histogram(df, by, key, seed, digits) if histogram is None else histogram
    lower = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    below = sizes.select(*by, "_bucket", F.coalesce(F.sum("_size").over(lower), F.lit(0)).alias("_below"))
    if keep is not None:
        if isinstance(keep, int):
            below = below.withColumn("_keep", F.lit(keep))
        else:
            below = null_safe(below, keep.select(*by, F.col("keep").alias("_keep")), by)
        below = below.where("_below < _keep")
    # At most groups x 16^digits narrow rows, whatever the size of df.
    placed = null_safe(_buckets(df, key, seed, digits), F.broadcast(below), [*by, "_bucket"])
    inside = Window.partitionBy(*by, "_bucket").orderBy("_key", *cols(key))
    ranked = placed.withColumn(name, F.col("_below") + F.row_number().over(inside))
    if keep is not None:
        ranked = ranked.where(F.col(name) <= F.col("_keep")).drop("_keep")
    return ranked.drop("_key", "_bucket", "_below")


def ordered_rank(df: DataFrame, by, order: list, name: str = "rank") -> DataFrame:
    """Rank rows 1..n within each group in any order, however large a group is.

    Rows are range-partitioned by (group, order) and numbered inside their partition; the staged table
    fixes those numbers. A group's rows in earlier partitions are counted from one row per (group,
    partition). ``order`` should be unique within a group, else ties are numbered arbitrarily.
    """
    by = cols(by)
    sort = [*[F.col(c).asc() for c in by], *[_sort(o) for o in order]]
    ranged = df.repartitionByRange(*sort).sortWithinPartitions(*sort)
    placed = stage(ranged.withColumn("_at", F.monotonically_increasing_id()), "ranked")
    placed = placed.withColumn("_part", F.shiftright("_at", PARTITION_BITS))
    pieces = placed.groupBy(*by, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_size"))
    earlier = Window.partitionBy(*(by or [F.lit(1)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    start = pieces.withColumn("_before", F.coalesce(F.sum("_size").over(earlier), F.lit(0))).drop("_size")
    ranked = null_safe(placed, start, [*by, "_part"])
    return ranked.withColumn(name, F.col("_before") + F.col("_at") - F.col("_first") + 1).drop(
        "_at", "_part", "_first", "_before"
    )


def cut_beyond(df: DataFrame, by, order: str, keep: Column) -> DataFrame:
    """Drop, before any shuffle of rows, nearly all rows that cannot be among the first ``keep`` of their group.

    One map-combined pass takes 1000 quantiles of the order column per group, each within a 10,000th of
    the group's rows of its place. The cut lies 2 of 1000 beyond the wanted share, well outside that
    error, so every wanted row stays and an exact rank of the rest decides. For a few groups (the limits
    are broadcast); ``keep`` may use the group columns. Columns without quantiles (text) pass uncut.
    """
    kind = df.schema[order].dataType
    if not isinstance(kind, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)):
        return df
    by = cols(by)
    places = ",".join(f"{i / QUANTILES}D" for i in range(1, QUANTILES + 1))
    quantiles = F.expr(f"percentile_approx(`{order}`, array({places}), {10 * QUANTILES})")
    stats = df.groupBy(*by).agg(F.count(order).alias("_n"), quantiles.alias("_places"))
    wanted = F.ceil(QUANTILES * (keep / F.greatest(F.col("_n"), F.lit(1)) + CUT_MARGIN))
    place = F.least(F.greatest(wanted, F.lit(1)), F.lit(QUANTILES)).cast("int")
    # Where the last place is wanted nothing may be cut. Quantiles are computed as doubles: wide numbers get the room
    # that the conversion may have cost.
    limit = F.when(wanted < QUANTILES, F.element_at("_places", place))
    limits = stats.where("_n > 0").select(*by, limit.alias("_limit"))
    marked = null_safe(df, F.broadcast(limits), by, "left")
    far = F.col("_limit")
    if isinstance(kind, (T.LongType, T.DecimalType)):
        far = far.cast("decimal(38,0)" if isinstance(kind, T.LongType) else kind)
        far = far + F.ceil(F.abs(F.col("_limit").cast("double")) / float(1 << 48)).cast("decimal(20,0)")
    within = F.col(order).isNull() | F.col("_limit").isNull() | F.coalesce(F.col(order) <= far, F.lit(True))
    return marked.where(within).drop("_limit")


def _number(df: DataFrame, name: str) -> Column:
    """A double that never falls where the column rises, so that rows of unlike numbers need no other comparison. NULL comes first.

    Texts give their first six bytes; types without an order-preserving number give 0, which tells nothing.
    """
    kind = df.schema[name].dataType
    if isinstance(kind, T.NumericType):
        number = F.col(name).cast("double")
    elif isinstance(kind, T.BooleanType):
        number = F.col(name).cast("int").cast("double")
    elif isinstance(kind, T.DateType):
        number = F.unix_date(name).cast("double")
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        number = F.unix_micros(F.col(name).cast("timestamp")).cast("double")
    elif isinstance(kind, T.StringType):
        start = F.rpad(F.hex(F.substring(F.col(name).cast("binary"), 1, 6)), 12, "0")
        number = F.conv(start, 16, 10).cast("double")
    else:
        number = F.when(F.col(name).isNotNull(), F.lit(0.0))
    return F.coalesce(number, F.lit(float("-inf")))


def select_first(df: DataFrame, by, order: list[str], keep: DataFrame, then: str | None = None, levels: int = 2) -> DataFrame:
    """The first ``keep`` rows of each of a few groups in any order, without ranking or shuffling the rows that surely win.

    ``keep`` is (by..., keep): one row per group; other groups are dropped. With ``then`` a group's rows with a
    lower value there come first (a few values: passes over the same quota). Each level takes 200 quantiles of the first order column,
    or of the next one where a tie sits on the quota, in one map-combined pass: rows below the quota's quantile by more
    than the quantiles' error win, rows above it by more go, and the next level looks at the rows between, some 9 of
    1000. Only what two levels leave between (some 80 of a million, and rows equal in both columns) is sorted. Nothing is
    written and no job runs while the plan is made. ``order`` should be unique within a group.
    """
    by, groups = cols(by), [*cols(by), *([then] if then else [])]
    places = ",".join(f"{i / STEPS}D" for i in range(1, STEPS))
    numbers = [_number(df, c) for c in order]
    # Which order column a group is cut by: the next one once a tie sits on the quota.
    rows = df.withColumn("_col", F.lit(0)).withColumn("_now", numbers[0]).withColumn("_edge", F.lit(True)).withColumn("_won", F.lit(False))
    for level in range(levels):
        # One pass: the quantiles between the limits, and how many rows have won so far.
        quantiles = F.expr(f"percentile_approx(case when _edge then _now end, array({places}), {10 * QUANTILES})")
        measures = [F.count_if("_edge").alias("_n"), F.count_if("_won").alias("_done"), quantiles.alias("_places")]
        stats = rows.groupBy(*groups).agg(*measures, *([F.max("_keep").alias("keep")] if level else []))
        if not level:
            stats = null_safe(stats, keep.select(*by, "keep"), by)
            if then:
                before = Window.partitionBy(*(by or [F.lit(1)])).orderBy(then).rowsBetween(Window.unboundedPreceding, -1)
                stats = stats.withColumn("keep", F.greatest(F.lit(0), F.col("keep") - F.coalesce(F.sum("_n").over(before), F.lit(0))))
        left = (F.col("keep") - F.col("_done")).cast("double")
        share = STEPS * left / F.greatest(F.col("_n"), F.lit(1))
        low, high = F.floor(share - STEPS * CUT_MARGIN), F.ceil(share + STEPS * CUT_MARGIN)

        def place(at: Column) -> Column:
            return F.element_at("_places", F.greatest(F.lit(1), F.least(at, F.lit(STEPS - 1))).cast("int"))

        limits = stats.select(
            *groups,
            *([] if level else [F.col("keep").alias("_keep")]),
            (left >= F.col("_n")).alias("_all"),
            F.when(low >= 1, place(low)).alias("_low"),
            F.when(high < STEPS, place(high)).alias("_high"),
            (left <= 0).alias("_none"),
        )
        # A row per group and pass.
        marked = null_safe(rows, F.broadcast(limits), groups)
        wins = F.col("_edge") & ~F.col("_none") & (F.col("_all") | F.coalesce(F.col("_now") < F.col("_low"), F.lit(False)))
        open_ = F.col("_edge") & ~F.col("_none") & ~wins & F.coalesce(F.col("_now") <= F.col("_high"), F.lit(True))
        column = F.col("_col") + F.when(F.col("_low") == F.col("_high"), 1).otherwise(0)
        follow = numbers[-1]
        for i in reversed(range(len(numbers) - 1)):
            follow = F.when(column == i, numbers[i]).otherwise(follow)
        rows = marked.select(*df.columns, "_keep", column.alias("_col"), follow.alias("_now"), open_.alias("_edge"), (F.col("_won") | wins).alias("_won")).where("_won or _edge")
    lefts = rows.groupBy(*groups).agg((F.max("_keep") - F.count_if("_won")).alias("_left"))
    inside = Window.partitionBy(*(groups or [F.lit(1)])).orderBy(*order)
    edge = null_safe(rows.where("_edge").withColumn("_rank", F.row_number().over(inside)), F.broadcast(lefts), groups)
    return rows.where("_won").select(*df.columns).unionByName(edge.where("_rank <= _left").select(*df.columns))


def _sort(o: ColumnLike) -> Column:
    return F.col(o).asc() if isinstance(o, str) else o


def top_per_group(df: DataFrame, by, order: list, k: int, name: str = "rank") -> DataFrame:
    """The first k rows of each group; for small k, as every map task already cuts its groups to k rows."""
    w = Window.partitionBy(*cols(by)).orderBy(*[_sort(o) for o in order])
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)


def dedupe_first(df: DataFrame, key, order: list) -> DataFrame:
    """Keep the first row of every key; copies are cut inside each map task before the shuffle."""
    return top_per_group(df, key, order, 1, "_rank").drop("_rank")


def worst(df: DataFrame, by: ColumnLike, k: int = 12, tie=()) -> DataFrame:
    """The k rows with the largest value."""
    return df.orderBy(col(by).desc(), *[_sort(t) for t in tie]).limit(k)
