"""Progress of a long annotation run from its event log."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from curate.functions.base import ColumnLike, col
from curate.operators.ranking import dedupe_first
from curate.operators.skew import join_unique, running
from curate.streaming.state import rocks_state

# Fixed values.
FLUSH_SECONDS = 20
REPLAY_SIZE = 4


def progress_windows(df: DataFrame, ts: str, error: ColumnLike, seconds: int = FLUSH_SECONDS, watermark: str | None = None) -> DataFrame:
    """Per tumbling window: rows done, errors and rows per second. Works on a stream and on a table."""
    rows = df.withColumn("_ts", F.col(ts).cast("timestamp"))
    if watermark is not None:
        rows = rows.withWatermark("_ts", watermark)
    windows = rows.groupBy(F.window("_ts", f"{seconds} seconds").alias("_w")).agg(
        F.count_if(~col(error)).alias("done"), F.count_if(col(error)).alias("errors")
    )
    return windows.select(
        F.col("_w.start").alias("window_start"), "done", "errors", (F.col("done") / seconds).alias("rate")
    )


def progress(windows: DataFrame, total: int, already: int = 0, seconds: int = FLUSH_SECONDS) -> DataFrame:
    """The job's state after each window: done so far, percent of the whole job, mean rate, hours left.

    ``total`` counts this run's rows, ``already`` those finished before it; the percent is of both.
    """
    start = F.unix_seconds("window_start")
    numbered = windows.withColumn("_second", start)
    rows = running(
        numbered,
        [],
        "_second",
        {
            "done_so_far": ("sum", F.col("done")),
            "errors_so_far": ("sum", F.col("errors")),
            "_begin": ("min", F.col("_second")),
        },
        span=FLUSH_SECONDS * 1_000_000,
    )
    return _outlook(rows, total, already, seconds).drop("_second", "_begin")


def _outlook(rows: DataFrame, total: int, already: int, seconds: int) -> DataFrame:
    """Percent, mean rate and hours left from the totals so far, the window's second and the first one's."""
    elapsed = F.col("_second") + seconds - F.col("_begin")
    mean_rate = F.col("done_so_far") / elapsed
    remaining = F.greatest(F.lit(total) - F.col("done_so_far"), F.lit(0))
    return (
        rows.withColumn("elapsed_s", elapsed)
        .withColumn("percent", 100.0 * (F.lit(already) + F.col("done_so_far")) / max(already + total, 1))
        .withColumn("mean_rate", mean_rate)
        .withColumn("eta_hours", F.when(mean_rate > 0, remaining / F.when(mean_rate > 0, mean_rate) / 3600.0).otherwise(0.0))
    )


def totals_state(seconds: int, horizon: int) -> StatefulProcessor:
    """The state of a job: its open windows, and the totals of all that are closed (older than ``horizon`` seconds before the last)."""

    class Totals(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.windows = handle.getMapState("windows", "second long", "epoch long, done long, errors long")
            self.closed = handle.getValueState("closed", "second long, done long, errors long, begin long, version long")

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            end, done, errors, begin, version = self.closed.get() if self.closed.exists() else (None, 0, 0, None, 0)
            held = {k[0]: tuple(v) for k, v in self.windows.iterator()}
            changed = []
            for part in rows:
                for row in part[["second", "epoch", "done", "errors"]].itertuples(index=False, name=None):
                    second, new = int(row[0]), tuple(int(x) for x in row[1:])
                    if end is not None and second <= end:
                        raise ValueError(f"a window changed {horizon} seconds after later ones: a longer horizon is needed")
                    # Of a window's states the one of the latest batch counts, in whatever order they are read.
                    if second not in held or held[second][0] < new[0]:
                        held[second] = new
                        changed.append(second)
                        self.windows.updateValue((second,), new)
            if not changed:
                return
            order, first = sorted(held), min(changed)
            begin = order[0] if begin is None else min(begin, order[0])
            out, d, e = [], done, errors
            for second in order:
                d, e = d + held[second][1], e + held[second][2]
                if second >= first:
                    out.append((second, held[second][1], held[second][2], d, e, begin, version + 1))
            for second in order:
                if second < order[-1] - horizon:
                    done, errors, end = done + held[second][1], errors + held[second][2], second
                    self.windows.removeKey((second,))
            self.closed.update((end, done, errors, begin, version + 1))
            names = ["second", "done", "errors", "done_so_far", "errors_so_far", "begin", "version"]
            yield pd.DataFrame({**dict(zip(names, zip(*out), strict=True)), "job": key[0]})

        def close(self) -> None:
            pass

    return Totals()


TOTALS = "second long, done long, errors long, done_so_far long, errors_so_far long, begin long, version long, job string"


def stream_totals(changes: DataFrame, path: str, checkpoint: str, seconds: int = FLUSH_SECONDS, horizon: int = 2 * 3600, job: ColumnLike | None = None) -> StreamingQuery:
    """Running totals of a job over the log of its changed windows; all files there are, then stop.

    ``changes`` is the stream of what ``log_updates`` writes for ``progress_windows``: one narrow row per window and batch,
    however many events there were, so one task per job is enough. A late window sends out the totals of all later
    windows again, under a new version. Windows more than ``horizon`` seconds before the last are closed and added up, so the state does
    not grow with the run; the horizon must be at least twice the watermark of the windows (a change beyond it is an
    error, never a wrong total).
    """
    name = F.lit("") if job is None else col(job).cast("string")
    rows = changes.select(name.alias("job"), F.unix_seconds("window_start").alias("second"), "epoch", "done", "errors")
    totals = rows.groupBy("job").transformWithStateInPandas(totals_state(seconds, horizon), TOTALS, "append", "none")
    writer = totals.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    with rocks_state(changes.sparkSession):
        return writer.outputMode("append").trigger(availableNow=True).start()


def read_progress(spark: SparkSession, path: str, total: int, already: int = 0, seconds: int = FLUSH_SECONDS) -> DataFrame:
    """What ``progress`` says, from the running totals of ``stream_totals``: of each window the last version."""
    rows = spark.read.schema(TOTALS).parquet(path)
    last = dedupe_first(rows, ["job", "second"], [F.desc("version")]).drop("begin")
    # All windows of a job begin with its earliest.
    begins = rows.groupBy("job").agg(F.min("begin").alias("_begin"))
    named = join_unique(last, begins, "job").select(
        F.timestamp_seconds("second").alias("window_start"),
        *["done", "errors", (F.col("done") / seconds).alias("rate"), "done_so_far", "errors_so_far"],
        *[F.col("second").alias("_second"), "_begin", "job"],
    )
    return _outlook(named, total, already, seconds).drop("_second", "_begin")


def log_state(rows: DataFrame, total: int, already: int = 0, depth: int = 12, engines: int = 1, restarts: ColumnLike | None = None, finished: ColumnLike | None = None, seconds: int = FLUSH_SECONDS) -> DataFrame:
    """The states of ``progress`` in the fields of the progress log; ``restarts`` and ``finished`` come from the job."""
    done = F.col("done_so_far")
    end = F.timestamp_seconds(F.unix_seconds("window_start") + seconds)
    return rows.select(
        F.date_format(end, "yyyy-MM-dd HH:mm:ss").alias("updated"),
        F.lit(depth).alias("depth"),
        F.lit(engines).alias("engines"),
        (already + done).alias("annotated_total"),
        F.lit(already + total).cast("long").alias("target_total"),
        F.greatest(F.lit(total) - done, F.lit(0)).alias("remaining"),
        F.round("percent", 2).alias("percent"),
        done.alias("done_this_run"),
        F.lit(total).cast("long").alias("total_this_run"),
        F.lit(already).cast("long").alias("cached_before_run"),
        F.round("mean_rate", 2).alias("rate_pos_per_s"),
        F.round(F.col("elapsed_s") / 3600.0, 3).alias("elapsed_hours"),
        F.round("eta_hours", 3).alias("eta_hours"),
        F.col("errors_so_far").alias("errors"),
        (F.lit(0) if restarts is None else col(restarts)).cast("long").alias("engine_restarts"),
        (F.lit(False) if finished is None else col(finished)).alias("run_finished"),
    )


def replay_windows(df: DataFrame, iteration: str, measures: dict[str, tuple[str, Column]], size: int = REPLAY_SIZE) -> DataFrame:
    """Aggregates over the last ``size`` iterations, for each window end. Measures are (sum|min|max, column).

    Rows are reduced to one per iteration first; only those are copied into the windows they belong to.
    """
    merge = {"sum": F.sum, "min": F.min, "max": F.max}
    per_iteration = df.groupBy(F.col(iteration).alias("_it")).agg(
        F.count(F.lit(1)).alias("n_rows"), *[merge[how](c).alias(n) for n, (how, c) in measures.items()]
    )
    last = per_iteration.agg(F.max("_it")).scalar()
    window_end = F.explode(F.sequence(F.col("_it"), F.col("_it") + size - 1))
    ends = per_iteration.withColumn("window_end", window_end).where(F.col("window_end") <= last)
    return ends.groupBy("window_end").agg(
        F.sum("n_rows").alias("n_rows"), *[merge[how](n).alias(n) for n, (how, _) in measures.items()]
    )


def sliding_windows(df: DataFrame, ts: str, size: str, slide: str, measures: list[Column], watermark: str | None = None) -> DataFrame:
    """The same over time: sliding windows on a stream or a table."""
    rows = df.withColumn("_ts", F.col(ts).cast("timestamp"))
    if watermark is not None:
        rows = rows.withWatermark("_ts", watermark)
    windows = rows.groupBy(F.window("_ts", size, slide).alias("_w")).agg(*measures)
    return windows.select(F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), *[c for c in windows.columns if c != "_w"])
