"""Structured Streaming jobs over the tables, run to the end of the data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks import roles
from checks.audits import measured
from checks.base import query, rounded, table
from curate.sources import logs
from curate.storage import stage_path
from curate.streaming import ingest, monitor, progress

# Files in a batch of the distinct ingest.
FILES = 12


def stream(spark, sf, name: str) -> DataFrame:
    schema = table(spark, sf, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf)


@query(
    "ingest_annotations",
    """select cast(fen as varchar) as fen, 12 as depth, cp, w, d, l from annotations
       union all select cast(fen as varchar), 20, cp + 1, w, d, l from annotations where fen % 4 = 0""",
    ("annotations",),
)
def _(spark, sf):
    ann = roles.annotations(spark, sf)

    def line(cp):
        return F.concat_ws(",", F.col("fen").cast("string"), cp.cast("string"), *[F.col(c).cast("string") for c in ("w", "d", "l")])

    def land(rows, box: str, *lines, depth: int = ingest.DEPTH) -> None:
        """The lines of each row one after the other, then a run of the ingest."""
        rows.select(F.explode(F.array(*lines)).alias("value")).write.mode("append").text(boxes[box])
        ingest.ingest_annotations(ingest.stream_results(spark, boxes[box], 2), sink, boxes[f"{box} checkpoint"], depth).awaitTermination()

    boxes = {n: stage_path(spark, n.replace(" ", "-")) for n in ("first", "first checkpoint", "second", "second checkpoint")}
    sink, cp = stage_path(spark, "store"), F.col("cp")
    cut_off = F.concat_ws(",", F.col("fen").cast("string"), F.lit("1"), F.lit("2"))
    # Another value of a key in the same file, and after a restart in later files: the first written stays.
    land(ann.where("w >= 100"), "first", cut_off, line(cp), line(cp - 1000))
    land(ann, "first", line(F.when(F.col("w") >= 100, cp + 500).otherwise(cp)), line(cp + 7))
    land(ann.where("fen % 4 = 0"), "second", line(cp + 1), depth=20)
    ingest.compact(spark, sink)
    # With the checkpoint lost, everything is read once more.
    ingest.ingest_annotations(ingest.stream_results(spark, boxes["first"]), sink, stage_path(spark, "checkpoint")).awaitTermination()
    return ingest.read_store(spark, sink)


WINDOWS = """with w as (select time_bucket(interval '20 seconds', ts) as b, count(*) filter (where event_type <> 'error') as done, count(*) filter (where event_type = 'error') as errors
    from events group by 1),
  p as (select b, done, errors, cast(sum(done) over (order by b) as bigint) as done_so_far, cast(sum(errors) over (order by b) as bigint) as errors_so_far,
    epoch(b) + 20 - epoch(min(b) over ()) as elapsed from w)
"""
SECOND = "yyyy-MM-dd HH:mm:ss"


@query(
    "progress",
    WINDOWS
    + """select strftime(b, '%Y-%m-%d %H:%M:%S') as window_start, done, errors, done_so_far, errors_so_far, cast(elapsed as bigint) as elapsed_s,
      round(100 * (500 + done_so_far) / (500 + (select count(*) from events where event_type <> 'error'))::double, 6) as percent, round(done_so_far / elapsed, 6) as mean_rate,
      round(case when done_so_far > 0 then ((select count(*) from events where event_type <> 'error') - done_so_far) / (done_so_far / elapsed) / 3600 else 0 end, 6) as eta_hours from p""",
)
def _(spark, sf):
    events = table(spark, sf, "events")
    total = events.where("event_type <> 'error'").count()
    windows = progress.progress_windows(events, "ts", F.col("event_type") == "error")
    out = rounded(progress.progress(windows, total, already=500).drop("rate"), "percent", "mean_rate", "eta_hours")
    return out.withColumn("window_start", F.date_format("window_start", SECOND))


@query(
    "read_progress_log",
    WINDOWS
    + """, t as (select count(*) as total from events where event_type <> 'error')
      select strftime(b + interval '20 seconds', '%Y-%m-%d %H:%M:%S') as updated, 12 as depth, 8 as engines, 500 + done_so_far as annotated_total, 500 + total as target_total,
        total - done_so_far as remaining, round(100 * (500 + done_so_far) / (500 + total)::double, 2) as percent, done_so_far as done_this_run, total as total_this_run, cast(500 as bigint) as cached_before_run,
        round(done_so_far / elapsed, 2) as rate_pos_per_s, round(elapsed / 3600, 3) as elapsed_hours,
        round(case when done_so_far > 0 then (total - done_so_far) / (done_so_far / elapsed) / 3600 else 0 end, 3) as eta_hours, errors_so_far as errors,
        errors_so_far // 10 as engine_restarts, done_so_far = total as run_finished from p, t""",
)
def _(spark, sf):
    events = table(spark, sf, "events")
    total = events.where("event_type <> 'error'").count()
    rows = progress.progress(progress.progress_windows(events, "ts", F.col("event_type") == "error"), total, already=500)
    restarts = F.floor(F.col("errors_so_far") / 10)
    states = progress.log_state(rows, total, 500, engines=8, restarts=restarts, finished=F.col("done_so_far") == total)
    path = stage_path(spark, "progress")
    logs.write_progress_log(states, path)
    # A job that was stopped in the middle of a line.
    states.select(F.substring(F.to_json(F.struct("*")), 1, 40).alias("value")).write.mode("append").text(path)
    return logs.read_progress_log(spark, path)


@query(
    "progress_windows",
    WINDOWS + "select strftime(b, '%Y-%m-%d %H:%M:%S') as window_start, done, errors, round(done / 20.0::double, 6) as rate from w",
)
def _(spark, sf):
    windows = progress.progress_windows(stream(spark, sf, "events"), "ts", F.col("event_type") == "error", watermark="10 minutes")
    out = ingest.run_updates(windows, ["window_start"], stage_path(spark, "windows"), stage_path(spark, "checkpoint"))
    return rounded(out, "rate").withColumn("window_start", F.date_format("window_start", SECOND))


@query(
    "replay_windows",
    """with it as (select event_id // 1000 as it, count(*) as n, sum(cast(round(value * 100) as bigint)) as v from events group by 1)
       select cast(e as bigint) as window_end, cast(sum(n) as bigint) as n_rows, cast(sum(v) as bigint) as cents from it, unnest(range(it, it + 4)) as u(e) where e <= (select max(it) from it) group by e""",
)
def _(spark, sf):
    events = table(spark, sf, "events").withColumn("iteration", F.floor(F.col("event_id") / 1000))
    cents = F.round(F.col("value") * 100).cast("long")
    return progress.replay_windows(events, "iteration", {"cents": ("sum", cents)})


@query(
    "sliding_windows",
    """with d as (select cast(ts as date) as day, count(*) as n, sum(cast(round(value * 100) as bigint)) as v from events group by 1)
       select strftime(day - cast(k as integer), '%Y-%m-%d') as first_day, cast(sum(n) as bigint) as n_rows, cast(sum(v) as bigint) as cents from d, unnest(range(4)) as u(k) group by 1""",
)
def _(spark, sf):
    measures = [F.count(F.lit(1)).alias("n_rows"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents")]
    windows = progress.sliding_windows(stream(spark, sf, "events"), "ts", "4 days", "1 day", measures, watermark="1 day")
    out = ingest.run_updates(windows, ["window_start"], stage_path(spark, "sliding"), stage_path(spark, "checkpoint"))
    return out.select(F.date_format("window_start", "yyyy-MM-dd").alias("first_day"), "n_rows", "cents")


@query(
    "stream_best",
    """with recursive o as (select user_id, event_id, value, row_number() over (partition by user_id order by event_id) as i from events where event_type <> 'error'),
       fold as (select user_id, event_id, value, i, value as best, true as hit from o where i = 1
         union all select o.user_id, o.event_id, o.value, o.i, case when o.value < best - 0.5 then o.value else best end, o.value < best - 0.5
         from fold join o on o.user_id = fold.user_id and o.i = fold.i + 1)
       select user_id, event_id, value from fold where hit""",
)
def _(spark, sf):
    """A log in two files with a restart between them; the errors' values are no numbers."""
    log = measured(table(spark, sf, "events"))
    inbox, path, checkpoint = (stage_path(spark, n) for n in ("log", "best", "checkpoint"))
    last = table(spark, sf, "events").agg(F.max("event_id")).scalar()
    for cut in (F.col("event_id") <= last / 2, F.col("event_id") > last / 2):
        log.where(cut).write.mode("append").parquet(inbox)
        monitor.stream_best(spark.readStream.schema(log.schema).parquet(inbox), "user_id", "event_id", "value", path, checkpoint, 0.5).awaitTermination()
    return monitor.read_best(spark, path, log.schema)


@query(
    "ingest_distinct",
    """select cast(l_partkey as varchar) as fen, 12 as depth, cast(min(l_orderkey * 10 + l_linenumber) as integer) as cp, 1 as w, 2 as d, 997 as l, 1 as copies from lineitem group by l_partkey""",
)
def _(spark, sf):
    """Every line annotates its part, so keys come back batch after batch, and after a restart; each is stored once, as first written."""
    lines = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("fen"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at"))
    text = F.concat_ws(",", F.col("fen").cast("string"), F.col("at").cast("string"), F.lit("1,2,997")).alias("value")
    sink, inbox, checkpoint = (stage_path(spark, n) for n in ("store", "in", "checkpoint"))
    middle = lines.agg(F.percentile_approx("at", [0.25, 0.6])).scalar()
    for cut in (F.col("at") <= middle[0], (F.col("at") > middle[0]) & (F.col("at") <= middle[1]), F.col("at") > middle[1]):
        # A file per partition, each of whole keys: what is written first of a key is in one file.
        lines.where(cut).repartition("fen").sortWithinPartitions("at").select(text).write.mode("append").text(inbox)
        ingest.ingest_distinct(ingest.stream_results(spark, inbox, FILES), sink, checkpoint).awaitTermination()
    stored = spark.read.parquet(sink).groupBy("fen", "depth").agg(F.count(F.lit(1)).cast("int").alias("copies"))
    return ingest.read_store(spark, sink).join(stored, ["fen", "depth"])


@query(
    "stream_progress",
    WINDOWS
    + """select strftime(b, '%Y-%m-%d %H:%M:%S') as window_start, done, errors, done_so_far, errors_so_far, cast(elapsed as bigint) as elapsed_s,
      round(100 * (500 + done_so_far) / (500 + (select count(*) from events where event_type <> 'error'))::double, 6) as percent, round(done_so_far / elapsed, 6) as mean_rate,
      round(case when done_so_far > 0 then ((select count(*) from events where event_type <> 'error') - done_so_far) / (done_so_far / elapsed) / 3600 else 0 end, 6) as eta_hours from p""",
)
def _(spark, sf):
    """Totals kept by a stream over files that overlap in time, with a restart between them: late rows change earlier windows."""
    events = table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    total = events.where("event_type <> 'error'").count()
    inbox, windows, totals, first, second = (stage_path(spark, n) for n in ("in", "windows", "totals", "checkpoint", "checkpoint"))
    late = F.expr("unix_seconds(ts) + pmod(xxhash64(event_id), 86400)")
    ends = events.agg(F.percentile_approx(late, [0.3, 0.7])).scalar()
    for cut in (late <= ends[0], (late > ends[0]) & (late <= ends[1]), late > ends[1]):
        events.where(cut).coalesce(1).write.mode("append").parquet(inbox)
        arrived = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(inbox)
        ingest.log_updates(progress.progress_windows(arrived, "ts", F.col("event_type") == "error", watermark="2 days"), windows, first).awaitTermination()
        changes = spark.readStream.schema("window_start timestamp, done long, errors long, rate double, epoch long").parquet(windows)
        progress.stream_totals(changes, totals, second, horizon=4 * 86_400).awaitTermination()
    out = progress.read_progress(spark, totals, total, already=500).drop("rate", "job")
    return rounded(out, "percent", "mean_rate", "eta_hours").withColumn("window_start", F.date_format("window_start", SECOND))
