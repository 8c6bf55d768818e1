import pytest
from pyspark.sql import functions as F

from curate.streaming import ingest, monitor, progress
from curate.storage import CHECKPOINT_KEY, stage, stage_root
from tests.conftest import rows


def lines(spark, path, values):
    spark.createDataFrame([(v,) for v in values], "value string").coalesce(1).write.mode("append").text(path)


def run(spark, inbox, sink, checkpoint):
    ingest.ingest_annotations(ingest.stream_results(spark, inbox, 1), sink, checkpoint).awaitTermination()
    return rows(ingest.read_store(spark, sink), "fen", "cp", "w", "d", "l")


def test_ingest_restarts_without_double_work(spark, tmp_path):
    inbox, sink, checkpoint = (str(tmp_path / n) for n in ("in", "store", "cp"))
    lines(spark, inbox, ["a w,1,10,20,970", "b w,2,1,2,997", "cut,3"])
    first = run(spark, inbox, sink, checkpoint)
    assert first == [("a w", 1, 10, 20, 970), ("b w", 2, 1, 2, 997)]
    assert run(spark, inbox, sink, checkpoint) == first
    lines(spark, inbox, ["b w,9,9,9,9", "c w,4,0,0,1000", "c w,4,0,0,1000"])
    assert run(spark, inbox, sink, checkpoint) == [*first, ("c w", 4, 0, 0, 1000)]


def test_the_first_written_value_stays(spark, tmp_path):
    inbox, sink, checkpoint = (str(tmp_path / n) for n in ("in", "store", "cp"))
    lines(spark, inbox, ["a w,90,1,2,997", "a w,-50,3,4,993"])
    lines(spark, inbox, ["a w,10,5,5,990", "b w,7,1,1,998"])
    want = [("a w", 90, 1, 2, 997), ("b w", 7, 1, 1, 998)]
    assert run(spark, inbox, sink, checkpoint) == want
    ingest.compact(spark, sink)
    assert rows(ingest.read_store(spark, sink), "fen", "cp", "w", "d", "l") == want
    assert run(spark, inbox, sink, str(tmp_path / "other")) == want


def test_depths_are_kept_apart(spark, tmp_path):
    sink = str(tmp_path / "store")
    for depth in (12, 20):
        inbox = str(tmp_path / f"in{depth}")
        lines(spark, inbox, [f"a w,{depth},1,2,997"])
        ingest.ingest_annotations(ingest.stream_results(spark, inbox), sink, str(tmp_path / f"cp{depth}"), depth).awaitTermination()
    assert rows(ingest.read_store(spark, sink), "fen", "depth", "cp") == [("a w", 12, 12), ("a w", 20, 20)]
    assert rows(ingest.read_store(spark, sink, 20), "cp") == [(20,)]


def test_a_replayed_batch_adds_nothing_and_reads_no_store(spark, tmp_path):
    place = "timestamp'2024-01-01' as _at, 'f' as _file, 0L as _block"
    batch = spark.createDataFrame([("a w,1,10,20,970",)], "value string").selectExpr("value", *place.split(", "))
    sink = str(tmp_path / "store")
    for _ in range(3):
        ingest.append_batch(batch, sink, "r", 0)
    # A file that no reader can open does not trouble the next batch.
    (tmp_path / "store" / "run=r" / "epoch=1").mkdir()
    (tmp_path / "store" / "run=r" / "epoch=1" / "part-0.parquet").write_text("no parquet")
    ingest.append_batch(batch, sink, "r", 1)
    assert ingest.read_store(spark, sink).count() == 1


def events(spark):
    return spark.createDataFrame(
        [("2024-01-01 00:00:01", False), ("2024-01-01 00:00:19", True), ("2024-01-01 00:00:20", False), ("2024-01-01 00:01:05", False)], "ts string, bad boolean"
    ).withColumn("ts", F.col("ts").cast("timestamp"))


def test_progress_reports_the_whole_job(spark):
    windows = progress.progress_windows(events(spark), "ts", "bad")
    got = progress.progress(windows, total=6, already=4).orderBy("window_start").collect()
    assert [(r.done, r.errors) for r in got] == [(1, 1), (1, 0), (1, 0)]
    assert [r.percent for r in got] == [50.0, 60.0, 70.0]
    assert [r.elapsed_s for r in got] == [20, 40, 80] and got[-1].mean_rate == pytest.approx(3 / 80)
    assert got[-1].eta_hours == pytest.approx(3 / (3 / 80) / 3600)


def test_streamed_windows_equal_the_batch(spark, tmp_path):
    path = str(tmp_path / "events")
    for part in events(spark).randomSplit([0.5, 0.5], 3):
        part.coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(events(spark).schema).option("maxFilesPerTrigger", 1).parquet(path)
    windows = progress.progress_windows(stream, "ts", "bad", watermark="1 hour")
    got = ingest.run_updates(windows, ["window_start"], str(tmp_path / "out"), str(tmp_path / "cp"))
    assert rows(got) == rows(progress.progress_windows(events(spark), "ts", "bad"))


def test_replay_windows(spark):
    df = spark.range(10).select(F.col("id").alias("it"), F.lit(2).alias("v"))
    got = rows(progress.replay_windows(df, "it", {"s": ("sum", F.col("v"))}), "window_end", "n_rows", "s")
    assert got[0] == (0, 1, 2) and got[5] == (5, 4, 8) and len(got) == 10


def test_stream_best_keeps_state_over_batches(spark, tmp_path):
    path = str(tmp_path / "log")
    log = spark.createDataFrame([("r", i, v) for i, v in enumerate([1.0, 0.99995, 0.9, 0.95])], "run string, step long, v double")
    for cut in ("step < 2", "step >= 2"):
        log.where(cut).coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(log.schema).parquet(path)
        monitor.stream_best(stream, "run", "step", "v", str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = monitor.read_best(spark, str(tmp_path / "out"), log.schema)
    assert rows(got) == [("r", 0, 1.0), ("r", 2, 0.9)]


class Fake:
    """A session and context with just the settings ``stage_root`` reads."""

    def __init__(self, root, master):
        self.root, self.master, self.made = root, master, None
        self.conf = self.sparkContext = self

    def get(self, key, default):
        return self.root if key == CHECKPOINT_KEY else default

    def getCheckpointDir(self):
        return self.made

    def setCheckpointDir(self, path):
        self.made = path + "/x"


def test_stage_root_reads_the_setting_first():
    assert stage_root(Fake("hdfs://shared/", "yarn")) == "hdfs://shared"
    local = Fake(None, "local[2]")
    assert stage_root(local) == stage_root(local) == local.made
    with pytest.raises(ValueError, match="every executor"):
        stage_root(Fake(None, "yarn"))


def test_stage_writes_a_table(spark):
    staged = stage(spark.range(3), "x")
    assert staged.count() == 3 and stage_root(spark) in staged.inputFiles()[0].replace("file:", "")


def log_of(spark, values):
    return spark.createDataFrame([("r", i, v) for i, v in enumerate(values)], "run string, step long, v double")


def test_stream_best_passes_over_values_that_are_no_numbers(spark, tmp_path):
    nan = float("nan")
    log = log_of(spark, [nan, 0.5, nan, 0.1, None, 0.1, nan, 0.05])
    path, out, checkpoint = (str(tmp_path / n) for n in ("log", "out", "cp"))
    for cut in ("step < 1", "step between 1 and 2", "step > 2"):
        log.where(cut).coalesce(1).write.mode("append").parquet(path)
        monitor.stream_best(spark.readStream.schema(log.schema).parquet(path), "run", "step", "v", out, checkpoint).awaitTermination()
    assert rows(monitor.read_best(spark, out, log.schema), "step", "v") == [(1, 0.5), (3, 0.1), (7, 0.05)]
    # The setting of the session is its own again.
    assert "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass", "")


def test_stream_best_equals_the_batch(spark, tmp_path):
    log = spark.range(400).selectExpr("cast(id % 3 as string) run", "id step", "10 - log(1 + id) + (xxhash64(id) % 100) / 50 v")
    path, out = str(tmp_path / "log"), str(tmp_path / "out")
    for lo, hi in ((0, 150), (150, 160), (160, 400)):
        log.where(F.col("step").between(lo, hi - 1)).repartition(3).write.mode("append").parquet(path)
        monitor.stream_best(spark.readStream.schema(log.schema).parquet(path), "run", "step", "v", out, str(tmp_path / "cp"), 0.05).awaitTermination()
    from curate.operators.monitor import best_so_far

    assert rows(monitor.read_best(spark, out, log.schema)) == rows(best_so_far(log, "run", "step", "v", 0.05))


def test_copies_across_batches_are_stored_once(spark, tmp_path):
    inbox, sink, checkpoint = (str(tmp_path / n) for n in ("in", "store", "cp"))

    def land(values):
        lines(spark, inbox, values)
        ingest.ingest_distinct(ingest.stream_results(spark, inbox, 1), sink, checkpoint).awaitTermination()

    land(["a w,90,1,2,997", "a w,-50,3,4,993", "b w,1,1,1,998", "cut,3"])
    land(["a w,10,5,5,990", "c w,7,1,1,998", "c w,8,1,1,998"])
    land(["c w,9,1,1,998", "b w,2,1,1,998"])
    assert spark.read.parquet(sink).count() == 3
    assert rows(ingest.read_store(spark, sink), "fen", "cp") == [("a w", 90), ("b w", 1), ("c w", 7)]
    # With the checkpoint lost everything is read again, and reading still takes the first.
    ingest.ingest_distinct(ingest.stream_results(spark, inbox, 1), sink, str(tmp_path / "other")).awaitTermination()
    assert rows(ingest.read_store(spark, sink), "fen", "cp") == [("a w", 90), ("b w", 1), ("c w", 7)]


def totals(spark, changes, out, checkpoint, horizon):
    stream = spark.readStream.schema("window_start timestamp, done long, errors long, epoch long").parquet(changes)
    progress.stream_totals(stream, out, checkpoint, horizon=horizon).awaitTermination()


@pytest.mark.parametrize("seed", [1, 2])
def test_totals_equal_the_batch_after_any_split(spark, tmp_path, seed):
    events = spark.range(300).selectExpr(f"timestamp_seconds(1700000000 + pmod(xxhash64(id, {seed}), 4000)) ts", "id % 7 = 0 bad", f"pmod(xxhash64(id, {seed + 1}), 4) part")
    changes, out = str(tmp_path / "changes"), str(tmp_path / "out")
    for epoch in range(4):
        seen = events.where(F.col("part") <= epoch)
        new = events.where(F.col("part") == epoch)
        moved = progress.progress_windows(new, "ts", "bad").select("window_start")
        # What an updating stream would write: the windows that this batch changed, as they are now.
        changed = progress.progress_windows(seen, "ts", "bad").join(moved, "window_start").drop("rate").withColumn("epoch", F.lit(epoch).cast("long"))
        changed.coalesce(2).write.mode("append").parquet(changes)
        totals(spark, changes, out, str(tmp_path / "cp"), 10_000)
    got = progress.read_progress(spark, out, 400, 50).drop("job")
    want = progress.progress(progress.progress_windows(events, "ts", "bad"), 400, 50)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.select(want.columns)) == rows(want)


def test_a_change_beyond_the_horizon_is_an_error(spark, tmp_path):
    changes, out, checkpoint = (str(tmp_path / n) for n in ("changes", "out", "cp"))

    def land(epoch, *windows):
        got = spark.createDataFrame([(s, d, 0, epoch) for s, d in windows], "s long, done long, errors long, epoch long")
        got.selectExpr("timestamp_seconds(s) window_start", "done", "errors", "epoch").coalesce(1).write.mode("append").parquet(changes)
        totals(spark, changes, out, checkpoint, 60)

    land(0, (0, 1), (20, 2), (40, 3), (100, 4))
    land(1, (100, 6), (120, 1), (60, 5))
    last = progress.read_progress(spark, out, 100).orderBy("window_start").collect()
    assert [r.done_so_far for r in last] == [1, 3, 6, 11, 17, 18]
    with pytest.raises(Exception, match="longer horizon"):
        land(2, (20, 9))
