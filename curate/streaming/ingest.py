"""Annotation results as a stream of files: cleaned, logged batch by batch, one row per key on reading.

The store is a log: a batch adds the first copy of each of its keys, with the place it was written at, and reads nothing
of what is there. Reading takes the first written row of a key; ``compact`` does the same for good.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from curate.operators.ranking import dedupe_first
from curate.sources.tables import parse_annotations
from curate.streaming.state import rocks_state

# Fixed value: search depth of the annotation job.
DEPTH = 12
KEY = ["fen", "depth"]
#: What was written first: by the file's time, its name, the block in it and the line in the block.
WRITTEN = ["_at", "_file", "_block", "_line"]
STORE_SCHEMA = "fen string, cp int, w int, d int, l int, depth int, _at timestamp, _file string, _block long, _line long, run string, epoch long"


def stream_results(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Result lines fen,cp,w,d,l from files as they land, with the place they come from."""
    reader = spark.readStream
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.text(path).select(
        "value",
        F.col("_metadata.file_modification_time").alias("_at"),
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
    )


def _folder(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _folder(spark, path)
    return fs.exists(p)


def _log(spark: SparkSession, sink: str) -> DataFrame:
    """All rows of the store; ``run`` and ``epoch`` are its folders."""
    if not exists(spark, sink):
        return spark.createDataFrame([], STORE_SCHEMA)
    return spark.read.schema(STORE_SCHEMA).option("basePath", sink).parquet(sink)


def read_store(spark: SparkSession, sink: str, depth: int | None = None) -> DataFrame:
    """(fen, depth, cp, w, d, l): everything ingested so far, of each key the row that was written first; of one depth if asked for."""
    rows = _log(spark, sink)
    rows = rows if depth is None else rows.where(F.col("depth") == depth)
    return dedupe_first(rows, KEY, WRITTEN).select(*KEY, "cp", "w", "d", "l")


def _placed(lines: DataFrame, depth: int) -> DataFrame:
    """The annotations of the lines, with the place they were written at."""
    if not lines.isStreaming:
        return parse_annotations(lines.withColumns({"_line": F.monotonically_increasing_id() % (1 << 33), "depth": F.lit(depth)}))

    def count(batches):
        """A stream has no row numbers of its own: the lines of a task, as they are read."""
        import pyarrow as pa

        at = 0
        for batch in batches:
            yield batch.append_column("_line", pa.array(range(at, at + batch.num_rows), pa.int64()))
            at += batch.num_rows

    numbered = lines.mapInArrow(count, StructType([*lines.schema.fields, StructField("_line", LongType())]))
    return parse_annotations(numbered.withColumn("depth", F.lit(depth)))


def append_batch(batch: DataFrame, sink: str, run: str, epoch: int, depth: int = DEPTH) -> None:
    """Log the first copy of each key of the batch under its run and number; a replayed batch writes its folder again."""
    first = dedupe_first(_placed(batch, depth), KEY, WRITTEN)
    first.write.mode("overwrite").parquet(f"{sink}/run={run}/epoch={epoch}")


def ingest_annotations(
    stream: DataFrame, sink: str, checkpoint: str, depth: int = DEPTH, once: bool = True, flush: str = "20 seconds"
) -> StreamingQuery:
    """Run the ingest of results of one search depth: all files there are and stop, or keep flushing every 20 seconds.

    The checkpoint remembers finished files, so a restart goes on where the last run stopped. A lost checkpoint costs a second
    reading of the files and changes no row: its batches go under another run, and the place of a line decides.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        run = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        append_batch(batch, sink, run, epoch, depth)

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=flush)
    return writer.start()


def first_state(columns: list[str], order: list[str], expires: int | None) -> StatefulProcessor:
    """The state of a key: that it was seen, for ``expires`` milliseconds or for good. Its first row by ``order`` goes on, no other."""

    class First(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.seen = handle.getValueState("seen", "yes boolean", expires)

        def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
            if self.seen.exists():
                return
            first = min(rows, key=lambda row: [row[c] for c in order], default=None)
            if first is not None:
                self.seen.update((True,))
                yield Row(**{c: first[c] for c in columns})

        def close(self) -> None:
            pass

    return First()


def ingest_distinct(stream: DataFrame, sink: str, checkpoint: str, depth: int = DEPTH, hours: float | None = None) -> StreamingQuery:
    """The ingest with copies dropped before the log: a key is written once, however many batches and restarts its copies come in.

    The state (RocksDB) holds the keys seen, for ``hours`` after they were seen or for good; a copy that comes later than
    that is logged again, and reading still takes the first. For streams whose copies are many: the log then grows with the keys and
    needs no ``compact``, while ``ingest_annotations`` keeps no state and logs a copy per batch. A lost checkpoint
    costs what it costs there. All files there are, then stop.
    """
    # Stateful Python sees no column whose name begins with a line.
    plain = {c: c.removeprefix("_") for c in WRITTEN}
    rows = _placed(stream, depth).withColumnsRenamed(plain).withColumn("at", F.unix_micros("at"))
    expires = None if hours is None else int(hours * 3_600_000)
    state = first_state(rows.columns, list(plain.values()), expires)
    # Without an expiry no clock is needed. Rows, not frames: a frame per key costs more than the rest of its handling.
    distinct = rows.groupBy(*KEY).transformWithState(state, rows.schema, "append", "none" if expires is None else "processingTime")
    distinct = distinct.withColumn("at", F.timestamp_micros("at")).withColumnsRenamed({b: a for a, b in plain.items()})

    def write(batch: DataFrame, epoch: int) -> None:
        run = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        batch.write.mode("overwrite").parquet(f"{sink}/run={run}/epoch={epoch}")

    with rocks_state(stream.sparkSession):
        return distinct.writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def compact(spark: SparkSession, sink: str) -> None:
    """Rewrite the log to one row per key, then remove the batches that went in. Run it while no ingest writes.

    The new folder is complete before the first old one goes, so a job that is lost in between leaves copies, no gaps.
    """
    if not exists(spark, sink):
        return
    fs, root = _folder(spark, sink)
    old = [s.getPath() for s in fs.listStatus(root) if s.isDirectory() and s.getPath().getName().startswith("run=")]
    first = dedupe_first(_log(spark, sink), KEY, WRITTEN).drop("run", "epoch")
    first.write.parquet(f"{sink}/run=compact-{uuid.uuid4().hex}/epoch=0")
    for path in old:
        fs.delete(path, True)


def log_updates(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Run an aggregating stream over what there is now, appending each batch's changed rows under its number.

    Only changed rows are written, unlike in complete mode, and open windows are among them, unlike in append mode. A
    replayed batch writes its folder again.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    writer = df.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def run_updates(df: DataFrame, keys: list[str], path: str, checkpoint: str) -> DataFrame:
    """Log the changed rows of an aggregating stream over what there is now, and read the last state per key."""
    log_updates(df, path, checkpoint).awaitTermination()
    schema = StructType([*df.schema.fields, StructField("epoch", LongType())])
    return dedupe_first(df.sparkSession.read.schema(schema).parquet(path), keys, [F.desc("epoch")]).drop("epoch")
