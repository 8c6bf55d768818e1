"""Best-so-far monitor over a stream of metric rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from curate.operators.monitor import EPS, known
from curate.streaming.ingest import exists
from curate.streaming.state import rocks_state


def read_best(spark, path: str, schema) -> DataFrame:
    """The rows emitted so far."""
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def best_state(order: str, value: str, eps: float) -> StatefulProcessor:
    """The state of a run: its best value, one number."""

    class Best(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.best = handle.getValueState("best", "value double")

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            # Two numbers a row; the rows of one run in one batch.
            batch = pd.concat(list(rows), ignore_index=True).sort_values(order, kind="stable", ignore_index=True)
            v = batch[value].to_numpy()
            best = self.best.get()[0] if self.best.exists() else np.inf
            lowest = np.minimum.accumulate(np.concatenate([[best], v[:-1]]))
            kept = []
            # Only a strict new minimum can beat the best by more than eps.
            for i in np.flatnonzero(v < lowest):
                if best == np.inf or v[i] < best - eps:
                    best = float(v[i])
                    kept.append(i)
            if kept:
                self.best.update((best,))
                yield batch.iloc[kept]

        def close(self) -> None:
            pass

    return Best()


def stream_best(
    stream: DataFrame, run: str, order: str, value: str, path: str, checkpoint: str, eps: float = EPS
) -> StreamingQuery:
    """Append a row whenever a run's value beats its best so far by more than eps; all files there are, then stop.

    The state is one number per run in RocksDB, and no earlier row is read again. Rows must arrive in order across batches, as
    a log does; inside a batch any order will do. The rows of one run in one batch are held by one task, so a long backlog of
    one run wants a limit on the files of a batch (``maxFilesPerTrigger`` of the reader). Values that are NULL or no number beat
    nothing. The file sink writes each batch once, also over a restart.
    """
    rows = known(stream.select(run, order, F.col(value).cast("double").alias(value)), value)
    found = rows.groupBy(run).transformWithStateInPandas(best_state(order, value, eps), rows.schema, "append", "none")
    writer = found.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    with rocks_state(stream.sparkSession):
        return writer.outputMode("append").trigger(availableNow=True).start()
