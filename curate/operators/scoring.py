"""Batched model scoring over feature arrays."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from curate.functions.base import cols
from curate.operators.ranking import dedupe_first
from curate.operators.skew import join_unique

BATCH = 256


def batch_score(
    df: DataFrame, load_fn: Callable[[], Callable[[np.ndarray], np.ndarray]], features: str, output: str = "probs", batch: int = BATCH
) -> DataFrame:
    """Add ``output`` = predict(features) per row, in batches.

    ``load_fn`` runs once per task and returns predict(float32[n, m]) -> array[n, k]; ship the model by
    path, or by broadcast, and load it there. The rows' lists are one Arrow buffer, seen as a matrix without a Python object per
    value; the other columns pass by untouched. All lists have one length; a row whose features are NULL, or hold a NULL, gets
    NULL.
    """
    schema = T.StructType([*df.schema.fields, T.StructField(output, T.ArrayType(T.DoubleType()))])

    def matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The lists as rows, and which rows have all their values."""
        whole = ~column.is_null().to_numpy(zero_copy_only=False)
        ends = column.offsets.to_numpy()
        size = np.diff(ends)
        values = column.values.slice(ends[0], ends[-1] - ends[0])
        if values.null_count:
            holes = np.concatenate([[0], np.cumsum(values.is_null().to_numpy(zero_copy_only=False))])
            whole &= holes[ends[1:] - ends[0]] == holes[ends[:-1] - ends[0]]
        widths = np.unique(size[whole])
        if len(widths) > 1:
            raise ValueError(f"feature lists of {widths[0]} and {widths[-1]} values")
        flat = values.fill_null(0).to_numpy(zero_copy_only=False) if values.null_count else values.to_numpy()
        if whole.all() and len(widths):
            return flat.reshape(len(size), widths[0]), whole
        # Rows without features are skipped over.
        return flat[np.repeat(whole, size)].reshape(int(whole.sum()), widths[0] if len(widths) else 0), whole

    def score(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = load_fn()
        for rows in parts:
            x, whole = matrix(rows.column(features))
            made = [np.asarray(predict(x[i : i + batch].astype(np.float32)), dtype=np.float64) for i in range(0, len(x), batch)]
            y = np.concatenate(made) if made else np.zeros((0, 0))
            ends = np.concatenate([[0], np.cumsum(whole)]) * y.shape[1]
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(y.ravel()), mask=pa.array(~whole))
            yield pa.RecordBatch.from_arrays([*rows.columns, lists], names=[*rows.schema.names, output])

    return df.mapInArrow(score, schema)


def score_distinct(
    df: DataFrame, key, load_fn, features: str, output: str = "probs", batch: int = BATCH
) -> DataFrame:
    """Score every distinct key once and join the result back to all its rows.

    Rows of one key must carry the same features.
    """
    key = cols(key)
    once = dedupe_first(df.select(*key, features), key, key)
    scored = batch_score(once, load_fn, features, output, batch).drop(features)
    return join_unique(df, scored, key, "inner")
