"""Where staged tables live: the shared folder the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
_OWNED: ContextVar[list[str] | None] = ContextVar("owned", default=None)


def stage_root(spark: SparkSession) -> str:
    """The shared folder for staged data.

    A cluster sets ``spark.checkpoint.dir``. Only where it is unset and the master is local (tests, a
    laptop) is a temporary folder made; elsewhere the missing setting is an error, as a machine-local
    folder would be lost with its machine.
    """
    sc = spark.sparkContext
    root = spark.conf.get(CHECKPOINT_KEY, None) or sc.getCheckpointDir()
    if root is None:
        if not sc.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_KEY} to a folder every executor can reach")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="curate-"))
        root = sc.getCheckpointDir()
    return root.rstrip("/")


def stage_path(spark: SparkSession, name: str) -> str:
    """A fresh path for one staged table."""
    path = f"{stage_root(spark)}/{name}-{uuid.uuid4().hex}"
    if _OWNED.get() is not None:
        _OWNED.get().append(path)
    return path


@contextmanager
def staging(spark: SparkSession) -> Iterator[None]:
    """Own what is staged inside the block: it is removed at the end, so results must be written or collected before.

    Without an owner staged tables stay until the shared folder is cleared, as a lazy result may still read them.
    """
    mark = _OWNED.set([])
    try:
        yield
    finally:
        for path in _OWNED.get():
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        _OWNED.reset(mark)


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` as a table and read it back: cuts lineage, and fixes what a re-run could change."""
    path = stage_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
