"""Stored pools with a catalogue of their files, so that a job which needs the first rows of some groups opens few of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from curate.functions.base import cols
from curate.operators.skew import null_safe

#: Where the catalogue lies in the pool's folder; readers of the folder pass names with a line in front over.
CATALOGUE = "_files"


def write_pool(df: DataFrame, path: str, groups, order: str, files: int) -> None:
    """Write a pool in about ``files`` files along ``order``, and of every file the rows and the ends of ``order`` per group."""
    groups = cols(groups)
    ranged = df.repartitionByRange(files, order).sortWithinPartitions(*groups, order)
    ranged.write.mode("overwrite").parquet(path)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    rows = stored.groupBy(F.col("_metadata.file_path").alias("file"), *groups).agg(
        F.count(F.lit(1)).alias("n"), F.count(order).alias("known"), F.min(order).alias("low"), F.max(order).alias("high")
    )
    rows.write.mode("overwrite").parquet(f"{path}/{CATALOGUE}")


def files_for(spark: SparkSession, path: str, groups, keep: DataFrame) -> DataFrame:
    """(file): the files that can hold one of the first ``keep`` rows by order of a group; ``keep`` is (groups..., keep).

    Up to the least end at which the files that lie before it hold the quota, every row may be among the first; files that begin
    later cannot have one. NULL comes first in the order.
    """
    groups = cols(groups)
    files = null_safe(spark.read.parquet(f"{path}/{CATALOGUE}"), keep.select(*groups, "keep"), groups)
    # A file with NULLs begins before all others; one with nothing else ends there too.
    files = files.withColumns({"first": (F.col("known") == F.col("n")) & F.col("low").isNotNull(), "only": F.col("known") > 0})
    by = Window.partitionBy(*(groups or [F.lit(1)])).orderBy("only", "high")
    held = files.withColumn("held", F.sum("n").over(by.rangeBetween(Window.unboundedPreceding, 0)))
    end = F.struct("only", "high")
    ends = held.groupBy(*groups).agg(F.min(F.when(F.col("held") >= F.col("keep"), end)).alias("end"))
    marked = null_safe(held, ends, groups)
    begin = F.when(F.col("first"), F.struct(F.lit(True), F.col("low"))).otherwise(F.struct(F.lit(False), F.col("low")))
    within = F.col("end").isNull() | (begin <= F.col("end"))
    return marked.where(within & (F.col("keep") > 0)).select("file").distinct()


def read_first(spark: SparkSession, path: str, groups, keep: DataFrame) -> DataFrame:
    """The stored rows of the files that ``files_for`` names; the others are never opened. Their list, as any list of files, is held by the driver."""
    names = [r["file"] for r in files_for(spark, path, groups, keep).collect()]
    schema = spark.read.parquet(path).schema
    return spark.read.schema(schema).parquet(*names) if names else spark.createDataFrame([], schema)
