"""Catalogue of saved artifacts from file listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curate.functions.names import artifact_version, checkpoint_label, file_name, generation


def list_files(spark: SparkSession, pattern: str, folder: str | None = None) -> DataFrame:
    """path, length, modification time and number of the files that match; the contents are not read.

    With ``folder`` an artifact is a folder of files whose name begins so, as a model saved in parts is (``folder`` is left out of
    its path); files of no such folder are passed over.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(pattern).select("path", "length", "modificationTime")
    if folder is None:
        return files.withColumn("n_files", F.lit(1).cast("long"))
    begin = "/" + folder
    name = F.substring_index(F.substring_index("path", begin, -1), "/", 1)
    whole = F.concat(F.substring_index("path", begin, 1), F.lit("/"), name)
    inside = files.where(F.contains("path", F.lit(begin))).withColumn("path", whole)
    return inside.groupBy("path").agg(F.sum("length").alias("length"), F.max("modificationTime").alias("modificationTime"), F.count(F.lit(1)).alias("n_files"))


def catalogue(files: DataFrame) -> DataFrame:
    """Add name, label, version and generation read from the file names."""
    return files.select(
        "*",
        file_name("path").alias("name"),
        checkpoint_label("path").alias("label"),
        artifact_version("path").alias("version"),
        generation("path").alias("generation"),
    )


def against_expected(files: DataFrame, expected: DataFrame, label: str = "label") -> DataFrame:
    """Every expected label, with its file if there is one, and whether it is available."""
    found = catalogue(files).select(label, "path", "name", "version", "generation", *[c for c in ("n_files",) if c in files.columns])
    return expected.join(found, label, "left").withColumn("available", F.col("path").isNotNull())


def scan_artifacts(spark: SparkSession, pattern: str, expected: DataFrame | None = None, folder: str | None = None) -> DataFrame:
    """The catalogue of the files (or folders of files) that match, or the expected labels flagged present or missing."""
    files = list_files(spark, pattern, folder)
    return catalogue(files) if expected is None else against_expected(files, expected)
