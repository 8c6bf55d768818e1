"""Metric logs, run summaries, progress logs and match records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

METRIC_SCHEMA = "run string, step bigint, metric string, value double"
# Names and order of stored fields, columns of a metric file that are no numbers.
METRIC_FIRST, METRIC_STEP, METRIC_TEXT = "epoch", "global_chunk", ("chunk_file",)
PROGRESS_SCHEMA = (
    "updated string, depth int, engines int, annotated_total bigint, target_total bigint, remaining bigint, percent double, done_this_run bigint, "
    "total_this_run bigint, cached_before_run bigint, rate_pos_per_s double, elapsed_hours double, eta_hours double, errors bigint, "
    "engine_restarts bigint, run_finished boolean"
)
RECORD_SCHEMA = "label string, path string, games bigint, wins bigint, draws bigint, losses bigint, score double, elo double"
#: A comma outside of quotes.
COMMA = r',(?=(?:[^"]*"[^"]*")*[^"]*$)'


def to_long(df: DataFrame, run: str, step: str, metrics: list[str]) -> DataFrame:
    """Wide metric rows -> (run, step, metric, value); a missing metric is a NULL value."""
    wide = df.select(
        F.col(run).cast("string").alias("run"),
        F.col(step).cast("long").alias("step"),
        *[F.col(m).cast("double").alias(m) for m in metrics],
    )
    return wide.unpivot(["run", "step"], metrics, "metric", "value")


def append_metrics(df: DataFrame, path: str) -> None:
    """Append long metric rows; the columns are the same for every run whatever it measures."""
    df.select("run", "step", "metric", "value").write.mode("append").parquet(path)


def read_metrics(spark: SparkSession, path: str, metrics: list[str] | None = None) -> DataFrame:
    """The log, long; or one row per (run, step) with the named metrics as columns."""
    rows = spark.read.schema(METRIC_SCHEMA).parquet(path)
    return rows if metrics is None else rows.groupBy("run", "step").pivot("metric", metrics).agg(F.first("value", True))


def write_summary(df: DataFrame, path: str, tag: str) -> None:
    """Store (metric, value) rows of a run under its tag; a re-run of the tag replaces them."""
    df.select("metric", "value").write.mode("overwrite").json(f"{path}/tag={tag}")


def read_summary(spark: SparkSession, path: str, tags: list[str] | None = None) -> DataFrame:
    """(metric, value, tag) of all or the named runs; a named run that is not there is an error."""
    rows = spark.read.schema("metric string, value double").option("basePath", path).json(path if tags is None else [f"{path}/tag={t}" for t in tags])
    return rows


def read_metrics_csv(
    spark: SparkSession, paths, first: str = METRIC_FIRST, step: str = METRIC_STEP, text: tuple[str, ...] = METRIC_TEXT
) -> DataFrame:
    """(run, step, metric, value) of metric files whose headers differ from run to run; the run is the file's folder.

    Lines are matched with the header of their own file (the line whose first field is ``first``). An empty field, and one
    that a cut-off line lacks, is a NULL value. A file without a header, or with two different ones, is an error.
    """
    fields = F.transform(F.split("value", COMMA, -1), lambda x: F.regexp_replace(F.regexp_replace(x, '^"|"$', ""), '""', '"'))
    lines = spark.read.text(paths).where("value <> ''").select(F.col("_metadata.file_path").alias("_file"), fields.alias("_fields"))
    lines = lines.withColumn("_head", F.get("_fields", F.lit(0)) == first)
    heads = lines.where("_head").groupBy("_file").agg(F.collect_set("_fields").alias("_heads"))
    rows = lines.where("not _head").join(heads, "_file", "left")
    wrong = F.raise_error(F.concat(F.lit("not one header in "), F.col("_file"))).cast("array<string>")
    rows = rows.withColumn("_names", F.when(F.size(F.coalesce("_heads", F.array())) == 1, F.get("_heads", F.lit(0))).otherwise(wrong))
    at = F.get("_fields", (F.array_position("_names", step) - 1).cast("int"))
    cells = rows.select(
        F.element_at(F.split("_file", "/"), -2).alias("run"),
        at.cast("long").alias("step"),
        F.explode(F.zip_with("_names", "_fields", lambda n, v: F.struct(n.alias("n"), v.alias("v")))).alias("c"),
    )
    cells = cells.where(F.col("c.n").isNotNull() & ~F.col("c.n").isin(step, *text))
    return cells.select("run", "step", F.col("c.n").alias("metric"), F.nullif("c.v", F.lit("")).cast("double").alias("value"))


def write_progress_log(df: DataFrame, path: str) -> None:
    """Append states of a job (``log_state``), one JSON object per line."""
    df.write.mode("append").json(path)


def read_progress_log(spark: SparkSession, path) -> DataFrame:
    """The logged states; a line that a stopped job left unfinished is no state."""
    return spark.read.schema(PROGRESS_SCHEMA).option("mode", "DROPMALFORMED").json(path)


def write_gauntlet(df: DataFrame, path: str) -> None:
    """Append match records (label, path, games, wins, draws, losses, score, elo), one JSON object per line."""
    df.select(*[part.split()[0] for part in RECORD_SCHEMA.split(", ")]).write.mode("append").json(path)


def read_gauntlet(spark: SparkSession, path, document: bool = True) -> DataFrame:
    """Match records: of documents {label: record}, one per file, or of the lines that ``write_gauntlet`` writes.

    A file that does not parse is an error, so that no finished match is played again unnoticed.
    """
    if not document:
        return spark.read.schema(RECORD_SCHEMA).option("mode", "FAILFAST").json(path)
    whole = spark.read.text(path, wholetext=True)
    records = F.from_json("value", f"map<string,struct<{RECORD_SCHEMA.replace(' ', ':').replace(',:', ',')}>>", {"mode": "FAILFAST"})
    rows = whole.select(F.explode(records).alias("_label", "r"))
    return rows.select(F.coalesce("r.label", "_label").alias("label"), *[F.col(f"r.{p.split()[0]}") for p in RECORD_SCHEMA.split(", ")[1:]])
