"""Balance tools must not change results: forced splits, hot keys, other partition counts."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from curate.operators.ranking import cut_beyond, dedupe_first, ordered_rank, seeded_rank, top_per_group
from curate.operators.skew import join_unique, running
from tests.conftest import rows


@pytest.fixture(scope="module")
def skewed(spark):
    """Key 0 holds a third of 3,000 rows, the rest is spread over 200 keys; sparse orders."""
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(1 + F.col("id") % 200).alias("k"),
        (F.col("id") * 7).alias("i"),
        F.pmod(F.xxhash64("id"), F.lit(1000)).cast("double").alias("v"),
    )
    return df.cache()


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_join_unique_equals_the_plain_join(spark, skewed, how):
    facts = skewed.where("k % 2 = 0").groupBy("k").agg(F.sum("v").alias("s"))
    assert rows(join_unique(skewed, facts, "k", how)) == rows(skewed.join(facts, "k", how))


# A large cluster's thresholds, scaled to 3,000 rows; no side is small enough to broadcast.
SMALL = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2k",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "3k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
}


@pytest.fixture
def scaled(spark):
    for k, v in SMALL.items():
        spark.conf.set(k, v)
    yield spark
    for k in SMALL:
        spark.conf.unset(k)


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_the_hot_partition_of_a_join_on_aggregated_facts_is_split(scaled, skewed, how):
    facts = skewed.groupBy("k").agg(F.sum("v").alias("s"))
    out = join_unique(skewed, facts, "k", how)
    got = out.collect()
    assert len(got) == (0 if how == "left_anti" else 3000)
    assert "skew=true" in out._jdf.queryExecution().executedPlan().toString()
    plain = skewed.join(facts, "k", how)
    plain.collect()
    assert "skew=true" not in plain._jdf.queryExecution().executedPlan().toString()


def test_join_unique_with_null_keys_and_two_columns(spark):
    df = spark.createDataFrame([(1, "a", 1), (None, "a", 2), (1, None, 3), (2, "b", 4)], "x int, y string, n int")
    facts = spark.createDataFrame([(1, "a", 9), (2, "c", 8)], "x int, y string, f int")
    assert rows(join_unique(df, facts, ["x", "y"]), "n", "f") == rows(df.join(facts, ["x", "y"], "left"), "n", "f")


@pytest.mark.parametrize("span", [50, 700, 10**6])
def test_running_equals_the_window(skewed, span):
    w = Window.partitionBy("k").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    want = skewed.select("k", "i", F.sum("v").over(w), F.count("v").over(w), F.min("v").over(w), F.max("v").over(w))
    got = running(
        skewed,
        "k",
        "i",
        {"a": ("sum", F.col("v")), "b": ("count", F.col("v")), "c": ("min", F.col("v")), "d": ("max", F.col("v"))},
        span,
    )
    assert rows(got, "k", "i", "a", "b", "c", "d") == rows(want)


def test_running_skips_nulls_across_segments(spark):
    df = spark.createDataFrame([(0, None), (1, 5.0), (10, None), (11, 2.0), (20, None)], "i int, v double").withColumn("k", F.lit(1))
    got = running(df, "k", "i", {"s": ("sum", F.col("v")), "m": ("min", F.col("v")), "n": ("count", F.col("v"))}, span=10)
    got = [tuple(r) for r in got.orderBy("i").select("s", "m", "n").collect()]
    assert got == [(None, None, 0), (5.0, 5.0, 1), (5.0, 5.0, 1), (7.0, 2.0, 2), (7.0, 2.0, 2)]


def by_window(df):
    return df.select("k", "i", F.row_number().over(Window.partitionBy("k").orderBy("v", "i")).alias("rank"))


@pytest.mark.parametrize("partitions", ["1", "8", "200"])
def test_ordered_rank_equals_row_number(spark, skewed, partitions):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        assert rows(ordered_rank(skewed, "k", ["v", "i"]), "k", "i", "rank") == rows(by_window(skewed))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_ordered_rank_splits_a_group_over_partitions(spark, skewed):
    """Many range partitions per group, and a descending order."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = rows(ordered_rank(skewed, [], [F.desc("i")]), "i", "rank")
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert got == [(i * 7, 3000 - i) for i in range(3000)]


@pytest.mark.parametrize("digits", [1, 3, 6])
def test_seeded_rank_equals_row_number(spark, skewed, digits):
    keep = skewed.select("k").distinct().where("k < 150").withColumn("keep", F.lit(12))
    key = F.md5(F.concat_ws(":", F.lit("3"), F.col("i").cast("string")))
    want = skewed.select("k", "i", F.row_number().over(Window.partitionBy("k").orderBy(key)).alias("rank"))
    assert rows(seeded_rank(skewed, "k", "i", 3, digits=digits), "k", "i", "rank") == rows(want)
    kept = seeded_rank(skewed, "k", "i", 3, keep, digits=digits)
    assert rows(kept, "k", "i", "rank") == rows(want.where("rank <= 12 and k < 150"))


def test_top_per_group_cuts_before_the_shuffle(skewed):
    top = top_per_group(skewed, "k", ["v", "i"], 2)
    assert rows(top, "k", "i", "rank") == rows(by_window(skewed).where("rank <= 2"))
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_dedupe_first_keeps_whole_rows(skewed):
    first = skewed.groupBy("k").agg(F.min("i").alias("i"))
    assert rows(dedupe_first(skewed, "k", ["i"]), "k", "i", "v") == rows(skewed.join(first, ["k", "i"]), "k", "i", "v")


@pytest.mark.parametrize("keep", [1, 40, 700, 5000])
def test_cut_beyond_keeps_every_wanted_row(spark, keep):
    """Heavy ties, NULL orders, groups of very different size; text orders pass uncut."""
    df = spark.range(20_000).select(
        "id",
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 7).cast("string"))).alias("g"),
        F.when(F.col("id") % 50 > 0, F.pmod(F.xxhash64("id"), F.lit(300))).alias("o"),
    )
    first = Window.partitionBy("g").orderBy("o", "id")
    want = rows(df.withColumn("r", F.row_number().over(first)).where(F.col("r") <= keep), "id", "r")
    cut = cut_beyond(df, "g", "o", F.lit(keep))
    assert rows(cut.withColumn("r", F.row_number().over(first)).where(F.col("r") <= keep), "id", "r") == want
    if keep == 40:
        assert cut.where("o is not null").count() < 2000
    text = df.withColumn("o", F.col("o").cast("string"))
    assert cut_beyond(text, "g", "o", F.lit(keep)).count() == 20_000
