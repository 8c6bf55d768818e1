import pytest
from pyspark.sql import functions as F

from curate.operators import sampling as s
from curate.sources import pools
from tests.conftest import rows


def plain(df, group, quotas, order):
    from pyspark.sql.window import Window

    cap = F.create_map(*[F.lit(x) for kv in quotas.items() for x in kv])
    return df.withColumn("rk", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rk") <= cap[F.col(group)]).drop("rk")


@pytest.fixture(scope="module")
def pool(spark, tmp_path_factory):
    df = spark.range(20_000).selectExpr("id", "concat('g', id % 3) g", "case when id % 97 = 0 then null when id % 4 = 0 then 500 else pmod(xxhash64(id), 10000) end v")
    path = str(tmp_path_factory.mktemp("pool") / "pool")
    pools.write_pool(df, path, "g", "v", 32)
    return df, path


@pytest.mark.parametrize("quotas", [{"g0": 10, "g1": 50}, {"g0": 300, "g2": 2_500}, {"g1": 6_000, "g0": 1}, {"g1": 99_999}, {"g0": 0}, {"other": 5}])
def test_equals_a_window_over_all_rows(spark, pool, quotas):
    df, path = pool
    got = s.head_of_pool(spark, path, "g", quotas, ["v", "id"])
    assert rows(got, "id") == rows(plain(df, "g", quotas, ["v", "id"]), "id")


def test_files_behind_full_quotas_are_not_opened(spark, pool):
    df, path = pool
    keep = spark.createDataFrame([("g0", 400), ("g1", 300)], "g string, keep long")
    chosen = pools.read_first(spark, path, "g", keep)
    everything = spark.read.parquet(path)
    opened, there = len(chosen.inputFiles()), len(everything.inputFiles())
    assert there >= 20 and 0 < opened <= there / 4
    # What was not opened begins after the quotas are full.
    assert chosen.where("g = 'g0'").count() >= 400


def test_the_catalogue_is_no_part_of_the_pool(spark, pool):
    df, path = pool
    assert spark.read.parquet(path).count() == df.count() and spark.read.parquet(path).columns == df.columns


def test_an_empty_pool(spark, tmp_path):
    path = str(tmp_path / "pool")
    pools.write_pool(spark.createDataFrame([], "id long, g string, v long"), path, "g", "v", 4)
    assert s.head_of_pool(spark, path, "g", {"a": 3}, ["v", "id"]).count() == 0
