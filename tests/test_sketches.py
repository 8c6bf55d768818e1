import pytest
from pyspark.sql import functions as F

from curate.operators import sketches as k


def test_batches_are_united(spark, tmp_path):
    path = str(tmp_path / "sketches")
    for name, lo, hi in (("a", 0, 60_000), ("b", 30_000, 90_000), ("b", 30_000, 90_000)):
        k.write_sketch(spark.range(lo, hi).select(F.when(F.col("id") % 1000 > 0, F.col("id")).alias("fen")), "fen", path, name)
    got = k.unique_estimate(k.read_sketches(spark, path)).first()
    assert got.n_rows == 120_000 and got.n_unique == pytest.approx(90_000 - 90, rel=0.02)


def test_old_batches_are_not_read_again(spark, tmp_path):
    path = str(tmp_path / "sketches")
    k.write_sketch(spark.range(1000), "id", path, "a")
    read = k.unique_estimate(k.read_sketches(spark, path))
    assert read.inputFiles() and all(path in f for f in read.inputFiles())


def test_what_is_left_to_do(spark):
    wanted = k.key_sketch(spark.range(50_000).selectExpr("cast(id as string) a", "id % 3 b"), ["a", "b"])
    done = k.key_sketch(spark.range(20_000, 80_000).selectExpr("cast(id as string) a", "id % 3 b"), ["a", "b"])
    got = k.worklist_estimate(wanted, done).first()
    assert got.n_rows == 50_000 and got.n_unique == pytest.approx(50_000, rel=0.02) and got.n_todo == pytest.approx(20_000, abs=0.02 * 80_000)


def test_nothing(spark):
    empty = k.key_sketch(spark.range(0), "id")
    assert tuple(k.worklist_estimate(empty, empty).first()) == (0, 0, 0)
