import os

from pyspark.sql import functions as F

from curate.plans.training_set import annotation_worklist, build_training_set
from curate.sources.chunks import read_chunks, stored_chunk_sizes
from tests.conftest import rows

FEN = "4k3/8/8/8/8/8/4P3/4K2R w K - 0 "
QUOTAS = {("game", 0): 3, ("game", 1): 2, ("puzzle", 0): 1, ("tablebase", 1): 1}


def test_build_training_set(spark, tmp_path):
    base = spark.range(90).select(
        F.col("id").alias("rid"),
        F.concat(F.lit(FEN), (1 + F.col("id")).cast("string")).alias("fen"),
        F.when(F.col("id") % 5 > 0, F.col("id")).cast("int").alias("move_idx"),
    )
    pools = {
        "game": base.where("rid < 50").withColumn("wdl", (F.col("rid") % 2).cast("int")).withColumn("source_id", F.lit(0)),
        "puzzle": base.where("rid between 50 and 69").withColumn("wdl", F.lit(0)).withColumn("source_id", F.lit(1)),
        "tablebase": base.where("rid >= 70").withColumn("wdl", F.lit(1)).withColumn("source_id", F.lit(2)),
    }
    ann = base.where("rid % 2 = 0").select("fen", F.lit(500).alias("w"), F.lit(300).alias("d"), F.lit(200).alias("l"))
    path = str(tmp_path / "chunks")
    routed = build_training_set(pools, ann, path, "rid", quotas=QUOTAS, chunk_size=7)
    n = routed.plan.first().n_chunks
    assert n == 8
    assert rows(stored_chunk_sizes(spark, path)) == [(c, 7) for c in range(n)]
    got = read_chunks(spark, path)
    assert got.where("source_id = 2 and w is not null").count() == 0
    soft = got.where("w is not null")
    assert soft.where("source_id < 2 and rid % 2 = 1").count() == 0 and soft.count() > 0
    assert got.where((F.size("planes") != 1280) | (F.col("policy_weight") != F.col("move_idx").isNotNull().cast("double"))).count() == 0
    todo = annotation_worklist(routed, ann, ["rid"])
    assert todo.where("rid % 2 = 0").count() == 0 and todo.where("rid >= 70").count() == 0


def test_staged_tables_go_with_their_owner(spark, tmp_path):
    from curate.operators.ranking import ordered_rank
    from curate.storage import stage_path, staging

    kept = stage_path(spark, "kept")
    spark.range(3).write.parquet(kept)
    root = os.path.dirname(kept.removeprefix("file:"))
    before = set(os.listdir(root))
    with staging(spark):
        ordered_rank(spark.range(50), [], ["id"]).write.parquet(str(tmp_path / "ranked"))
    assert set(os.listdir(root)) == before and spark.read.parquet(str(tmp_path / "ranked")).count() == 50
