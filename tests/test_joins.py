import pytest
from pyspark.sql import functions as F

from curate.operators import joins as j
from curate.operators import scoring
from tests.conftest import rows


def test_join_annotations_is_idempotent_and_skips_sources(spark):
    df = spark.createDataFrame([("a", 0), ("b", 1), ("a", 2), ("c", 0)], "fen string, source_id int")
    ann = spark.createDataFrame([("a", 5, 10, 20, 970)], "fen string, cp int, w int, d int, l int")
    once = j.join_annotations(df, ann)
    assert sorted(map(str, rows(once))) == sorted(
        map(str, [("a", 0, 10, 20, 970), ("a", 2, None, None, None), ("b", 1, None, None, None), ("c", 0, None, None, None)])
    )
    again = j.join_annotations(once, ann)
    assert again.columns == once.columns and sorted(map(str, again.collect())) == sorted(map(str, once.collect()))
    assert tuple(j.annotation_report(once).first()) == (1, 2, pytest.approx(33.333333))


def test_annotated_rows_are_joined_without_a_sort(spark):
    df = spark.range(100).selectExpr("id % 7 fen", "0 source_id")
    ann = spark.range(1000).selectExpr("id % 50 fen", "id w", "id d", "id l")
    joined = j.join_annotations(df, ann)._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in joined and "SortMergeJoin" not in joined


def test_worklist_first_seen_order(spark):
    df = spark.createDataFrame([("b", 0, 3), ("a", 0, 1), ("b", 0, 0), ("t", 2, 2), ("c", 1, 4)], "fen string, source_id int, i int")
    done = spark.createDataFrame([("c",)], "fen string")
    assert [r.fen for r in j.worklist(df, done, order=["i"]).orderBy("i").collect()] == ["b", "a"]
    assert tuple(j.worklist_report(df, done).first()) == (5, 4, 3)
    assert j.worklist_report(df, done, approximate=True).first().n_unique == 4


def test_require_complete(spark):
    work = spark.createDataFrame([("a",), ("b",)], "fen string")
    j.require_complete(work, work)
    with pytest.raises(ValueError, match="1 keys are not annotated"):
        j.require_complete(work, work.where("fen = 'a'"))


def test_score_choice_fails_loud(spark):
    suite = spark.createDataFrame([("p", "x", 100, 1, 100), ("p", "y", -2000, 2, 100)], "position string, move string, cp int, rank int, best_cp int")
    ok = spark.createDataFrame([("p", "y")], "position string, move string")
    r = j.score_choice(ok, suite).first()
    assert (r.rank, r.cp_loss_raw, r.cp_loss) == (2, 2100, 1000) and r.esc_loss == pytest.approx(1 / (1 + 10**-0.25) - 1 / (1 + 10**5))
    miss = spark.createDataFrame([("p", "z")], "position string, move string")
    with pytest.raises(Exception, match="move not in the suite: p z"):
        j.score_choice(miss, suite).collect()
    audit = j.score_choice(miss, suite, strict=False).first()
    assert audit.found is False and audit.cp_loss is None


def test_asof_step(spark):
    df = spark.createDataFrame([(f,) for f in (-0.1, 0.0, 0.69, 0.7, 0.95)], "f double")
    assert [r.step_value for r in j.asof_step(df, "f").collect()] == [1e-4, 1e-4, 1e-4, 1e-5, 1e-6]


def test_join_predictions_last_wins(spark):
    df = spark.createDataFrame([("a",), ("b",)], "k string")
    p = spark.createDataFrame([("a", 1, 0.1), ("a", 2, 0.9)], "k string, seq int, p double")
    assert rows(j.join_predictions(df, p, "k", "seq", "p")) == [("a", 0.9)]


def test_compare_runs_keeps_the_left_metrics(spark):
    a = spark.createDataFrame([("x", 1.0), ("y", 2.0)], "metric string, value double")
    b = spark.createDataFrame([("x", 1.5), ("z", 3.0)], "metric string, value double")
    assert sorted(map(str, rows(j.compare_runs(a, b)))) == ["('x', 1.0, 1.5, 0.5)", "('y', 2.0, None, None)"]


def test_pending(spark):
    labels = spark.createDataFrame([("a",), ("b",), ("c",)], "label string")
    done = labels.where("label = 'a'")
    assert rows(j.pending(labels, done)) == [("b",), ("c",)]
    assert rows(j.pending(labels, done, only=["a", "b"])) == [("b",)]
    assert rows(j.pending(labels, done, force=True, only=["a"])) == [("a",)]


def test_check_compat(spark):
    schema = "field string, value string"
    have = spark.createDataFrame([("batch", "8"), ("seed", None)], schema)
    want = spark.createDataFrame([("batch", "16"), ("seed", None), ("depth", "12")], schema)
    assert sorted(map(str, rows(j.check_compat(have, want)))) == ["('batch', '8', '16')", "('depth', None, '12')"]


def test_exclude_ids(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "id int, v string")
    ids = spark.createDataFrame([(1,), (9,)], "id int")
    assert rows(j.exclude_ids(df, ids, "id")) == [(2, "c")] and tuple(j.skipped_ids(df, ids, "id").first()) == (2, 1)


def test_paired_uses_common_positions_only(spark):
    df = spark.createDataFrame(
        [("base", 1, 10), ("base", 2, 20), ("x", 1, 5), ("x", 3, 7), ("y", 2, 20)], "cell string, position int, cp_loss int"
    )
    assert rows(j.paired(df, "base"), "cell", "position", "delta") == [("x", 1, -5), ("y", 2, 0)]


def doubling():
    """Counts the rows it is given, so that repeated scoring shows."""

    def predict(x):
        assert x.dtype == "float32" and len(x) <= 4
        return x * 2

    return predict


def test_batch_score_and_score_distinct(spark):
    df = spark.range(23).select("id", (F.col("id") % 5).alias("k")).withColumn("x", F.array(F.col("k").cast("float")))
    plain = scoring.batch_score(df, doubling, "x", "y", batch=4)
    assert all(r.y == [2.0 * r.k] for r in plain.collect()) and plain.count() == 23
    once = scoring.score_distinct(df.select("id", "k", "x"), "k", doubling, "x", "y", batch=4)
    assert rows(once.select("id", F.col("y")[0])) == [(i, 2.0 * (i % 5)) for i in range(23)]


def test_repeated_annotations_and_unknown_sources(spark):
    df = spark.createDataFrame([("a", 0), ("a", None), ("b", 2), (None, 0), ("c", None)], "fen string, source_id int")
    ann = spark.createDataFrame([("a", 2, 7, 1, 2, 12), ("a", 1, 5, 3, 4, 12), ("a", 3, 9, 9, 9, 20), ("b", 1, 1, 1, 1, 12), (None, 1, 8, 8, 8, 12)], "fen string, at int, w int, d int, l int, depth int")
    joined = j.join_annotations(df, ann, order=["at"])
    assert sorted(str(tuple(r)) for r in joined.select("fen", "source_id", "w").collect()) == sorted(
        map(str, [("a", 0, 5), ("a", None, 5), ("b", 2, None), (None, 0, None), ("c", None, None)])
    )
    assert [r.w for r in j.join_annotations(df, ann, order=["at"], depth=20).collect() if r.fen == "a"] == [9, 9]
    assert tuple(j.annotation_report(joined).first()) == (2, 2, 50.0)
    assert sorted(r.fen for r in j.worklist(df, ann).collect()) == ["c"]
    assert sorted(r.fen for r in j.worklist(df, ann, depth=16).collect()) == ["a", "c"]
    report = j.worklist_report(df.where("fen in ('a', 'c')"), ann).first()
    assert tuple(report) == (3, 2, 1)
    assert tuple(j.missing_annotations(spark.createDataFrame([("a",), ("c",)], "fen string"), ann).first()) == (1, 1)


def test_keys_of_several_columns(spark):
    df = spark.createDataFrame([("a", 12), ("a", 20), ("a", 20)], "fen string, depth int")
    done = df.limit(1)
    assert rows(j.worklist(df, done, ["fen", "depth"], source=None)) == [("a", 20)]
    assert tuple(j.worklist_report(df, done, ["fen", "depth"]).first()) == (3, 2, 1)


def test_a_move_twice_in_the_suite_is_an_error(spark):
    suite = spark.createDataFrame([("p", "x", 100, 1, 100), ("p", "x", 95, 2, 100), ("p", "y", 0, 3, 100)], "position string, move string, cp int, rank int, best_cp int")
    choice = spark.createDataFrame([("p", "x")], "position string, move string")
    with pytest.raises(Exception, match="move twice in the suite: p x"):
        j.score_choice(choice, suite).collect()
    assert j.score_choice(choice.withColumn("move", F.lit("y")), suite).first().cp_loss == 100


def test_batch_score_of_odd_features(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, None), (3, [3.0, None]), (4, [5.0, 6.0])], "id int, x array<double>")
    got = {r.id: r.y for r in scoring.batch_score(df.coalesce(1), doubling, "x", "y").collect()}
    assert got == {1: [2.0, 4.0], 2: None, 3: None, 4: [10.0, 12.0]}
    assert scoring.batch_score(df.where("id = 2"), doubling, "x", "y").first().y is None
    assert scoring.batch_score(df.limit(0), doubling, "x", "y").count() == 0
    uneven = spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "id int, x array<double>").coalesce(1)
    with pytest.raises(Exception, match="feature lists of 1 and 2 values"):
        scoring.batch_score(uneven, doubling, "x", "y").collect()


def test_a_store_is_joined_with_one_shuffle(spark, tmp_path):
    from curate.sources.tables import save_store

    ann = spark.range(3000).selectExpr("cast(id % 2000 as string) fen", "id at", "cast(id as int) w", "1 d", "2 l")
    df = spark.range(5000).selectExpr("cast(id % 2500 as string) fen", "id", "case when id % 7 = 0 then 2 when id % 5 > 0 then 0 end source_id")
    save_store(ann, "store_of_test", buckets=4, order="at", path=str(tmp_path / "store"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = j.join_store(df, "store_of_test", buckets=4)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "Join" in plan
        key = lambda r: (r[0], r[1])
        want = j.join_annotations(df, ann, order=["at"]).select(got.columns)
        assert sorted(got.collect(), key=key) == sorted(want.collect(), key=key)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.sql("drop table store_of_test")


def test_score_choice_does_not_broadcast_exploded_moves(spark, tmp_path):
    # Two short columns on disk, many moves out of them.
    spark.range(100).select("id", F.lit(30).alias("n")).write.parquet(str(tmp_path / "suite"))
    moves = spark.read.parquet(str(tmp_path / "suite")).select(F.col("id").alias("position"), F.explode(F.sequence(F.lit(1), "n")).alias("rank"))
    suite = moves.select("position", F.concat(F.lit("m"), F.col("rank").cast("string")).alias("move"), (-F.col("rank")).alias("cp"), "rank", F.lit(-1).alias("best_cp"))
    choices = spark.range(300).select((F.col("id") % 100).alias("position"), F.lit("m3").alias("move"))
    scored = j.score_choice(choices, suite)
    assert scored.agg(F.count(F.lit(1)), F.sum("cp_loss")).first() == (300, 600)
    scored.collect()
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
