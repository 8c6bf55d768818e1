import pytest
from pyspark.sql import functions as F

from curate.functions import labels, names, scores, vectors
from curate.functions.seeded import seeded_int, seeded_key


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


@pytest.mark.parametrize(
    "result,turn,want",
    [("1-0", "w", 0), ("1-0", "b", 2), ("0-1", "w", 2), ("0-1", "b", 0), ("1/2-1/2", "w", 1), ("1/2-1/2", "b", 1), ("*", "w", None)],
)
def test_wdl_class(spark, result, turn, want):
    assert one(spark, labels.wdl_class(F.lit(result), F.lit(turn))) == (want,)


def test_tb_class_counts_fifty_move_results_as_draws(spark):
    df = spark.createDataFrame([(v,) for v in (2, 1, 0, -1, -2, None)], "s int")
    assert [r[0] for r in df.select(labels.tb_class("s")).collect()] == [0, 1, 1, 1, 2, None]


def test_outcome_onehot(spark):
    df = spark.createDataFrame([(v,) for v in (1, 0, -1, 5)], "v int")
    assert [r[0] for r in df.select(labels.outcome_onehot("v")).collect()] == [[1, 0, 0], [0, 1, 0], [0, 0, 1], [0, 0, 0]]


def test_wdl_scalar_sizes(spark):
    three, alone = F.array(F.lit(0.5), F.lit(0.3), F.lit(0.2)), F.array(F.lit(-0.25))
    assert one(spark, labels.wdl_scalar(three), labels.wdl_scalar(alone)) == (pytest.approx(0.3), -0.25)
    with pytest.raises(Exception, match="value vector of size 2"):
        one(spark, labels.wdl_scalar(F.array(F.lit(0.5), F.lit(0.3))))


def test_blend_follows_lambda_towards_the_annotation(spark):
    args = [F.lit(v) for v in (0, 200, 600, 200)]
    assert one(spark, labels.blend(*args, lam=0.25))[0] == pytest.approx([0.8, 0.15, 0.05])
    none = F.lit(None).cast("int")
    assert one(spark, labels.blend(F.lit(2), none, none, none))[0] == [0.0, 0.0, 1.0]


def test_source_of(spark):
    assert one(spark, *[labels.source_of(F.lit(p)) for p in ("/a/pool_games_w3.csv", "pool_puzzles.csv", "/p/pool_tablebase_w1/part-0")]) == (
        "game",
        "puzzle",
        "tablebase",
    )
    with pytest.raises(Exception, match="unknown pool file"):
        one(spark, labels.source_of(F.lit("/a/pool.csv")))


def test_priority_is_case_sensitive(spark):
    df = spark.createDataFrame([("mateIn2 short",), ("rookEndgame",), ("endgame",), ("Mate",)], "t string")
    assert [r[0] for r in df.select(labels.is_priority("t")).collect()] == [True, False, True, False]


def test_clip_cp(spark):
    assert one(spark, scores.clip_cp(F.lit(40000)), scores.clip_cp(F.lit(-5)), scores.clip_cp(F.lit(0), F.lit(-3))) == (32000, -5, -32000)


def test_elo_diff_at_the_ends(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (0.5,), (0.999,)], "s double")
    got = [tuple(r) for r in df.select(scores.elo_diff("s"), scores.elo_diff("s", 800)).collect()]
    assert got[0] == (None, -800.0) and got[1] == (None, 800.0) and got[2] == (0.0, 0.0)
    assert got[3][0] > 800 and got[3][1] == 800.0


def test_phase_edges(spark):
    df = spark.createDataFrame([(p,) for p in (32, 25, 24, 13, 12, 2, 1)], "p int")
    want = ["opening", "opening", "middlegame", "middlegame", "endgame", "endgame", None]
    assert [r[0] for r in df.select(scores.phase("p")).collect()] == want


def test_should_checkpoint(spark):
    kept = [r[0] for r in spark.range(1, 201).where(scores.should_checkpoint("id")).collect()]
    assert kept == [*range(1, 13), 16, 20, 24, 28, 32, 36, 40, 80, 120, 160, 200]


def test_disagree(spark):
    df = spark.createDataFrame([(0.2, -0.2), (0.2, 0.3), (0.1, -0.9), (0.2, -0.15)], "q double, r double")
    assert [r[0] for r in df.select(scores.disagree("q", "r")).collect()] == [True, False, False, False]


@pytest.mark.parametrize(
    "name,want",
    [("small_network_v0.weights.h5", 0), ("/full/path/to/small_network_v10.weights.h5", 10), ("big.weights.h5", -1), ("/v7/net.weights.h5", -1)],
)
def test_artifact_version(spark, name, want):
    assert one(spark, names.artifact_version(F.lit(name))) == (want,)


def test_label_and_cell_key(spark):
    label = names.checkpoint_label(F.lit("/x/sl_final.weights.h5"))
    none, zero = names.cell_key(F.lit(1.5), F.lit(None).cast("double")), names.cell_key(F.lit(1.5), F.lit(0.0))
    assert one(spark, label, none, zero) == ("final", "cpuct=1.50,fpu=None", "cpuct=1.50,fpu=0.00")


def test_vector_functions(spark):
    half = F.array(F.lit(0.5), F.lit(0.5), F.lit(0.0))
    hot = F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0))
    got = one(spark, vectors.entropy(half), vectors.entropy(hot), vectors.soft_ce(hot, half), vectors.hard_ce(F.lit(2), half))
    assert got == (pytest.approx(0.6931472), 0.0, pytest.approx(0.6931472), pytest.approx(20.7232658))


def test_argmax_takes_the_first_maximum(spark):
    assert one(spark, vectors.argmax(F.array(F.lit(0.4), F.lit(0.4), F.lit(0.2)))) == (0,)


def test_logit_ce_is_stable_and_softmax_is_masked(spark):
    z = F.array(F.lit(1000.0), F.lit(999.0), F.lit(-1000.0))
    ce, p = one(spark, vectors.logit_ce(z, F.lit(0)), vectors.masked_softmax(z, F.array(F.lit(1), F.lit(2))))
    assert ce == pytest.approx(0.3132617)
    assert p[0] == 0.0 and sum(p) == pytest.approx(1.0)


def test_seeded_draws_repeat(spark):
    a = spark.range(100).select(seeded_int(5, 31, "id"))
    assert a.collect() == spark.range(100).repartition(7).orderBy("id").select(seeded_int(5, 31, "id")).collect()
    assert one(spark, seeded_key(7, F.lit("x"))) == one(spark, F.md5(F.lit("7:x")))
    assert {r[0] for r in spark.range(2000).select(seeded_int(5, 31, "id")).collect()} == set(range(31))
