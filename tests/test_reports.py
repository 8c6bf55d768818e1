import pytest
from pyspark.sql import functions as F

from curate.operators import reports as r
from curate.plans.model_audit import audit
from tests.conftest import rows


@pytest.fixture(scope="module")
def scored(spark):
    return spark.createDataFrame(
        [("a", [0.8, 0.1, 0.1], 0), ("a", [0.2, 0.5, 0.3], 0), ("b", [1.0, 0.0, 0.0], 2), ("b", [0.05, 0.9, 0.05], 1)],
        "g string, probs array<double>, true_cls int",
    )


def test_group_report(scored):
    got = {x.g: x for x in r.group_report(scored, "g").collect()}
    assert (got["a"].n_rows, got["a"].p_true, got["a"].acc) == (2, 0.5, 0.5)
    assert got["b"].mean_draw == 0.45 and got["b"].argmax_draw == 0.5 and got["b"].argmax_loss == 0.0


def test_calibration_last_bin_holds_one(scored):
    got = rows(r.calibration(scored, F.col("probs")[0], F.col("true_cls") == 0), "bin", "n_rows", "mean_p", "actual")
    assert got == [(0, 1, 0.05, 0.0), (2, 1, 0.2, 1.0), (8, 1, 0.8, 1.0), (9, 1, 1.0, 0.0)]
    assert r.ece(scored, F.col("probs")[0], F.col("true_cls") == 0).first().ece == pytest.approx((0.05 + 0.8 + 0.2 + 1.0) / 4)


def test_value_ce_floors_zero_probabilities(scored):
    got = {x.g: x for x in r.value_ce(scored, "g").collect()}
    assert got["b"].value_ce == pytest.approx((20.7232658 + 0.1053605) / 2) and got["b"].acc == 0.5


def test_weighted_metrics_denominators_differ(spark):
    df = spark.createDataFrame(
        [("game", 2.0, True, 1.0, True, 1.0), ("game", 9.0, True, 1.0, False, 0.0), ("tablebase", 5.0, False, 0.0, True, 0.0)],
        "source string, ploss double, pmatch boolean, vloss double, vmatch boolean, weight double",
    )
    got = {x.source: x for x in r.weighted_metrics(df).collect()}
    assert (got["game"].policy_loss, got["game"].policy_acc, got["game"].value_acc) == (1.0, 1.0, 0.5)
    assert got["tablebase"].policy_acc == 0.0 and got[None].policy_loss == pytest.approx(2 / 3) and got[None].policy_acc == 1.0
    assert got["game"].loss == 2.0


def test_entropy_floor_of_one_hot_targets_is_zero(spark):
    df = spark.createDataFrame([("t", [1.0, 0.0, 0.0], 0.3), ("g", [0.5, 0.5, 0.0], 0.8)], "source string, target array<double>, ce double")
    got = {x.source: x for x in r.entropy_floor(df, "target", "ce").collect()}
    assert got["t"].floor == 0.0 and got["t"].excess == pytest.approx(0.3) and got["g"].excess == pytest.approx(0.8 - 0.6931472)


def test_agreement_per_phase(spark):
    df = spark.createDataFrame([(0.5, 0.4, 30), (0.6, 0.8, 30), (0.1, 0.1, 5)], "p double, q double, n int")
    got = {(x.overall, x.phase): x for x in r.agreement(df, "p", "q", "n").collect()}
    assert got[1, None].mae == pytest.approx(0.1) and got[0, "opening"].mae == pytest.approx(0.15) and got[0, "endgame"].mae == 0.0


def test_agreement_matrix(spark):
    df = spark.createDataFrame([(0, 900, 50, 50), (0, 100, 800, 100), (2, 0, 10, 990), (1, None, None, None)], "wdl int, w int, d int, l int")
    got = {x.outcome: x for x in r.agreement_matrix(df).collect()}
    assert got[0].share_drawn == 0.5 and got[2].agreement == 1.0 and got[None].agreement == pytest.approx(2 / 3) and 1 not in got


def test_segment_table_minimum_and_order(spark):
    df = spark.range(90).select(
        F.when(F.col("id") < 30, "KR v K").when(F.col("id") < 80, "KQ v K").otherwise("KP v K").alias("sig"),
        F.when(F.col("id") % 10 == 0, "win_train").otherwise("draw_train").alias("grp"),
        F.array(F.lit(0.1), F.lit(0.8), F.lit(0.1)).alias("probs"),
    )
    got = [(x.sig, x.n_rows, x.acc) for x in r.segment_table(df, "sig", group="grp").collect()]
    assert got == [("KQ v K", 45, 1.0), ("KR v K", 27, 1.0)]


def test_coverage_ledger_and_batches(spark):
    df = spark.createDataFrame([(1, None), (2, 5), (3, 5), (4, 5)], "i int, w int")
    assert tuple(r.coverage(df).first()) == (4, 3, 75.0)
    ledger = spark.createDataFrame([("1-0", 40, 0, 20.0, 40), ("1/2-1/2", 10, 2, 10.0, 20)], "result string, n_positions int, n_skipped int, seconds double, n_moves int")
    assert tuple(r.ledger_totals(ledger).first()) == (2, 50, 2, 1, 0, 1, 0.5)
    assert tuple(r.batch_stats(spark.createDataFrame([(8, 2), (4, 0)], "n_rows int, hits int")).first()) == (2, 12, 6.0, 2, 10)


def test_audit_rows(scored):
    got = dict(rows(audit(scored, "g")))
    assert set(got) == {"a.p_true", "a.acc", "b.p_true", "b.acc", "value_ce", "acc", "ece"} and got["acc"] == 0.5


def test_odd_probabilities_are_in_no_bin(spark):
    nan = float("nan")
    df = spark.createDataFrame([(0.25, 1.0), (nan, 1.0), (-0.05, 1.0), (1.5, 0.0), (None, 1.0), (0.5, None), (0.5, nan), (0.0, 0.0)], "p double, hit double")
    assert rows(r.calibration(df, "p", "hit")) == [(0, 1, 0.0, 0.0), (2, 1, 0.25, 1.0)]
    assert tuple(r.ece(df, "p", "hit").first()) == (pytest.approx(0.375), 2)
