"""Key types, NULLs and wide numbers in the shared helpers."""

import pytest
from pyspark.sql import functions as F

from curate.functions import scores, vectors
from curate.operators import ranking, reports, sampling, skew, sweeps
from curate.operators.games import filter_games
from curate.sources import suites


def one(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize("left,right", [("int", "bigint"), ("bigint", "decimal(10,0)"), ("float", "double"), ("date", "timestamp"), ("decimal(5,2)", "decimal(9,4)")])
def test_keys_of_two_types_meet(spark, left, right):
    value = "date'2024-01-02'" if left == "date" else "2"
    a = spark.sql(f"select cast({value} as {left}) k, 1 v union all select null, 2")
    b = spark.sql(f"select cast({value} as {right}) k, 7 w")
    assert skew.join_unique(a, b, "k").where("w = 7").count() == 1
    assert skew.join_unique(a, b, "k", "left_semi").count() == 1


def test_zeros_of_two_signs_meet_and_foreign_types_are_an_error(spark):
    a, b = spark.sql("select -0.0D k"), spark.sql("select 0.0D k, 1 w")
    assert skew.join_unique(a, b, "k", "inner").count() == 1
    with pytest.raises(TypeError):
        skew.join_unique(spark.sql("select 'x' k"), spark.sql("select 1 k, 1 w"), "k")


@pytest.mark.parametrize("scale", [1, 1_000_003, 10**12])
def test_running_with_null_keys_and_any_step(spark, scale):
    df = spark.createDataFrame([(None if i % 2 else 1, i * scale, i) for i in range(40)], "k int, o long, v int")
    got = skew.running(df, "k", "o", {"n": ("count", F.lit(1)), "s": ("sum", F.col("v"))}, span=3)
    for key in (None, 1):
        mine = sorted((r["o"], r["n"], r["s"]) for r in got.collect() if r["k"] == key)
        values = [i for i in range(40) if (i % 2 == 1) == (key is None)]
        assert mine == [(i * scale, k + 1, sum(values[: k + 1])) for k, i in enumerate(values)]
    whole = skew.running(df, [], "o", {"n": ("count", F.lit(1))}, span=7)
    assert sorted(r["n"] for r in whole.collect()) == list(range(1, 41))


def test_segments_follow_the_step_of_the_order(spark):
    df = spark.range(1000).select(F.lit(1).alias("k"), (F.col("id") * 1_000_000).alias("o"))
    plan = skew.running(df, "k", "o", {"n": ("count", F.lit(1))}, span=100)
    assert plan.agg(F.max("n")).first()[0] == 1000


def test_ranks_keep_rows_of_unknown_groups(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3), ("a", 4)], "g string, v int")
    for got in (ranking.ordered_rank(df, "g", ["v"]), ranking.seeded_rank(df, "g", "v", 1)):
        assert sorted(((r["g"] or ""), r["rank"]) for r in got.collect()) == [("", 1), ("", 2), ("a", 1), ("a", 2)]


def test_nothing_wanted_is_cut_from_wide_orders(spark):
    df = spark.range(20_000).select(F.lit("a").alias("g"), (F.lit(1_700_000_000_000_000_000) + F.col("id")).alias("o"))
    assert ranking.cut_beyond(df, "g", "o", F.lit(30_000)).count() == 20_000
    kept = ranking.cut_beyond(df, "g", "o", F.lit(5_000))
    assert kept.where(F.col("o") < 1_700_000_000_000_005_000).count() == 5_000


def test_unknown_scores_stay_unknown(spark):
    none = F.lit(None).cast("int")
    assert one(spark, scores.clip_cp(none)) is None and one(spark, scores.elo_diff(none.cast("double"), 800)) is None
    assert one(spark, vectors.hard_ce(none, F.array(F.lit(0.1), F.lit(0.9)))) is None
    assert one(spark, scores.elo_diff(F.lit(1.0), 800)) == 800


def test_reports_leave_unknown_rows_out(spark):
    df = spark.createDataFrame([([0.1, 0.9], 0), ([0.1, 0.9], None)], "probs array<double>, true_cls int")
    row = reports.value_ce(df).first()
    assert row["n_rows"] == 1 and abs(row["value_ce"] - 2.302585) < 1e-5
    p = spark.createDataFrame([(0.25, True), (None, True)], "p double, hit boolean")
    assert [r["bin"] for r in reports.calibration(p, "p", "hit").collect()] == [2]


def test_unscored_moves_are_no_losses(spark):
    shape = "batch int, sims int, seconds double, cp_loss int, rank int, top_visit_frac double"
    df = spark.createDataFrame([(1, 10, 1.0, 10, 1, 0.5), (1, 10, 1.0, None, None, 0.5)], shape)
    assert sweeps.throughput(df).first()["mean_cp"] == 10


def test_games_of_unknown_event_pass(spark):
    df = spark.createDataFrame([(2500, 2500, "1-0", None), (2500, 2500, "1-0", "rated bullet"), (2500, 2500, "1-0", "Cup")], "white_elo int, black_elo int, result string, event string")
    assert sorted(str(r["event"]) for r in filter_games(df, min_elo=2000).collect()) == ["Cup", "None"]


def test_cut_off_documents_are_errors(spark, tmp_path):
    (tmp_path / "bad.json").write_text('{"meta": {"created": "x"}, "positions": [{"fen": "a", ')
    for read in (suites.read_suite, suites.read_sweep):
        with pytest.raises(Exception, match="(?i)malformed"):
            read(spark, str(tmp_path)).collect()


@pytest.mark.parametrize("span", [3, 50])
def test_running_where_orders_crowd(spark, span):
    """Nearly all orders stand close together, one far away: the crowded segment is cut again."""
    orders = [*range(200), 10**15]
    df = spark.createDataFrame([(k, o) for o in orders for k in (1, 2)], "k int, o long")
    cut = skew._segments(df, ["k"], "o", span)
    assert cut.groupBy("k", "_seg").count().agg(F.max("count")).first()[0] <= 2 * span
    got = skew.running(df, "k", "o", {"n": ("count", F.lit(1)), "m": ("max", F.col("o"))}, span=span).collect()
    assert sorted((r["k"], r["o"], r["n"], r["m"]) for r in got) == [(k, o, i + 1, o) for k in (1, 2) for i, o in enumerate(orders)]


def test_repeated_measurements_count_as_one(spark):
    made = [("b", 1, 10), ("b", 1, 20), ("x", 1, 5), ("x", 1, 7), ("x", 2, 9), ("x", 1, None), ("b", 2, None)]
    df = spark.createDataFrame(made, "cell string, position int, cp_loss int")
    one = sweeps.paired_delta(df, "b").collect()
    assert [(r["cell"], r["npair"], r["mean_delta"], r["better"]) for r in one] == [("x", 1, -9.0, 1)]
    chosen = [("a", "p", m, 1, 0) for m in ("e4", "d4", "d4")] + [("b", "p", "e4", 2, 5), ("b", "p", None, 1, 0), ("a", "q", "e4", 1, 0), ("a", "q", "d4", 1, 0)]
    rows = sweeps.disagreements(spark.createDataFrame(chosen, "batch string, position string, move string, rank int, cp_loss int")).collect()
    assert [(r["position"], r["n_moves"], {k: v["move"] for k, v in r["choices"].items()}) for r in rows] == [("p", 2, {"a": "d4", "b": "e4"})]
