import pytest
from pyspark.sql import functions as F

from curate.operators import edges as e
from curate.operators import sequences as s
from tests.conftest import rows


def test_explode_plies_emits_no_end_position(spark):
    df = spark.createDataFrame([(1, "0-1", ["e4", "e5", "Ke2"]), (2, "*", ["d4"]), (3, "1-0", [])], "g int, result string, moves array<string>")
    got = rows(s.explode_plies(df), "g", "ply", "move", "turn", "wdl")
    assert got == [(1, 0, "e4", "w", 2), (1, 1, "e5", "b", 0), (1, 2, "Ke2", "w", 2), (2, 0, "d4", "w", None)]


def test_explode_lines_roles(spark):
    df = spark.createDataFrame([(1, ["a", "b", "c", "d"], "mate"), (2, ["a", "b", "c"], "fork"), (3, ["a"], "mate")], "p int, moves array<string>, themes string")
    got = rows(s.explode_lines(df, themes="themes"), "p", "step", "move", "role", "wdl")
    assert got == [(1, 1, "b", "solver", 0), (1, 2, "c", "defender", 2), (1, 3, "d", "solver", 0), (2, 1, "b", "solver", 0)]
    assert s.explode_lines(df, want_defenders=False).where("role = 'defender'").count() == 0


@pytest.fixture(scope="module")
def steps(spark):
    return spark.createDataFrame(
        [("a", 0, True, False), ("a", 1, False, False), ("a", 2, True, True), ("b", 0, True, False), ("b", 1, True, True), ("c", 0, None, True), ("d", 0, True, False)],
        "k string, i int, ok boolean, mate boolean",
    )


def test_take_while_valid(steps):
    assert rows(s.take_while_valid(steps, "k", "i", "ok"), "k", "i") == [("a", 0), ("b", 0), ("b", 1), ("d", 0)]


def test_complete_only(steps):
    assert rows(s.complete_only(steps, "k", "i", "mate"), "k", "i") == [("a", 0), ("a", 1), ("a", 2), ("b", 0), ("b", 1), ("c", 0)]
    assert rows(s.complete_only(steps, "k", "i", "mate", "ok"), "k", "i") == [("b", 0), ("b", 1)]


def test_assign_targets(spark):
    df = spark.createDataFrame([("g", 3, "w"), ("g", 5, "b"), ("g", 9, "w")], "k string, i int, turn string")
    for result, want in (("1-0", [1.0, -1.0, 1.0]), ("0-1", [-1.0, 1.0, -1.0]), ("1/2-1/2", [0.0, 0.0, 0.0])):
        got = s.assign_targets(df.withColumn("result", F.lit(result)), "k", "i", "result", "turn", span=4).orderBy("i").collect()
        assert [r.value_target for r in got] == want and [r.moves_left_target for r in got] == [3, 2, 1]


@pytest.mark.parametrize("span", [2, 5, 100])
def test_resign_streak_counts_both_sides_and_resets(spark, span):
    q = [-0.9, -0.9, -0.9, 0.0, -0.9, -0.95, -0.99, -0.9, -0.9, 0.1]
    df = spark.createDataFrame([("g", i, v, "w" if i % 2 == 0 else "b", False) for i, v in enumerate(q)] + [("h", 0, -1.0, "w", False)], "k string, i int, q double, turn string, playout boolean")
    events = s.resign_events(df, "k", "i", "q", "turn", -0.8, span=span)
    assert rows(events) == [("g", 7, "b")]
    assert rows(s.truncate_at(df, events, "k", "i", "playout"), "k", "i") == [("g", i) for i in range(7)] + [("h", 0)]
    assert s.truncate_at(df.withColumn("playout", F.lit(True)), events, "k", "i", "playout").count() == 11


def test_repetition_and_status(spark):
    df = spark.createDataFrame([("g", i, p, c) for i, (p, c) in enumerate([("x", 0), ("y", 1), ("x", 2), ("y", 3), ("x", 8), ("z", 100)])], "k string, i int, p string, clock int")
    seen = s.repetition(df, "k", "p", "i", span=3)
    assert [r.seen for r in seen.orderBy("i").collect()] == [1, 1, 2, 2, 3, 1]
    status = s.game_status(seen, "clock", "seen", F.lit(False), F.lit(False), F.lit(False), "i", 3).orderBy("i").collect()
    assert [r.status for r in status] == ["ongoing", "ongoing", "ongoing", "ply_cap", "threefold", "fifty_move"]
    assert [r.claimable for r in status] == [False] * 4 + [True, True]


def test_status_order(spark):
    df = spark.createDataFrame([(100, 3)], "clock int, seen int")
    def first(insufficient, mate, stalemate):
        return s.game_status(df, "clock", "seen", F.lit(insufficient), F.lit(mate), F.lit(stalemate)).first().status

    assert first(True, True, False) == "checkmate" and first(True, False, True) == "stalemate" and first(True, False, False) == "fifty_move"


def test_temperature(spark):
    assert [r.temperature for r in s.with_temperature(spark.range(32).withColumnRenamed("id", "ply")).orderBy("ply").collect()] == [1.0] * 30 + [0.0] * 2


def test_best_candidate(spark):
    schema = "p string, m string, own int, after int, dtz int, seen boolean, mate boolean"
    df = spark.createDataFrame(
        [
            ("win", "a", 2, 2, -7, False, False), ("win", "b", 2, 2, -3, True, False), ("win", "c", 2, 2, 3, False, False), ("win", "d", 2, 0, 1, False, False),
            ("lose", "a", -2, -2, 4, False, False), ("lose", "b", -2, -2, -9, False, False),
            ("mate", "a", 2, 2, -1, False, False), ("mate", "z", 2, 2, -5, False, True),
            ("none", "b", 2, 1, -1, False, False), ("none", "c", 2, 0, 0, False, False),
        ],
        schema,
    )
    got = rows(s.best_candidate(df, "p", "m", "own", "after", "dtz", "seen", "mate"), "p", "m")
    assert got == [("lose", "b"), ("mate", "z"), ("none", "b"), ("win", "c")]


@pytest.mark.parametrize("t,want", [(1.0, [0.25, 0.75, 0.0]), (0, [0.0, 1.0, 0.0]), (0.5, [0.1, 0.9, 0.0])])
def test_visit_distribution(spark, t, want):
    df = spark.createDataFrame([("p", "a", 1), ("p", "b", 3), ("p", "c", 0)], "p string, m string, n int")
    got = s.visit_distribution(df, "p", "m", "n", t).orderBy("m").collect()
    assert [r.prob for r in got] == pytest.approx(want)


def test_visit_distribution_ties_and_no_visits(spark):
    df = spark.createDataFrame([("p", "a", 2), ("p", "b", 2), ("q", "a", 0), ("q", "b", 0)], "p string, m string, n int")
    assert rows(s.visit_distribution(df, "p", "m", "n", 0), "p", "m", "prob") == [("p", "a", 1.0), ("p", "b", 0.0), ("q", "a", 1.0), ("q", "b", 0.0)]
    assert {r.prob for r in s.visit_distribution(df, "p", "m", "n").where("p = 'q'").collect()} == {0.5}


def test_masked_softmax_rows_sums_to_one(spark):
    df = spark.createDataFrame([("p", "a", 1000.0, True), ("p", "b", 999.0, True), ("p", "c", 5000.0, False)], "p string, m string, z double, ok boolean")
    got = e.masked_softmax_rows(df, "p", "m", "z", "ok").orderBy("m").collect()
    assert [r.m for r in got] == ["a", "b"] and sum(r.prior for r in got) == pytest.approx(1.0) and got[0].prior == pytest.approx(0.7310586)


def test_top_moves(spark):
    df = spark.createDataFrame([("p", "a", 5, 0.1), ("p", "b", 5, 0.3), ("p", "c", 10, 0.0), ("q", "a", 0, 0.5)], "pos string, m string, N int, P double")
    got = rows(e.top_moves(df, "pos", "m", 2), "pos", "m", "place", "share")
    assert got == [("p", "b", 2, 0.25), ("p", "c", 1, 0.5), ("q", "a", 1, 0.0)]


def test_schedules(spark):
    openings = spark.range(5).withColumnRenamed("id", "o")
    paired = s.paired_schedule(openings, "o")
    assert paired.count() == 10 and paired.groupBy("o").agg(F.count_distinct("a_is_white").alias("n")).where("n <> 2").count() == 0
    assert rows(s.paired_schedule(openings, "o", "halves").where("a_is_white"), "o") == [(0,), (1,)]


def test_sweep_grid_tells_null_from_zero(spark):
    c = spark.createDataFrame([(1.5,), (3.0,)], "c_puct double")
    done = spark.createDataFrame([(1.5, None), (3.0, 0.0)], "c_puct double, fpu double")
    got = {tuple(r) for r in s.sweep_grid(c, [None, 0.0], done).collect()}
    assert got == {(1.5, 0.0), (3.0, None)}
