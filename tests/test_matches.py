import pytest

from checks import roles
from curate.operators import artifacts, matches, monitor, sweeps
from curate.plans.match_report import match_report
from tests.conftest import rows


def games(spark, records):
    """{label: (wins, draws, losses)} -> one row per game."""
    made = [(k, p) for k, (w, d, l) in records.items() for p in [1.0] * w + [0.5] * d + [0.0] * l]
    return spark.createDataFrame([(i, k, p) for i, (k, p) in enumerate(made)], "game int, label string, points double")


# Published records: W-D-L, score, interval, rating difference.
GOLDEN = {
    "v4-v3": ((54, 21, 25), 0.645, (0.5622, 0.7278), 103.7, "A stronger"),
    "v3-v4": ((25, 21, 54), 0.355, (0.2722, 0.4378), -103.7, "B stronger"),
    "26-4": ((26, 4, 0), 0.9333, None, None, "A stronger"),
    "24-6": ((24, 6, 0), 0.9, None, None, "A stronger"),
    "69": ((69, 15, 16), 0.765, None, 205.0, "A stronger"),
    "61": ((61, 17, 22), 0.695, None, 143.1, "A stronger"),
    "rl": ((1, 5, 44), 0.07, None, -449.4, "B stronger"),
}


def test_match_summary_golden(spark):
    got = {r.label: r for r in matches.match_summary(games(spark, {k: v[0] for k, v in GOLDEN.items()}), "label").collect()}
    for k, (wdl, score, ci, elo, verdict) in GOLDEN.items():
        r = got[k]
        assert (r.wins, r.draws, r.losses) == wdl and r.games == sum(wdl) and r.verdict == verdict
        assert r.score == pytest.approx(score, abs=1e-4)
        assert ci is None or (r.ci_low, r.ci_high) == pytest.approx(ci, abs=1e-4)
        assert elo is None or r.elo == pytest.approx(elo, abs=0.05)


def test_match_summary_edges(spark):
    got = {r.label: r for r in matches.match_summary(games(spark, {"one": (1, 0, 0), "even": (0, 4, 0)}), "label").collect()}
    assert got["one"].variance == 0.0 and got["one"].elo is None and got["one"].verdict == "A stronger"
    assert got["even"].verdict == "not significant" and got["even"].elo == 0.0


def test_gauntlet_clamps_and_orders(spark):
    out = matches.gauntlet(games(spark, {"final": (1, 0, 0), "10": (0, 0, 2), "9": (1, 0, 1), "002": (1, 1, 0)})).collect()
    assert [r.label for r in out] == ["002", "9", "10", "final"]
    assert out[2].elo == -800.0 and out[3].elo == 800.0


ANCHORS = list(range(1400, 2400, 100))
V4 = [(20, 0, 0), (17, 3, 0), (18, 1, 1), (11, 5, 4), (13, 1, 6), (8, 3, 9), (2, 9, 9), (0, 7, 13), (1, 5, 14), (1, 8, 11)]
RL = [(7, 1, 12), (5, 3, 12), (2, 2, 16), (0, 3, 17), (0, 3, 17), (1, 1, 18), (0, 1, 19), (0, 2, 18), (0, 2, 18), (0, 2, 18)]


def anchored(spark, table):
    made = [(n, a, p) for n, rec in table.items() for a, (w, d, l) in zip(ANCHORS, rec) for p in [1.0] * w + [0.5] * d + [0.0] * l]
    return spark.createDataFrame(made, "player string, anchor int, points double")


def test_anchored_elo_golden(spark):
    df = anchored(spark, {"v4": V4, "rl": RL, "rl3": RL[:3]})
    grid = {r.player: r for r in matches.anchored_elo(df, "player").collect()}
    exact = {r.player: r for r in matches.anchored_elo(df, "player", method="newton").collect()}
    assert exact["v4"].rating == pytest.approx(1917.2, abs=0.05) and exact["v4"].std_error == pytest.approx(31.3, abs=0.05)
    assert exact["rl"].rating == pytest.approx(1361.3, abs=0.05) and exact["rl3"].rating == pytest.approx(1330.5, abs=0.05)
    assert grid["v4"].rating == 1917 and grid["rl"].rating == 1361 and grid["v4"].games == 200
    assert 1850 <= grid["v4"].ci_low <= 1860 and 1975 <= grid["v4"].ci_high <= 1985


@pytest.mark.parametrize("low,high,step", [(0, 4000, 1), (1000, 2110, 1), (1500, 1920, 1), (0, 3999, 7)])
def test_coarse_to_fine_equals_the_full_grid(spark, low, high, step):
    import math

    table = {"v4": V4, "rl": RL, "all": [(5, 0, 0)] * 10, "none": [(0, 0, 5)] * 10}
    got = {r.player: r for r in matches.anchored_elo(anchored(spark, table), "player", low=low, high=high, step=step).collect()}
    for name, rec in table.items():
        def ll(r):
            total = 0.0
            for a, (w, d, l) in zip(ANCHORS, rec):
                pts, n = w + d / 2, w + d + l
                total += -pts * math.log1p(10 ** ((a - r) / 400)) - (n - pts) * math.log1p(10 ** ((r - a) / 400))
            return total

        curve = [(ll(r), -r) for r in range(low, high + 1, step)]
        best = max(curve)
        inside = [-r for v, r in curve if v >= best[0] - 1.92]
        assert (got[name].rating, got[name].ci_low, got[name].ci_high) == (-best[1], min(inside), max(inside)), name


def test_newton_without_a_finite_maximum(spark):
    df = anchored(spark, {"all": [(5, 0, 0)] * 10})
    assert matches.anchored_elo(df, "player", method="newton").first().rating is None
    with pytest.raises(ValueError, match="unknown method"):
        matches.anchored_elo(df, "player", method="other")


def test_intervals_at_the_ends_of_the_grid_are_marked(spark):
    df = anchored(spark, {"v4": V4, "all": [(5, 0, 0)] * 10, "none": [(0, 0, 5)] * 10})
    got = {r.player: r.at_edge for r in matches.anchored_elo(df, "player").collect()}
    assert got == {"v4": False, "all": True, "none": True}


def test_places_of_labels(spark):
    df = spark.createDataFrame([("10",), ("9",), ("b",), ("a",), (None,)], "label string")
    got = {r.label: r.place for r in matches.order_labels(df, place="place").collect()}
    assert [got[x] for x in ("9", "10", "a", "b")] in ([1, 2, 3, 4], [1, 2, 4, 5]) and sorted(got.values()) == [1, 2, 3, 4, 5]
    assert [r.label for r in matches.order_labels(df.dropna()).collect()] == ["9", "10", "a", "b"]


def test_running_score_and_report(spark):
    report = match_report(games(spark, {"a": (1, 1, 1)}), "label", "game")
    got = report.progress.orderBy("game").select("points_so_far", "games_so_far", "score_so_far").collect()
    assert [tuple(r) for r in got] == [(1.0, 1, 1.0), (1.5, 2, 0.75), (1.5, 3, 0.5)]
    assert report.summary.first().score == 0.5 and report.curve.first().games == 3 and report.rating is None


def test_gate_counts_generations(spark):
    df = spark.createDataFrame([(1, 6.0), (1, 4.5), (2, 9.0), (3, 12.0)], "iteration int, points double")
    got = rows(matches.gate(df, start=3), "iteration", "cand_score", "accepted", "generation")
    assert got == [(1, 10.5, True, 4), (2, 9.0, False, 4), (3, 12.0, True, 5)]


def test_advantage_curve_needs_three_games(spark):
    df = spark.createDataFrame([(g, m, 100, g % 2 == 0) for g in range(4) for m in (1, 2) if m == 1 or g < 2], "g int, m int, cp int, a boolean")
    got = matches.advantage_curve(df, "g", "m", "cp", "a").collect()
    assert [(r.m, r.games, round(r.advantage, 9)) for r in got] == [(1, 4, 0.0)]


def test_resign_fp(spark):
    ledger = spark.createDataFrame(
        [("1-0", True, "white"), ("0-1", True, "white"), ("1/2-1/2", True, "black"), ("1-0", True, None), ("1-0", False, "white")],
        "result string, resign_playout boolean, would_resign_side string",
    )
    assert tuple(matches.resign_fp(ledger).first()) == (4, 3, 2, pytest.approx(2 / 3))


def test_latest_and_retention(spark):
    df = spark.createDataFrame([("/w/small_network_v2.weights.h5",), ("/w/big_network_v9.weights.h5",), ("/w/small_network_v10.weights.h5",)], "path string")
    assert artifacts.latest(df, "small_network").first().path.endswith("small_network_v10.weights.h5")
    assert artifacts.latest(df, "tiny").first().version == 10
    with pytest.raises(Exception, match="no artifact found"):
        artifacts.latest(df.limit(0), "x").collect()
    kept = artifacts.retention(spark.range(1, 26).withColumnRenamed("id", "generation")).where("keep")
    assert rows(kept, "generation") == [(10,), (20,), (23,), (24,), (25,)]


def test_best_so_far_is_a_fold(spark):
    values = [1.0, 0.99995, 0.99991, 0.9, 0.95, 0.89995, 0.8]
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(values)] + [("b", 0, 5.0), ("b", 1, None), ("b", 2, 4.0)], "run string, step int, v double")
    assert rows(monitor.best_so_far(df, "run", "step", "v"), "run", "step") == [("a", 0), ("a", 3), ("a", 6), ("b", 0), ("b", 2)]
    assert rows(monitor.best_so_far(df, "run", "step", "v", eps=0, span=2), "run", "step") == [
        ("a", 0), ("a", 1), ("a", 2), ("a", 3), ("a", 5), ("a", 6), ("b", 0), ("b", 2),
    ]


def test_sweep_metrics(spark):
    df = spark.createDataFrame(
        [("x", 100, 0, 0.0, 1, 0.5, 1.0), ("x", 100, 1500, 0.4, 9, 0.3, 2.0), ("x", 800, 150, 0.1, 3, 0.4, 8.0), ("y", 100, None, None, None, 0.1, 1.0)],
        "cell string, milestone int, cp_loss_raw int, esc_loss double, rank int, topvis double, elapsed double",
    )
    got = {(r.cell, r.milestone): r for r in sweeps.cell_metrics(df).collect()}
    a = got["x", 100]
    assert (a.n, a.mean_cp, a.med_cp, a.blun100, a.blun300, a.top1, a.mean_rank) == (2, 500.0, 500.0, 50.0, 50.0, 50.0, 5.0)
    assert ("y", 100) not in got
    best = sweeps.best_milestone(sweeps.cell_metrics(df)).first()
    assert (best.best_milestone, best.last_is_best, best.place) == (800, True, 1)


def test_disagreements(spark):
    df = spark.createDataFrame([(1, "p", "e4", 1, 0), (8, "p", "d4", 2, 9), (1, "q", "e4", 1, 0), (8, "q", "e4", 1, 0)], "batch int, position string, move string, rank int, cp_loss int")
    got = sweeps.disagreements(df).collect()
    assert [r.position for r in got] == ["p"] and got[0].choices[8].move == "d4" and got[0].n_moves == 2


@pytest.mark.parametrize("values, want", [([float("nan"), 0.5, 0.1], [1, 2]), ([0.5, float("nan"), 0.1], [0, 2]), ([0.5, 0.1, float("nan")], [0, 1]), ([float("nan")], []), ([None, 0.5, None, 0.5], [1])])
@pytest.mark.parametrize("eps", [0, 1e-4])
def test_values_that_are_no_numbers_beat_nothing(spark, values, want, eps):
    log = spark.createDataFrame([("r", i, v) for i, v in enumerate(values)], "run string, step long, v double")
    assert [r.step for r in monitor.best_so_far(log, "run", "step", "v", eps).orderBy("step").collect()] == want


def test_lines_are_joined_with_their_games_without_a_sort(spark, sf):
    plan = roles.plies(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "Sort" not in plan.replace("ShuffledHashJoin", "")
