import datetime

import pytest
from pyspark.sql import functions as F

from curate.operators.games import filter_games
from curate.sources import artifacts, chunks, games, logs, suites, tables
from tests.conftest import rows

PGN = b"""% match A vs B
% score 0.5

[Event "x [raw]"]
[Site "?"]
[White "A \xff"]
[Black "B"]
[Result "1-0"]

1. e4 {best [by] test} e5 (1... c5 2. Nf3 (2. c3 d5) d6) 2. Nf3!? $14 Nc6 ; rest of line 3. Bb5
3. Bb5 a6
% an escape line
4. O-O 1-0

[Event "y"]
[White "B"]
[White "C"]
[Result "0-1?"]

1. d4 *
"""


def write(tmp_path, name, data):
    p = tmp_path / name
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_bytes(data if isinstance(data, bytes) else data.encode())
    return str(p)


def test_read_games(spark, tmp_path):
    path = write(tmp_path, "a.pgn", PGN)
    got = games.with_moves(games.read_games(spark, path)).orderBy(F.col("headers")["Event"]).collect()
    assert [r.headers["Event"] for r in got] == ["x [raw]", "y"]
    assert got[0].headers["White"] == "A �" and got[0].result == "1-0"
    assert got[0].moves == ["e4", "e5", "Nf3", "Nc6", "Bb5", "a6", "O-O"]
    assert got[1].headers["White"] == "C" and got[1].result == "*" and got[1].moves == ["d4"]


def test_games_may_begin_with_any_header(spark, tmp_path):
    one = '[Site "a"]\n[Round "1"]\n\n1. e4 {[%clk 0:01]\n[%eval 0.1]} e5 1-0\n\n[Site "b"]\n\n1. d4 *\n[Event "c"]\n\n1. c4 *\n[White "d"]\n1. f4 *\n'
    got = games.with_moves(games.read_games(spark, write(tmp_path, "s.pgn", one))).collect()
    assert sorted(next(iter(r.headers.values())) + r.moves[0] for r in got) == ["ae4", "bd4", "cc4", "df4"]
    assert {tuple(sorted(r.headers)) for r in got} == {("Round", "Site"), ("Site",), ("Event",), ("White",)}


def by_line(spark, path, size):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        df = games.read_games(spark, path, event_first=False)
        return df.rdd.getNumPartitions(), sorted((sorted(r.headers.items()), r.result, " ".join(r.movetext.split())) for r in df.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize("size", ["37", "64", "150", "1000000"])
def test_files_are_split_at_any_line(spark, tmp_path, size):
    """The same games wherever the splits fall: in headers, in moves, in blank lines, several splits in one game."""
    long = "\n".join(f"{i}. e4 e5" for i in range(1, 40))
    text = '% c\n\n[Site "a"]\n[Round "1"]\n\n1. e4 {[%clk 0:01]\n[%eval 0.1]} e5 1-0\n\n\n[Site "b"]\n\n1. d4 *\n[Event "c"]\n\n1. c4\n% x\n2. c5 0-1\n[White "d"]\n[Result "1/2-1/2"]\n' + long + '\n\n[Site "e"]\n1. f4 *'
    path = write(tmp_path, "s.pgn", text)
    write(tmp_path, "t.pgn", 'no game\n[Site "z"]\n\n1. h4 *\n')
    parts, got = by_line(spark, str(tmp_path), size)
    sites = [next(iter(dict(h).values())) if len(h) == 1 else h for h, _, _ in got]
    assert len(got) == 6 and "z" in sites and "e" in sites
    moves = {dict(h).get("Site", dict(h).get("White", dict(h).get("Event"))): (r, m) for h, r, m in got}
    assert moves["a"] == ("*", "1. e4 {[%clk 0:01] [%eval 0.1]} e5 1-0") and moves["c"][1] == "1. c4 2. c5 0-1"
    assert moves["d"] == ("1/2-1/2", " ".join(long.split())) and moves["e"][1] == "1. f4 *" and moves["z"][1] == "1. h4 *"
    assert parts > 4 or size in ("150", "1000000")
    assert path


def test_both_ways_of_splitting_read_the_same_games(spark, tmp_path):
    path = write(tmp_path, "a.pgn", PGN * 30)
    want = sorted((sorted(r.headers.items()), r.result, " ".join(r.movetext.split())) for r in games.read_games(spark, path).collect())
    assert by_line(spark, path, "500")[1] == want and len(want) == 60


def test_headers_before_event_are_an_error(spark, tmp_path):
    path = write(tmp_path, "t.pgn", '[Event "a"]\n\n1. e4 *\n\n[Site "x"]\n[Event "b"]\n\n1. d4 *\n')
    with pytest.raises(Exception, match="before Event"):
        games.read_games(spark, path).collect()


def test_metric_files_with_different_headers(spark, tmp_path):
    write(tmp_path, "a/metrics.csv", "epoch,global_chunk,chunk_file,loss,acc\r\n0,1,c.npz,0.5,\r\n0,2,\"c, d\",0.25,0.75\r\n")
    write(tmp_path, "b/metrics.csv", "epoch,global_chunk,val_loss\n1,7,3.5\n1,8")
    got = rows(logs.read_metrics_csv(spark, [str(tmp_path / "a"), str(tmp_path / "b")]).where("metric <> 'epoch'").fillna(-1.0))
    assert got == [("a", 1, "acc", -1.0), ("a", 1, "loss", 0.5), ("a", 2, "acc", 0.75), ("a", 2, "loss", 0.25), ("b", 7, "val_loss", 3.5), ("b", 8, "val_loss", -1.0)]
    write(tmp_path, "c/metrics.csv", "0,1,0.5\n")
    with pytest.raises(Exception, match="not one header"):
        logs.read_metrics_csv(spark, str(tmp_path / "c")).collect()


def test_a_cut_off_match_record_is_an_error(spark, tmp_path):
    record = '{\n  "v2": {"elo": 10.0, "games": 2, "label": "v2", "wins": 1, "draws": 1, "losses": 0, "path": "w", "score": 0.75}'
    assert rows(logs.read_gauntlet(spark, write(tmp_path, "good.json", record + "\n}\n"))) == [("v2", "w", 2, 1, 1, 0, 0.75, 10.0)]
    with pytest.raises(Exception, match="[Mm]alformed"):
        logs.read_gauntlet(spark, write(tmp_path, "bad.json", record[:-30])).collect()


def test_match_documents_stay_small(spark, tmp_path, monkeypatch):
    from checks import base, sourcing  # noqa: F401

    users = spark.range(10_000, 15_000).select(F.col("id").alias("user_id"), F.col("id").alias("event_id"), F.current_timestamp().alias("ts"), F.lit("purchase").alias("event_type"))
    users.write.parquet(str(tmp_path / "events.parquet"))
    read, documents = logs.read_gauntlet, []

    def spy(spark, path, document=True):
        documents.extend([path] if document else [])
        return read(spark, path, document)

    monkeypatch.setattr(logs, "read_gauntlet", spy)
    assert base.QUERIES["read_gauntlet"](spark, str(tmp_path)).where("form = 'document'").count() == 5000
    sizes = [r[0] for r in spark.read.text(documents[0], wholetext=True).select(F.size(F.json_object_keys("value"))).collect()]
    assert sum(sizes) == 5000 and max(sizes) < 1500


def test_read_games_without_leading_comments_and_over_splits(spark, tmp_path):
    one = '[Event "e{0}"]\r\n[Result "1/2-1/2"]\r\n\r\n1. e4 e5 1/2-1/2\r\n\r\n'
    path = write(tmp_path, "b.pgn", "".join(one.replace("{0}", str(i)) for i in range(500)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        df = games.with_moves(games.read_games(spark, path))
        assert df.rdd.getNumPartitions() > 4
        got = df.select(F.col("headers")["Event"], "result", F.size("moves")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(tuple(r) for r in got) == sorted((f"e{i}", "1/2-1/2", 2) for i in range(500))


def test_write_games_round_trip(spark, tmp_path):
    df = spark.createDataFrame([({"Event": "m", "White": "A"}, ["e4", "e5", "Nf3"], "1-0"), ({"Event": "n"}, [], "*")], "headers map<string,string>, moves array<string>, result string")
    path = str(tmp_path / "out")
    games.write_games(df, path, "A vs B: 2 games\n  score 0.5")
    text = "\n".join(r.value for r in spark.read.text(path).collect())
    assert "% A vs B: 2 games" in text and '[Black "?"]' in text and "1. e4 e5 2. Nf3 1-0" in text
    back = {r.headers["Event"]: r for r in games.with_moves(games.read_games(spark, path)).collect()}
    assert back["m"].moves == ["e4", "e5", "Nf3"] and back["m"].result == "1-0" and back["n"].moves == []


def test_filter_games(spark):
    df = spark.createDataFrame(
        [(2700, 2800, "1-0", "Rated Blitz", 9), (2699, 2800, "1-0", "Rated Blitz", 9), (2700, 2700, "*", "x", 9), (2700, 2700, "0-1", "Rated Bullet game", 9), (2700, None, "0-1", "x", 9), (2700, 2700, "0-1", "x", 7)],
        "white_elo int, black_elo int, result string, event string, n int",
    ).withColumn("moves", F.array_repeat(F.lit("m"), F.col("n")))
    assert filter_games(df).count() == 2 and filter_games(df, moves="moves").count() == 1


def test_read_puzzles(spark, tmp_path):
    path = write(tmp_path, "p.csv", "PuzzleId,FEN,Moves,Rating,Themes\n1,8/8 w - - 0 1,e2e4 e7e5,1500,mate mateIn1\n2,f,a1a2,1,endgame\n")
    got = tables.read_puzzles(spark, path).orderBy("PuzzleId").collect()
    assert got[0].Moves == ["e2e4", "e7e5"] and got[0].Themes == "mate mateIn1" and got[0].FEN == "8/8 w - - 0 1"
    assert tables.read_puzzles(spark, path, limit=1).count() == 1


def test_manifest_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("f w - -", None, 1), ("g b", 17, 0)], "fen string, move_idx int, wdl int")
    path = str(tmp_path / "pool_puzzles")
    tables.write_manifest(df, path)
    assert sorted(r.value for r in spark.read.text(path).collect()) == ["f w - -,-1,1", "g b,17,0"]
    assert sorted(map(str, rows(tables.read_manifest(spark, path, with_source=True)))) == ["('f w - -', None, 1, 'puzzle')", "('g b', 17, 0, 'puzzle')"]


def test_read_routed_by_field_count(spark, tmp_path):
    path = write(tmp_path, "c0001.txt", "f w,5,0,1\ng b,-1,1,2,-1,-1,-1\nh w,7,2,0,10,20,970\n\n")
    got = {r.fen: tuple(r)[1:] for r in tables.read_routed(spark, path).collect()}
    assert got == {"f w": (5, 0, 1, None, None, None), "g b": (None, 1, 2, None, None, None), "h w": (7, 2, 0, 10, 20, 970)}
    out = str(tmp_path / "again")
    tables.write_routed(tables.read_routed(spark, path), out)
    assert {r.fen: tuple(r)[1:] for r in tables.read_routed(spark, out).collect()} == got


def test_read_annotations_first_writer_wins(spark, tmp_path):
    write(tmp_path, "cache/sf_00.csv", "a w,1,10,20,970\nb b,2,1,2,997\na w,9,99,1,0\n")
    write(tmp_path, "cache/sf_01.csv", "b b,3,5,5,990\nc w,x,1,1,998\nd w,4,1,2\ne")
    got = {r.fen: tuple(r)[1:] for r in tables.read_annotations(spark, str(tmp_path / "cache")).collect()}
    assert got == {"a w": (1, 10, 20, 970), "b b": (2, 1, 2, 997), "c w": (None, 1, 1, 998)}


def test_write_annotations_by_shard(spark, tmp_path):
    df = spark.range(200).select(F.col("id").cast("string").alias("fen"), F.lit(1).alias("cp"), F.lit(2).alias("w"), F.lit(3).alias("d"), F.lit(4).alias("l"))
    path = str(tmp_path / "store")
    tables.write_annotations(df, path, 8)
    tables.write_annotations(df, path, 8)
    assert spark.read.text(path).select("shard").distinct().count() == 8
    assert rows(tables.read_annotations(spark, path).select("fen", "cp", "w", "d", "l")) == rows(df)


def test_ids(spark, tmp_path):
    path = str(tmp_path / "ids")
    tables.write_ids(spark.createDataFrame([("b",), ("a",), ("b",)], "id string"), path)
    assert rows(tables.read_ids(spark, path)) == [("a",), ("b",)]
    assert tables.read_ids(spark, str(tmp_path / "none")).count() == 0


def test_materialize_reuses_and_regenerates(spark, tmp_path):
    path = str(tmp_path / "positions")
    assert tables.materialize(spark.range(3), path).count() == 3
    assert tables.materialize(spark.range(9), path).count() == 3
    assert tables.materialize(spark.range(9), path, regen=True).count() == 9


SUITE = """{"meta": {"created": "2024", "suite_size": 2, "sf_depth": 16, "seed": 7},
 "positions": [{"fen": "p", "phase": "opening", "moves": [["e2e4", 60], ["d2d4", 10]]}, {"fen": "q", "moves": [["a2a3", 5], ["h2h3", -44]]}, {"fen": "r", "moves": [["x", 90], ["y", 0]]}]}"""


def test_read_suite(spark, tmp_path):
    path = write(tmp_path, "suite.json", SUITE)
    got = rows(suites.read_suite(spark, path), "fen", "phase", "uci", "cp", "rank", "best_cp")
    assert got == [("p", "opening", "d2d4", 10, 2, 60), ("p", "opening", "e2e4", 60, 1, 60), ("r", "?", "x", 90, 1, 90), ("r", "?", "y", 0, 2, 90)]
    assert suites.read_suite(spark, path, min_spread=0).count() == 6
    assert dict(rows(suites.suite_meta(spark, path)))["sf_depth"] == "16"


def test_read_sweep(spark, tmp_path):
    path = write(
        tmp_path,
        "sweep.json",
        """{"meta": {"batch_size": 8, "baseline": "k"},
        "cells": {"k": {"c_puct": 1.5, "fpu": null, "wall": 3.5, "rows": [{"fen": "p", "snaps": {"100": {"move": "e2e4", "elapsed": 0.5, "sims": 104, "topvis": 0.7}, "800": {"move": "d2d4", "elapsed": 2.5, "sims": 800, "topvis": 0.4}}}]}}}""",
    )
    got = sorted((r.cell, r.fpu, r.fen, r.milestone, r.move, r.sims) for r in suites.read_sweep(spark, path).collect())
    assert got == [("k", None, "p", 100, "e2e4", 104), ("k", None, "p", 800, "d2d4", 800)]


def test_chunks(spark, tmp_path):
    df = spark.range(100).select("id", (F.col("id") % 4).cast("int").alias("chunk_id"), F.array(F.col("id").cast("float")).alias("planes"))
    path = str(tmp_path / "chunks")
    chunks.write_chunks(df, path, "id")
    assert rows(chunks.stored_chunk_sizes(spark, path)) == [(0, 25), (1, 25), (2, 25), (3, 25)]
    one = chunks.read_chunks(spark, path, [2])
    assert one.count() == 25 and {r.id % 4 for r in one.collect()} == {2}
    assert "PartitionFilters: [isnotnull(chunk_id" in one._jdf.queryExecution().executedPlan().toString() or "PartitionFilters: [chunk_id" in one._jdf.queryExecution().executedPlan().toString()
    order = [r.id for r in one.collect()]
    assert order != sorted(order)


def test_metric_log_keeps_one_header(spark, tmp_path):
    path = str(tmp_path / "log")
    a = spark.createDataFrame([(1, 0.5)], "step int, loss double").withColumn("run", F.lit("r"))
    b = spark.createDataFrame([(2, 0.4, 0.9)], "step int, loss double, acc double").withColumn("run", F.lit("r"))
    logs.append_metrics(logs.to_long(a, "run", "step", ["loss"]), path)
    logs.append_metrics(logs.to_long(b, "run", "step", ["loss", "acc"]), path)
    got = logs.read_metrics(spark, path, ["loss", "acc"]).orderBy("step").collect()
    assert [tuple(r) for r in got] == [("r", 1, 0.5, None), ("r", 2, 0.4, 0.9)]


def test_summaries_by_tag(spark, tmp_path):
    path = str(tmp_path / "summaries")
    for tag, v in (("v3", 0.12), ("v4", 0.5), ("v4", 0.097)):
        logs.write_summary(spark.createDataFrame([("mae", v)], "metric string, value double"), path, tag)
    assert rows(logs.read_summary(spark, path), "metric", "value", "tag") == [("mae", 0.097, "v4"), ("mae", 0.12, "v3")]
    assert rows(logs.read_summary(spark, path, ["v4"]), "value") == [(0.097,)]
    with pytest.raises(Exception, match="does not exist|PATH_NOT_FOUND"):
        logs.read_summary(spark, path, ["v9"]).collect()


def test_scan_artifacts(spark, tmp_path):
    for name in ("sl_040.weights.h5", "net_v3.weights.h5", "gen_12.weights.h5"):
        write(tmp_path, f"w/{name}", "123")
    got = {r.name: r for r in artifacts.scan_artifacts(spark, str(tmp_path / "w" / "*.weights.h5")).collect()}
    assert got["sl_040.weights.h5"].label == "040" and got["net_v3.weights.h5"].version == 3 and got["gen_12.weights.h5"].generation == 12
    assert got["net_v3.weights.h5"].length == 3 and isinstance(got["net_v3.weights.h5"].modificationTime, datetime.datetime)
    expected = spark.createDataFrame([("040",), ("final",)], "label string")
    assert rows(artifacts.scan_artifacts(spark, str(tmp_path / "w"), expected), "label", "available") == [("040", True), ("final", False)]
