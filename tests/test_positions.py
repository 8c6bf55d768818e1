import numpy as np
import pytest
from pyspark.sql import functions as F

from curate.functions import moves, positions

START = "rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR w KQkq - 0 1"


def planes(spark, fen):
    row = spark.createDataFrame([(fen,)], "fen string").select(positions.encode_planes("fen")).first()
    return np.array(row[0]).reshape(8, 8, 20)


def value(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column("t")).first()[0]


def test_start_position_planes(spark):
    p = planes(spark, START)
    assert p[1, :, 0].sum() == 8 and p[6, :, 6].sum() == 8 and p[:, :, 0].sum() == 8
    assert p[0, 4, 5] == 1 and p[7, 4, 11] == 1 and p[0, 3, 4] == 1
    assert all((p[:, :, k] == 1).all() for k in (12, 13, 14, 15, 19))
    assert all((p[:, :, k] == 0).all() for k in (16, 17, 18))


def test_black_to_move_is_seen_from_black(spark):
    p = planes(spark, "4k3/8/8/8/8/8/4P3/4K2R b K - 30 40")
    assert p[0, 4, 5] == 1 and p[6, 4, 6] == 1 and p[7, 7, 9] == 1
    assert (p[:, :, 15] == 1).all() and all((p[:, :, k] == 0).all() for k in (12, 13, 14))
    assert (p[:, :, 16] == 1).all() and p[0, 0, 17] == pytest.approx(0.3)


def test_rights_without_king_or_rook_at_home_do_not_count(spark):
    p = planes(spark, "r3k3/8/8/8/8/8/8/R4K1R w KQkq - 0 1")
    assert p[0, 0, 12:16].tolist() == [0, 0, 1, 0]


@pytest.mark.parametrize(
    "fen,cell",
    [
        ("rnbqkbnr/ppp1pppp/8/8/3pP3/8/PPPP1PPP/RNBQKBNR b KQkq e3 0 1", (5, 4)),
        ("rnbqkbnr/pppppppp/8/8/4P3/8/PPPP1PPP/RNBQKBNR b KQkq e3 0 1", None),
        ("rnbqkbnr/ppp1pppp/8/3pP3/8/8/PPPP1PPP/RNBQKBNR w KQkq d6 0 3", (5, 3)),
        ("4k3/8/8/p6P/8/8/8/4K3 w - a6 0 3", None),
        ("4k3/8/8/Pp5P/8/8/8/4K3 w - b6 0 3", (5, 1)),
    ],
)
def test_en_passant_plane_needs_a_capturer(spark, fen, cell):
    ep = planes(spark, fen)[:, :, 18]
    assert ep.sum() == (0 if cell is None else 1)
    assert cell is None or ep[cell] == 1


def test_fen_fields(spark):
    f = value(spark, positions.fen_fields, START)
    assert (f.turn, f.castling, f.en_passant, f.halfmove, f.fullmove) == ("w", "KQkq", "-", 0, 1)
    with pytest.raises(Exception, match="expected 6 parts, got 4"):
        value(spark, positions.fen_fields, "8/8 w - -")
    assert value(spark, lambda c: positions.fen_fields(c, strict=False), "8/8 w - -") is None


def test_mirror_fen_twice_is_the_identity(spark):
    fen = "r3k2r/ppp1pppp/8/8/3pP3/8/PPPP1PPP/RNBQK2R b Qk e3 4 9"
    once = value(spark, positions.mirror_fen, fen)
    assert once == "rnbqk2r/pppp1ppp/8/3Pp3/8/8/PPP1PPPP/R3K2R w Kq e6 4 9"
    assert value(spark, positions.mirror_fen, once) == fen


@pytest.mark.parametrize(
    "placement,want",
    [
        ("4k3/8/8/8/8/8/8/4K2R", "K v KR"),
        ("3qk2r/8/8/8/8/8/8/4K2R", "KQR v KR"),
        ("4k3/8/8/8/8/8/8/4K3", "K v K"),
        ("4k2b/8/8/8/8/8/8/4K2N", "KB v KN"),
        ("4k3/8/8/8/8/8/PP6/4K3", "KPP v K"),
    ],
)
def test_material_sig(spark, placement, want):
    assert value(spark, positions.material_sig, f"{placement} w - - 0 1") == want


@pytest.mark.parametrize(
    "placement,want",
    [
        ("4k3/8/8/8/8/8/8/4K3", True),
        ("4k3/8/8/8/8/8/8/4KB2", True),
        ("4kn2/8/8/8/8/8/8/4K3", True),
        ("4kr2/8/8/8/8/8/8/4K3", False),
        ("4kb2/8/8/8/8/8/8/2B1K3", True),
        ("2b1k3/8/8/8/8/8/8/2B1K3", False),
        ("4kn2/8/8/8/8/8/8/4KB2", True),
        ("4k3/8/8/8/8/8/8/3NKN2", False),
        ("4k3/8/8/8/8/8/P7/4K3", False),
    ],
)
def test_insufficient(spark, placement, want):
    assert value(spark, positions.insufficient, f"{placement} w - - 0 1") is want


def test_position_keys(spark):
    assert value(spark, positions.rep_key, START) == "rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR w KQkq -"
    assert value(spark, positions.eval_key, START).endswith(" - 0")


def test_mirror_uci(spark):
    assert value(spark, moves.mirror_uci, "e2e4") == "e7e5"
    assert value(spark, moves.mirror_uci, "a7a8n") == "a2a1n"


def test_move_index_blocks(spark):
    table = [(r.move_idx, r.uci) for r in moves.move_index(spark).orderBy("move_idx").collect()]
    names = [u for _, u in table]
    assert [i for i, _ in table] == list(range(1858)) and len(set(names)) == 1858
    assert names[0] == "a1h8" and names[-1] == "h7h8n"
    knight = [u for u in names if sorted((abs(ord(u[0]) - ord(u[2])), abs(int(u[1]) - int(u[3])))) == [1, 2]]
    assert len(knight) == 336 and sum(len(u) == 5 for u in names) == 66 and 1858 - 336 - 66 == 1456
    assert sum(u.startswith("a1") and u not in knight for u in names) == 21
    assert sum(u.startswith("a1") for u in knight) == 2 and sum(u.startswith("e4") for u in knight) == 8
    assert not any(u.endswith("q") for u in names)


def test_planes_are_a_bijection(spark):
    cells = moves.move_index(spark).select("uci", moves.gather_index("uci").alias("c"), moves.policy_plane("uci").alias("p")).collect()
    assert len({r.c for r in cells}) == 1858 and {r.p for r in cells} == set(range(73))
    assert sum(r.p < 56 for r in cells) == 1456 and sum(56 <= r.p < 64 for r in cells) == 336
    assert max(r.c for r in cells) < 8 * 8 * 73


@pytest.mark.parametrize("uci", ["e4e4", "a1b4", "a7a8k", "a7c8n"])
def test_moves_without_a_plane(spark, uci):
    with pytest.raises(Exception, match="no policy plane"):
        value(spark, moves.policy_plane, uci)
    assert value(spark, lambda c: moves.policy_plane(c, strict=False), uci) is None


def test_with_move_idx(spark):
    df = spark.createDataFrame([("a1h8", "w"), ("a8h1", "b"), ("a7a8q", "w"), ("a7a8", "w"), ("a1b4", "w"), ("a2a1n", "b")], "uci string, turn string")
    got = {(r.uci, r.turn): r.move_idx for r in moves.with_move_idx(df).collect()}
    assert got["a1h8", "w"] == got["a8h1", "b"] == 0
    assert got["a7a8q", "w"] == got["a7a8", "w"] is not None
    assert got["a1b4", "w"] is None and got["a2a1n", "b"] >= 1792


def test_encode_samples_value_only_rows(spark):
    from curate.sources.chunks import dense_policy, encode_samples

    df = spark.createDataFrame([(START, 5, 0, None, None, None), (START, None, 1, 100, 800, 100)], "fen string, move_idx int, wdl int, w int, d int, l int")
    a, b = encode_samples(df).withColumn("policy", dense_policy()).collect()
    assert a.value == [1.0, 0.0, 0.0] and a.policy_weight == 1.0 and a.policy[5] == 1.0 and sum(a.policy) == 1.0
    assert b.value == pytest.approx([0.05, 0.9, 0.05]) and b.policy_weight == 0.0 and sum(b.policy) == 0.0
    assert len(a.planes) == 1280


def test_legal_priors_align_with_the_allowed_moves(spark):
    from curate.functions.vectors import legal_priors

    z = F.array(*[F.lit(float(v)) for v in (1, 2, 3)])
    p = spark.range(1).select(legal_priors(z, F.array(F.lit(2), F.lit(0)))).first()[0]
    assert p == pytest.approx([0.8807971, 0.1192029])
