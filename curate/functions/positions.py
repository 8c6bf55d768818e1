"""FEN text as column expressions: fields, squares, planes, material and position keys.

The board text used below holds 64 characters, a1 b1 .. h8, with '.' for an empty square.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from curate.functions.base import ColumnLike, col, let
from curate.functions.labels import blend

# Piece order of planes 0-11, plane count, board size.
PIECES = "PNBRQKpnbrqk"
SWAPPED = "pnbrqkPNBRQK"
PLANES = 20
SQUARES = 64


@dataclass
class Parts:
    """A FEN that is split already, for expressions that look at several fields."""

    fields: Column


def split_fen(fen: ColumnLike) -> Column:
    return F.split(col(fen), " +")


def _field(fen: ColumnLike | Parts, i: int) -> Column:
    return F.get(fen.fields if isinstance(fen, Parts) else split_fen(fen), F.lit(i))


def fen_fields(fen: ColumnLike, strict: bool = True) -> Column:
    """FEN -> struct of its six typed fields; any other field count is an error, or NULL if not strict."""
    parts = F.split(F.trim(col(fen)), r"\s+")
    fields = F.struct(
        F.get(parts, F.lit(0)).alias("board"),
        F.get(parts, F.lit(1)).alias("turn"),
        F.get(parts, F.lit(2)).alias("castling"),
        F.get(parts, F.lit(3)).alias("en_passant"),
        F.get(parts, F.lit(4)).try_cast("int").alias("halfmove"),
        F.get(parts, F.lit(5)).try_cast("int").alias("fullmove"),
    )
    ok = F.when(F.size(parts) == 6, fields)
    if not strict:
        return ok
    message = F.concat(F.lit("invalid FEN, expected 6 parts, got "), F.size(parts))
    return F.when((F.size(parts) != 6) & col(fen).isNotNull(), F.raise_error(message).cast(_FIELDS)).otherwise(ok)


_FIELDS = "struct<board:string,turn:string,castling:string,en_passant:string,halfmove:int,fullmove:int>"


def _ranks(fen: ColumnLike) -> Column:
    """Eight rank texts, rank 8 first, digits written out as dots."""
    placement = _field(fen, 0)
    for n in range(8, 0, -1):
        placement = F.replace(placement, F.lit(str(n)), F.lit("." * n))
    return F.split(placement, "/")


def board_text(fen: ColumnLike, oriented: bool = False) -> Column:
    """The 64-character board; oriented: seen from the side to move (ranks reversed, case swapped for black)."""
    ranks = _ranks(fen)
    white = F.array_join(F.reverse(ranks), "")
    if not oriented:
        return white
    black = F.translate(F.array_join(ranks, ""), PIECES, SWAPPED)
    return F.when(_field(fen, 1) == "b", black).otherwise(white)


def board_squares(fen: ColumnLike, oriented: bool = False) -> Column:
    """The 64 squares as an array, a1 first."""
    return F.split(board_text(fen, oriented), "")


def mirror_fen(fen: ColumnLike) -> Column:
    """Colours, board, castling rights, en passant square and side to move flipped together."""
    placement = F.translate(F.array_join(F.reverse(F.split(_field(fen, 0), "/")), "/"), PIECES, SWAPPED)
    turn = F.when(_field(fen, 1) == "w", "b").otherwise("w")
    swapped = F.translate(_field(fen, 2), "KQkq", "kqKQ")
    rights = F.array_join(
        F.filter(F.array(*[F.lit(c) for c in "KQkq"]), lambda c: F.contains(swapped, c)), ""
    )
    castling = F.when(rights == "", "-").otherwise(rights)
    square = F.translate(_field(fen, 3), "12345678", "87654321")
    return F.concat_ws(" ", placement, turn, castling, square, _field(fen, 4), _field(fen, 5))


def ep_index(fen: ColumnLike, board: Column) -> Column:
    """Square (0-63, oriented) of a usable en passant target, else -1.

    Usable: the target is empty and a pawn of the mover stands beside it, one rank back. Pins are
    not tested, so the flag is pseudo-legal.
    """
    target = _field(fen, 3)
    file = F.ascii(target) - F.ascii(F.lit("a"))
    square = F.lit(5 * 8) + file
    rank = F.when(_field(fen, 1) == "b", "3").otherwise("6")
    left = (file > 0) & (F.substring(board, square - 8, F.lit(1)) == "P")
    right = (file < 7) & (F.substring(board, square - 6, F.lit(1)) == "P")
    empty = F.substring(board, square + 1, F.lit(1)) == "."
    usable = (F.length(target) == 2) & (F.substring(target, 2, 1) == rank) & empty & (left | right)
    return F.when(usable, square).otherwise(-1)


def ep_pseudo(fen: ColumnLike) -> Column:
    """True where plane 18 is set on the pseudo-legal test alone (the audit column for it)."""
    return ep_index(fen, board_text(fen, oriented=True)) >= 0


def _right(fen: ColumnLike, board: Column, own: bool, king_side: bool) -> Column:
    """A castling right counts when its letter is there and king and rook stand at home."""
    white_letter, black_letter = ("K", "k") if king_side else ("Q", "q")
    if not own:
        white_letter, black_letter = black_letter, white_letter
    letter = F.when(_field(fen, 1) == "b", black_letter).otherwise(white_letter)
    base = 0 if own else 56
    king, rook = ("K", "R") if own else ("k", "r")
    return (
        F.contains(_field(fen, 2), letter)
        & (F.substring(board, base + 5, 1) == king)
        & (F.substring(board, base + (8 if king_side else 1), 1) == rook)
    )


def encode_planes(fen: ColumnLike) -> Column:
    """FEN -> 8x8x20 planes as ARRAY<FLOAT>, row-major (rank, file, plane), seen from the side to move.

    Planes: 0-5 own and 6-11 other pieces, 12-15 castling (own queen side, own king side, other queen
    side, other king side), 16 black to move, 17 halfmove clock / 100, 18 en passant square, 19 ones.
    """
    # One row of 12 piece planes per character of PIECES, and a row of zeros for an empty square. SQL
    # text, as building some 160 literals one by one takes longer than the query on a small table.
    hot = ["array(" + ",".join("1f" if p == q else "0f" for q in PIECES) + ")" for p in PIECES + "."]
    piece_rows = F.expr("array(" + ",".join(hot) + ")")

    def planes(fen: Parts, board: Column) -> Column:
        def as_float(flag: Column) -> Column:
            return F.coalesce(flag, F.lit(False)).cast("float")

        whole = [
            as_float(_right(fen, board, True, False)),
            as_float(_right(fen, board, True, True)),
            as_float(_right(fen, board, False, False)),
            as_float(_right(fen, board, False, True)),
            as_float(_field(fen, 1) == "b"),
            (_field(fen, 4).cast("int") / 100).cast("float"),
        ]
        zero, one = F.lit(0.0).cast("float"), F.lit(1.0).cast("float")
        # What follows the piece planes is the same for every square but the en passant target.
        row = F.struct(
            F.array(*whole, zero, one).alias("plain"),
            F.array(*whole, one, one).alias("target"),
            ep_index(fen, board).alias("ep"),
        )

        def squares(r: Column) -> Column:
            return F.flatten(
                F.transform(
                    F.split(board, ""),
                    lambda piece, i: F.concat(
                        F.element_at(piece_rows, F.position(piece, F.lit(PIECES + "."))),
                        F.when(i == r["ep"], r["target"]).otherwise(r["plain"]),
                    ),
                )
            )

        return let(row, squares)

    def on_board(fields: Column) -> Column:
        fen = Parts(fields)
        return let(board_text(fen, oriented=True), lambda board: planes(fen, board))

    return let(split_fen(fen), on_board)


def encode_sample(fen, move_idx, cls, w, d, l, lam: float) -> dict[str, Column]:
    """The training columns of one row: planes, soft value target, policy weight (0 without a move)."""
    return {
        "planes": encode_planes(fen),
        "value": blend(cls, w, d, l, lam),
        "policy_weight": F.when(col(move_idx) >= 0, 1.0).otherwise(0.0),
    }


def n_pieces(fen: ColumnLike) -> Column:
    return F.length(F.regexp_replace(_field(fen, 0), "[^A-Za-z]", ""))


def _side(fen: ColumnLike, pattern: str) -> Column:
    """The non-king pieces of one colour as sorted upper-case letters."""
    letters = F.regexp_replace(_field(fen, 0), pattern, "")
    return F.array_join(F.array_sort(F.split(F.upper(letters), "")), "")


def material_sig(fen: ColumnLike) -> Column:
    """'KQ v KR': each side's king and other pieces; the side of more pieces first, equal numbers in text order.

    A bare king counts like a side of one piece that sorts before every letter.
    """

    def side(pattern: str) -> Column:
        pieces = _side(fen, pattern)
        return F.struct((-F.greatest(F.length(pieces), F.lit(1))).alias("rank"), F.concat(F.lit("K"), pieces).alias("text"))

    sides = F.array_sort(F.array(side("[^QRBNP]"), side("[^qrbnp]")))
    return F.array_join(F.transform(sides, lambda s: s["text"]), " v ")


def insufficient(fen: ColumnLike) -> Column:
    """No side can mate: bare kings, one lone minor, or one minor each unless the bishops differ in colour."""
    board = board_text(fen)
    white, black = _side(fen, "[^QRBNP]"), _side(fen, "[^qrbnp]")
    minor = ["B", "N"]

    def colour(piece: str) -> Column:
        square = F.instr(board, piece) - 1
        return (F.floor(square / 8) + square % 8) % 2

    bare = (white == "") & (black == "")
    lone = ((white == "") & black.isin(minor)) | ((black == "") & white.isin(minor))
    opposite = (white == "B") & (black == "B") & (colour("B") != colour("b"))
    pair = white.isin(minor) & black.isin(minor) & ~opposite
    return bare | lone | pair


def rep_key(fen: ColumnLike) -> Column:
    """Repetition key: placement, side, castling, en passant."""
    return F.substring_index(col(fen), " ", 4)


def eval_key(fen: ColumnLike) -> Column:
    """Evaluation key: the repetition key and the halfmove clock."""
    return F.substring_index(col(fen), " ", 5)
