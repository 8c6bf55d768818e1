"""Encodings of positions and moves."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import roles
from checks.base import query, r6, table
from curate.functions import moves, positions
from curate.sources.chunks import dense_policy, encode_samples

UNDIGIT = "replace(replace(replace(replace(replace(replace(replace(replace({0}, '8', '........'), '7', '.......'), '6', '......'), '5', '.....'), '4', '....'), '3', '...'), '2', '..'), '1', '.')"
# Boards of all positions: white's view and the mover's view, 64 characters each.
BOARDS = f"""with boards as (
  select doc_id, turn, castling, ep, clock, placement,
    array_to_string(list_reverse(string_split({UNDIGIT.format('placement')}, '/')), '') as board,
    case when turn = 'b' then translate(array_to_string(string_split({UNDIGIT.format('placement')}, '/'), ''), 'PNBRQKpnbrqk', 'pnbrqkPNBRQK')
         else array_to_string(list_reverse(string_split({UNDIGIT.format('placement')}, '/')), '') end as seen
  from positions),
eps as (
  select *, case when ep = '-' then -1 else 40 + ascii(ep) - 97 end as target,
    case when turn = 'w' then 6 else 3 end as ep_rank,
    case when turn = 'w' then castling else translate(castling, 'KQkq', 'kqKQ') end as rights
  from boards),
planes_in as (
  select *, case when target >= 0 and substr(ep, 2, 1) = cast(ep_rank as varchar) and substr(seen, cast(target + 1 as bigint), 1) = '.'
      and ((target % 8 > 0 and substr(seen, cast(target - 8 as bigint), 1) = 'P') or (target % 8 < 7 and substr(seen, cast(target - 6 as bigint), 1) = 'P'))
    then target else -1 end as ep_square,
    case when rights like '%Q%' and substr(seen, 5, 1) = 'K' and substr(seen, 1, 1) = 'R' then 1 else 0 end as c12,
    case when rights like '%K%' and substr(seen, 5, 1) = 'K' and substr(seen, 8, 1) = 'R' then 1 else 0 end as c13,
    case when rights like '%q%' and substr(seen, 61, 1) = 'k' and substr(seen, 57, 1) = 'r' then 1 else 0 end as c14,
    case when rights like '%k%' and substr(seen, 61, 1) = 'k' and substr(seen, 64, 1) = 'r' then 1 else 0 end as c15
  from eps)
"""


@query(
    "fen_fields",
    """select doc_id, placement as board, turn, castling, ep as en_passant, cast(clock as integer) as halfmove, cast(1 + doc_id % 80 as integer) as fullmove
       from positions""",
    ("positions",),
)
def _(spark, sf):
    return roles.positions(spark, sf).select("doc_id", positions.fen_fields("fen").alias("f")).select("doc_id", "f.*")


@query("board_squares", BOARDS + "select doc_id, board, seen from boards", ("positions",))
def _(spark, sf):
    white, seen = positions.board_squares("fen"), positions.board_squares("fen", oriented=True)
    return roles.positions(spark, sf).select(
        "doc_id", F.array_join(white, "").alias("board"), F.array_join(seen, "").alias("seen")
    )


@query(
    "encode_planes",
    BOARDS
    + """select doc_id, cast(1280 as integer) as n_cells, md5(array_to_string(list_transform(range(1280), lambda i:
        case when i % 20 < 12 then case when strpos('PNBRQKpnbrqk', substr(seen, i // 20 + 1, 1)) = i % 20 + 1 then 100 else 0 end
          when i % 20 = 12 then 100 * c12 when i % 20 = 13 then 100 * c13 when i % 20 = 14 then 100 * c14 when i % 20 = 15 then 100 * c15
          when i % 20 = 16 then case when turn = 'b' then 100 else 0 end when i % 20 = 17 then clock
          when i % 20 = 18 then case when i // 20 = ep_square then 100 else 0 end else 100 end), ',')) as cells
      from planes_in""",
    ("positions",),
)
def _(spark, sf):
    coded = roles.positions(spark, sf).select("doc_id", positions.encode_planes("fen").alias("p"))
    cells = F.array_join(F.transform("p", lambda v: F.round(v * 100).cast("int")), ",")
    return coded.select("doc_id", F.size("p").alias("n_cells"), F.md5(cells).alias("cells"))


@query(
    "ep_pseudo",
    BOARDS + "select doc_id, ep_square >= 0 as ep_pseudo from planes_in",
    ("positions",),
)
def _(spark, sf):
    return roles.positions(spark, sf).select("doc_id", positions.ep_pseudo("fen").alias("ep_pseudo"))


@query(
    "encode_samples",
    """select doc_id, round(case when w is null then case when cls = 0 then 1.0::double else 0.0::double end
           else 0.5 * case when cls = 0 then 1 else 0 end + 0.5 * w / greatest(cast(w + d + l as double), 1e-9) end, 6) as target_win,
         case when move_idx is null then 0.0::double else 1.0::double end as policy_weight,
         cast(1280 as integer) as n_cells, cast(1858 as integer) as n_policy, move_idx
       from (select doc_id, cast(doc_id % 3 as integer) as cls, case when doc_id % 10 > 0 then cast(n_chars % 1858 as integer) end as move_idx,
               case when quality is not null then 600 + 100 * quality end as w, 200 as d, 100 as l
             from documents left join (select doc_id as id, quality from labels) q on id = doc_id) x""",
)
def _(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "n_chars")
    soft = table(spark, sf, "labels").select("doc_id", (600 + 100 * F.col("quality")).alias("w"))
    rows = roles.positions(spark, sf).join(docs, "doc_id").join(soft, "doc_id", "left")
    rows = rows.withColumns(
        {
            "wdl": (F.col("doc_id") % 3).cast("int"),
            "move_idx": F.when(F.col("doc_id") % 10 > 0, F.col("n_chars") % 1858).cast("int"),
            "d": F.lit(200),
            "l": F.lit(100),
        }
    )
    coded = encode_samples(rows).withColumn("policy", dense_policy())
    return coded.select(
        "doc_id",
        r6(F.col("value")[0]).alias("target_win"),
        "policy_weight",
        F.size("planes").alias("n_cells"),
        F.size("policy").alias("n_policy"),
        F.nullif(F.array_position(F.col("policy"), F.lit(1.0).cast("float")).cast("int") - 1, F.lit(-1)).alias("move_idx"),
    )


SIDES = """with sides as (select doc_id, turn, placement,
    array_to_string(list_sort(string_split(regexp_replace(placement, '[^QRBNP]', '', 'g'), '')), '') as white,
    upper(array_to_string(list_sort(string_split(regexp_replace(placement, '[^qrbnp]', '', 'g'), '')), '')) as black
  from {0})
"""


@query(
    "material_sig",
    SIDES.format("positions")
    + """select doc_id, cast(length(regexp_replace(placement, '[^A-Za-z]', '', 'g')) as integer) as pieces,
      case when greatest(length(white), 1) > greatest(length(black), 1) then 'K' || white || ' v K' || black
           when greatest(length(white), 1) < greatest(length(black), 1) then 'K' || black || ' v K' || white
           else 'K' || least(white, black) || ' v K' || greatest(white, black) end as sig
    from sides""",
    ("positions",),
)
def _(spark, sf):
    return roles.positions(spark, sf).select(
        "doc_id", positions.n_pieces("fen").alias("pieces"), positions.material_sig("fen").alias("sig")
    )


@query(
    "n_pieces",
    """select n_pieces, count(*) as n_rows from (select cast(length(regexp_replace(placement, '[^A-Za-z]', '', 'g')) as integer) as n_pieces from positions) x group by n_pieces""",
    ("positions",),
)
def _(spark, sf):
    counted = roles.positions(spark, sf).select(positions.n_pieces("fen").alias("n_pieces"))
    return counted.groupBy("n_pieces").agg(F.count(F.lit(1)).alias("n_rows"))


# Endings with few pieces: the two kings and up to two more pieces, placed by the row's numbers.
ENDINGS = """with endings as (
  select l_orderkey, l_linenumber, l_partkey, l_suppkey,
    concat('k', white_at, '/8/8/', black_at, '/8/8/8/K7') as placement, a, b, fa, fb
  from (select *, fa % 8 as xa, fb % 8 as xb,
      case when a = '' then '7' else concat(case when fa = 0 then '' else cast(fa as varchar) end, a, case when fa = 6 then '' else cast(6 - fa as varchar) end) end as white_at,
      case when b = '' then '8' else concat(case when fb = 0 then '' else cast(fb as varchar) end, b, case when fb = 7 then '' else cast(7 - fb as varchar) end) end as black_at
    from (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_partkey % 7 as fa, l_suppkey % 8 as fb,
        case l_orderkey % 5 when 0 then '' when 1 then 'B' when 2 then 'N' when 3 then 'R' else 'b' end as a,
        case l_linenumber % 4 when 0 then '' when 1 then 'b' when 2 then 'n' else 'P' end as b from lineitem) x) y)
"""


def endings(spark, sf):
    fa, fb = F.col("l_partkey") % 7, F.col("l_suppkey") % 8
    n, m = F.col("l_orderkey") % 5, F.col("l_linenumber") % 4
    a = F.when(n == 0, "").when(n == 1, "B").when(n == 2, "N").when(n == 3, "R").otherwise("b")
    b = F.when(m == 0, "").when(m == 1, "b").when(m == 2, "n").otherwise("P")

    def spread(piece, left, width):
        gap = lambda c: F.when(c == 0, "").otherwise(c.cast("string"))
        return F.when(piece == "", str(width)).otherwise(F.concat(gap(left), piece, gap(width - 1 - left)))

    fen = F.concat(F.lit("k"), spread(a, fa, 7), F.lit("/8/8/"), spread(b, fb, 8), F.lit("/8/8/8/K7 w - - 0 1"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", fen.alias("fen"))


@query(
    "insufficient",
    ENDINGS
    + """select l_orderkey, l_linenumber, l_partkey, l_suppkey, case
      when a = '' and b = '' then true
      when a = '' then b in ('b', 'n') when b = '' then a in ('B', 'N', 'b')
      when a = 'b' then false
      when a in ('B', 'N') and b in ('b', 'n') then not (a = 'B' and b = 'b' and (7 + fa + 1) % 2 <> (4 + fb) % 2)
      else false end as insufficient
    from endings""",
)
def _(spark, sf):
    rows = endings(spark, sf)
    return rows.select(*[c for c in rows.columns if c != "fen"], positions.insufficient("fen").alias("insufficient"))


@query(
    "rep_key",
    """select concat(placement, ' ', turn, ' ', castling, ' ', ep) as rep, concat(placement, ' ', turn, ' ', castling, ' ', ep, ' ', cast(clock as varchar)) as eval_key, doc_id
       from positions""",
    ("positions",),
)
def _(spark, sf):
    return roles.positions(spark, sf).select(
        "doc_id", positions.rep_key("fen").alias("rep"), positions.eval_key("fen").alias("eval_key")
    )


@query(
    "eval_key",
    """select concat(placement, ' ', turn, ' ', castling, ' ', ep, ' ', cast(clock as varchar)) as eval_key, count(*) as n_rows from positions group by 1""",
    ("positions",),
)
def _(spark, sf):
    keyed = roles.positions(spark, sf).select(positions.eval_key("fen").alias("eval_key"))
    return keyed.groupBy("eval_key").agg(F.count(F.lit(1)).alias("n_rows"))


UCI = """with ucis as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, turn,
    concat(sq(src), sq(dst), case when l_linenumber = 1 then 'q' when l_linenumber = 2 then 'n' when l_linenumber = 3 then 'r' else '' end) as uci
  from (select l_orderkey, l_linenumber, l_partkey, l_suppkey, case when l_orderkey % 2 = 0 then 'w' else 'b' end as turn,
      cast(l_partkey % 64 as integer) as src, cast(l_suppkey % 64 as integer) as dst from lineitem) x)
""".replace("sq(src)", "concat(chr(97 + src % 8), cast(src // 8 + 1 as varchar))").replace(
    "sq(dst)", "concat(chr(97 + dst % 8), cast(dst // 8 + 1 as varchar))"
)


def ucis(spark, sf):
    def square(c):
        return F.concat(F.char(97 + c % 8), (F.floor(c / 8) + 1).cast("string"))

    line = F.col("l_linenumber")
    suffix = F.when(line == 1, "q").when(line == 2, "n").when(line == 3, "r").otherwise("")
    return table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        F.when(F.col("l_orderkey") % 2 == 0, "w").otherwise("b").alias("turn"),
        F.concat(square(F.col("l_partkey") % 64), square(F.col("l_suppkey") % 64), suffix).alias("uci"),
    )


MIRROR = """concat(substr(uci, 1, 1), cast(9 - cast(substr(uci, 2, 1) as integer) as varchar), substr(uci, 3, 1), cast(9 - cast(substr(uci, 4, 1) as integer) as varchar), substr(uci, 5))"""


@query("mirror_uci", UCI + f"select l_orderkey, l_linenumber, l_partkey, l_suppkey, uci, {MIRROR} as mirrored, true as twice_same from ucis")
def _(spark, sf):
    rows = ucis(spark, sf).drop("turn").withColumn("mirrored", moves.mirror_uci("uci"))
    return rows.withColumn("twice_same", moves.mirror_uci("mirrored") == F.col("uci"))


# The index from its rule: sliding, knight, under-promotion blocks over all square pairs.
INDEX = """, pairs as (select s, d, d // 8 - s // 8 as dr, d % 8 - s % 8 as df,
    concat(chr(cast(97 + s % 8 as integer)), cast(s // 8 + 1 as varchar), chr(cast(97 + d % 8 as integer)), cast(d // 8 + 1 as varchar)) as base
  from unnest(range(64)) as a(s), unnest(range(64)) as b(d)),
moves as (
  select 0 as block, s, 0 as push, d, 0 as piece, base as uci from pairs where s <> d and (dr = 0 or df = 0 or abs(dr) = abs(df))
  union all select 1, s, 0, d, 0, base from pairs where abs(dr * df) = 2
  union all select 2, s, case when df = 0 then 1 else 0 end, d, p, concat(base, substr('rbn', cast(p + 1 as bigint), 1)) from pairs, unnest(range(3)) as q(p)
    where s // 8 = 6 and dr = 1 and abs(df) <= 1),
index as (select uci, cast(row_number() over (order by block, s, push, d desc, piece) - 1 as integer) as move_idx from moves)
"""


@query(
    "with_move_idx",
    UCI
    + INDEX
    + f"""select u.l_orderkey, u.l_linenumber, u.l_partkey, u.l_suppkey, u.uci, i.move_idx
    from ucis u left join index i on i.uci = case when right(u.uci, 1) = 'q' then substr(case when turn = 'b' then {MIRROR.replace('uci', 'u.uci')} else u.uci end, 1, 4)
      else case when turn = 'b' then {MIRROR.replace('uci', 'u.uci')} else u.uci end end""",
)
def _(spark, sf):
    return moves.with_move_idx(ucis(spark, sf)).drop("turn")


@query(
    "move_index",
    UCI
    + INDEX
    + f"""select move_idx, index.uci, count(u.uci) as n_rows from index left join ucis u
      on index.uci = case when right(u.uci, 1) = 'q' then substr(u.uci, 1, 4) else u.uci end group by move_idx, index.uci""",
)
def _(spark, sf):
    played = ucis(spark, sf).groupBy(moves.index_key("uci", F.lit("w")).alias("uci")).agg(F.count(F.lit(1)).alias("n"))
    return moves.move_index(spark).join(played, "uci", "left").select("move_idx", "uci", F.coalesce("n", F.lit(0)).alias("n_rows"))


PLANE = """select l_orderkey, l_linenumber, l_partkey, l_suppkey, uci, r, f, dr, df, case
      when length(uci) = 5 and strpos('nbr', substr(uci, 5, 1)) > 0 and abs(df) <= 1 then 64 + 3 * (df + 1) + strpos('nbr', substr(uci, 5, 1)) - 1
      when length(uci) = 5 then null
      when dr = 2 and df = 1 then 56 when dr = 1 and df = 2 then 57 when dr = -1 and df = 2 then 58 when dr = -2 and df = 1 then 59
      when dr = -2 and df = -1 then 60 when dr = -1 and df = -2 then 61 when dr = 1 and df = -2 then 62 when dr = 2 and df = -1 then 63
      when dr = 0 and df = 0 then null
      when dr > 0 and df = 0 then dr - 1 when dr > 0 and df = dr then 7 + dr - 1 when dr = 0 and df > 0 then 14 + df - 1
      when dr < 0 and df = -dr then 21 - dr - 1 when dr < 0 and df = 0 then 28 - dr - 1 when dr < 0 and df = dr then 35 - dr - 1
      when dr = 0 and df < 0 then 42 - df - 1 when dr > 0 and df = -dr then 49 + dr - 1 end as plane
    from (select *, ascii(substr(uci, 4, 1)) - 49 - r as dr, ascii(substr(uci, 3, 1)) - 97 - f as df
      from (select *, ascii(substr(uci, 2, 1)) - 49 as r, ascii(substr(uci, 1, 1)) - 97 as f from ucis) x) y"""


@query("policy_plane", UCI + f"select l_orderkey, l_linenumber, l_partkey, l_suppkey, uci, cast(plane as integer) as plane from ({PLANE}) z")
def _(spark, sf):
    return ucis(spark, sf).drop("turn").withColumn("plane", moves.policy_plane("uci", strict=False))


@query("gather_index", UCI + f"select cell, count(*) as n_rows, count(distinct uci) as n_moves from (select uci, cast(r * 584 + f * 73 + plane as integer) as cell from ({PLANE}) z) w where cell is not null group by cell")
def _(spark, sf):
    # The collision audit: one cell never holds two moves.
    cells = ucis(spark, sf).select("uci", moves.gather_index("uci", strict=False).alias("cell")).where("cell is not null")
    per_move = cells.groupBy("cell", "uci").agg(F.count(F.lit(1)).alias("n"))
    return per_move.groupBy("cell").agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_moves"))
