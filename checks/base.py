"""Registry of queries and their SQL, and the table views ("roles") they read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, roles: tuple[str, ...] = ()):
    """Register a query; ``roles`` are the views its SQL starts from."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_roles(sql, roles)
        return fn

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r6(c: Column | str) -> Column:
    """Six digits: sums in another order differ in the last bits."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: r6(n) for n in names})


# Views in SQL. Each is (needed views, text).
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "games": (
        (),
        """select o_orderkey as game_id, o_custkey as player, o_orderpriority as event, o_totalprice as price,
             case o_orderstatus when 'F' then '1-0' when 'O' then '0-1' when 'P' then '1/2-1/2' end as result
           from orders""",
    ),
    "plies": (
        ("games",),
        """select concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) as rid, l_orderkey as game_id,
             l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, result,
             case when l_linenumber % 2 = 1 then 'w' else 'b' end as turn,
             case l_linenumber when 7 then -l_partkey when 6 then null else l_partkey end as pos,
             case l_returnflag when 'N' then 'game' when 'A' then 'puzzle' else 'tablebase' end as source,
             case when result = '1/2-1/2' then 1
                  when (result = '1-0') = (l_linenumber % 2 = 1) then 0 else 2 end as wdl
           from lineitem join games on game_id = l_orderkey""",
    ),
    "annotations": (
        (),
        """select l_partkey as fen, cp, w, 1000 - w - l as d, l from (
             select l_partkey,
               cast((sum(cast(round(l_extendedprice * 100) as bigint)) // (100 * count(*)) - 50000) // 20 as integer) as cp,
               cast(1000 * sum(cast(round(l_discount * 100) as bigint)) // (count(*) + sum(cast(round(l_discount * 100) as bigint)) + sum(cast(round(l_tax * 100) as bigint))) as integer) as w,
               cast(1000 * sum(cast(round(l_tax * 100) as bigint)) // (count(*) + sum(cast(round(l_discount * 100) as bigint)) + sum(cast(round(l_tax * 100) as bigint))) as integer) as l
             from lineitem group by l_partkey) a""",
    ),
    "predictions": (
        ("plies",),
        """select *, a / (a + b + c) as p_win, b / (a + b + c) as p_draw, c / (a + b + c) as p_loss,
             2 + l_partkey % 31 as pieces
           from (select *, 1 + l_quantity as a, 1 + 100 * l_discount as b, 1 + 100 * l_tax as c from plies) p""",
    ),
    "results": (
        (),
        """select user_id, event_id, ts, case event_type when 'purchase' then 1.0::double when 'view' then 0.5::double when 'error' then 0.0::double end as points
           from events where event_type in ('purchase', 'view', 'error')""",
    ),
    "positions": (
        (),
        """select doc_id, concat(placement, ' ', turn, ' ', castling, ' ', ep, ' ', cast(clock as varchar), ' ', cast(1 + doc_id % 80 as varchar)) as fen,
             placement, turn, castling, ep, clock
           from (select doc_id, n_chars,
             case when doc_id % 2 = 0 then 'w' else 'b' end as turn,
             case doc_id % 6 when 0 then 'KQkq' when 1 then 'Kq' when 2 then 'Qk' when 3 then 'KQkq' when 4 then 'KQ' else '-' end as castling,
             case when doc_id % 4 < 2 then concat(chr(cast(97 + (doc_id // 4) % 8 as integer)), case when doc_id % 2 = 0 then '6' else '3' end) else '-' end as ep,
             n_chars % 120 as clock,
             concat_ws('/', case when doc_id % 3 = 0 then 'r3k2r' else substr(b, 1, 8) end, substr(b, 9, 8), substr(b, 17, 8),
               substr(b, 25, 8), substr(b, 33, 8), substr(b, 41, 8), substr(b, 49, 8),
               case when doc_id % 3 = 0 then 'R3K2R' else substr(b, 57, 8) end) as placement
           from (select doc_id, n_chars,
             translate(concat(md5(concat('a', cast(doc_id as varchar))), md5(concat('b', cast(doc_id as varchar)))), '0123456789abcdef', '111111PpNnBbRrQq') as b
             from documents) x) y""",
    ),
    "suite": (
        (),
        """select p_partkey as position, concat('m', cast(i as varchar)) as move, cast(best - i * step as integer) as cp, cast(i + 1 as integer) as rank, cast(best as integer) as best_cp
           from (select p_partkey, 300 - p_partkey % 50 as best, 5 + 10 * (p_partkey % 7) as step, unnest(range(1 + p_size % 20)) as i, p_size % 20 as last
             from part) s
           where last * step >= 50""",
    ),
    "choices": (
        (),
        """select concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) as rid, concat('c', cast(l_suppkey % 5 as varchar)) as cell,
             l_linenumber as milestone, l_partkey as position, concat('m', cast(l_suppkey % (1 + p_size % 20) as varchar)) as move,
             l_quantity / 10.0 as elapsed, l_discount as topvis
           from lineitem join part on p_partkey = l_partkey""",
    ),
    "scored": (
        ("suite", "choices"),
        """select c.*, s.rank, s.best_cp - s.cp as cp_loss_raw, least(s.best_cp - s.cp, 1000) as cp_loss,
             1 / (1 + pow(10.0, -s.best_cp / 400.0)) - 1 / (1 + pow(10.0, -s.cp / 400.0)) as esc_loss
           from choices c join suite s on s.position = c.position and s.move = c.move""",
    ),
    "edges": (
        (),
        """select l_orderkey as position, concat_ws('-', l_linenumber, l_partkey, l_suppkey, cast(round(l_extendedprice * 100) as bigint)) as move, cast(l_quantity as bigint) as n, l_discount as p from lineitem""",
    ),
}


def with_roles(sql: str, roles: tuple[str, ...]) -> str:
    order: list[str] = []

    def need(name: str) -> None:
        if name not in order:
            for before in VIEWS[name][0]:
                need(before)
            order.append(name)

    for name in roles:
        need(name)
    sql = sql.strip()
    if not order:
        return sql
    head = ",\n".join(f"{name} as ({VIEWS[name][1]})" for name in order)
    if sql[:5].lower() == "with ":
        return f"with {head},\n{sql[5:]}"
    return f"with {head}\n{sql}"
