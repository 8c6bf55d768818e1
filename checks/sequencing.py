"""Operators over sequences: games, puzzle lines, conversations, event logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import roles
from checks.base import query, r6, table
from curate.functions.labels import is_priority
from curate.operators import edges as edge_ops
from curate.operators import sequences as seq
from curate.operators.matches import running_score


def conversation(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", "role", F.length("text").alias("n_chars"))


@query(
    "explode_plies",
    """select conv_id, turn, cast(ply as integer) as ply, w[cast(ply + 1 as bigint)] as move, case when ply % 2 = 0 then 'w' else 'b' end as side,
         case when result = '1/2-1/2' then 1 when (result = '1-0') = (ply % 2 = 0) then 0 else 2 end as wdl
       from (select conv_id, turn, string_split(text, ' ') as w, case conv_id % 3 when 0 then '1-0' when 1 then '0-1' else '1/2-1/2' end as result,
               unnest(range(len(string_split(text, ' ')))) as ply from conversations) x""",
)
def _(spark, sf):
    n = F.col("conv_id") % 3
    result = F.when(n == 0, "1-0").when(n == 1, "0-1").otherwise("1/2-1/2")
    lines = table(spark, sf, "conversations").select(
        "conv_id", F.col("turn").alias("line"), F.split("text", " ").alias("moves"), result.alias("result")
    )
    rows = seq.explode_plies(lines).drop("result")
    return rows.withColumnRenamed("turn", "side").withColumnRenamed("line", "turn")


@query(
    "explode_lines",
    """select * from (select doc_id, cast(i as integer) as step, w[cast(i + 1 as bigint)] as move, case when i % 2 = 1 then 'solver' else 'defender' end as role,
         case when i % 2 = 1 then 0 else 2 end as wdl, text like '%mate%' or text like '%endgame%' as priority
       from (select doc_id, text, string_split(text, ' ') as w, unnest(range(len(string_split(text, ' ')))) as i from documents) x where len(w) >= 2 and i >= 1) y
       where role = 'solver' or priority""",
)
def _(spark, sf):
    docs = table(spark, sf, "documents").select(
        "doc_id", F.split("text", " ").alias("moves"), F.col("text").alias("themes"), is_priority("text").alias("priority")
    )
    return seq.explode_lines(docs, "moves", "themes").drop("themes")


@query(
    "take_while_valid",
    """select e.user_id, event_id, value from events e
       left join (select user_id, min(event_id) as bad from events where event_type = 'error' group by user_id) b on b.user_id = e.user_id
       where bad is null or event_id < bad""",
)
def _(spark, sf):
    events = table(spark, sf, "events")
    rows = seq.take_while_valid(events, "user_id", "event_id", F.col("event_type") != "error")
    return rows.select("user_id", "event_id", "value")


@query(
    "complete_only",
    """select c.conv_id, turn, valid from conversations c
       join (select conv_id, arg_max(role, turn) = 'assistant' as ends, min(length(text)) >= 20 as valid from conversations group by conv_id) k
         on k.conv_id = c.conv_id where ends""",
)
def _(spark, sf):
    rows = conversation(spark, sf)
    ends, long_enough = F.col("role") == "assistant", F.col("n_chars") >= 20
    kept = seq.complete_only(rows, "conv_id", "turn", ends)
    strict = seq.complete_only(rows, "conv_id", "turn", ends, long_enough).select("conv_id").distinct()
    flagged = kept.join(strict.withColumn("valid", F.lit(True)), "conv_id", "left")
    return flagged.select("conv_id", "turn", F.coalesce("valid", F.lit(False)).alias("valid"))


@query(
    "assign_targets",
    """select user_id, event_id, case when res = 0 then 0.0::double when (res = 1) = (side = 'w') then 1.0::double else -1.0::double end as value_target,
         n - i + 1 as moves_left_target
       from (select user_id, event_id, case user_id % 3 when 0 then 1 when 1 then -1 else 0 end as res, case when event_id % 2 = 0 then 'w' else 'b' end as side,
               row_number() over (partition by user_id order by event_id) as i, count(*) over (partition by user_id) as n from events) x""",
)
def _(spark, sf):
    n = F.col("user_id") % 3
    result = F.when(n == 0, "1-0").when(n == 1, "0-1").otherwise("1/2-1/2")
    events = table(spark, sf, "events").select(
        "user_id", "event_id", result.alias("result"), F.when(F.col("event_id") % 2 == 0, "w").otherwise("b").alias("side")
    )
    rows = seq.assign_targets(events, "user_id", "event_id", "result", "side")
    return rows.select("user_id", "event_id", "value_target", "moves_left_target")


# The streak ending at a row: rows since the last one that is not low.
STREAKS = """with counted as (select user_id, event_id, value, row_number() over (partition by user_id order by event_id) as i from events),
  streaks as (select *, i - coalesce(max(case when value >= 60 then i end) over (partition by user_id order by event_id), 0) as streak from counted),
  fired as (select user_id, min(event_id) as fire_at from streaks where streak >= 4 group by user_id)
"""


def resignable(spark, sf):
    side = F.when(F.col("event_id") % 2 == 0, "white").otherwise("black")
    return table(spark, sf, "events").select("user_id", "event_id", "value", side.alias("side"))


@query(
    "resign_events",
    STREAKS + "select user_id, fire_at, case when fire_at % 2 = 0 then 'white' else 'black' end as side from fired",
)
def _(spark, sf):
    return seq.resign_events(resignable(spark, sf), "user_id", "event_id", "value", "side", 60)


@query(
    "truncate_at",
    STREAKS
    + """select c.user_id, c.event_id, c.user_id % 10 = 0 as playout from counted c left join fired f on f.user_id = c.user_id
       where fire_at is null or c.event_id < fire_at or c.user_id % 10 = 0""",
)
def _(spark, sf):
    rows = resignable(spark, sf).withColumn("playout", F.col("user_id") % 10 == 0)
    events = seq.resign_events(rows, "user_id", "event_id", "value", "side", 60)
    return seq.truncate_at(rows, events, "user_id", "event_id", "playout").select("user_id", "event_id", "playout")


REPEATS = "select user_id, event_id, event_type, row_number() over (partition by user_id, event_type order by event_id) as seen from events"


@query("repetition", REPEATS)
def _(spark, sf):
    events = table(spark, sf, "events").select("user_id", "event_id", "event_type")
    return seq.repetition(events, "user_id", "event_type", "event_id")


@query(
    "game_status",
    f"""select user_id, event_id, case when mate then 'checkmate' when stalemate then 'stalemate' when clock >= 100 then 'fifty_move' when seen >= 3 then 'threefold'
         when few then 'insufficient' when event_id >= 9000 then 'ply_cap' else 'ongoing' end as status,
         clock >= 100 or (clock >= 8 and seen >= 3) as claimable
       from (select e.user_id, e.event_id, seen, cast(floor(value) as integer) % 110 as clock, e.event_id % 97 = 0 as mate, e.event_id % 89 = 0 as stalemate, e.event_id % 3 = 0 as few
             from events e join ({REPEATS}) r on r.event_id = e.event_id) x""",
)
def _(spark, sf):
    events = table(spark, sf, "events")
    seen = seq.repetition(events, "user_id", "event_type", "event_id")
    rows = seen.withColumn("clock", F.floor("value").cast("int") % 110)
    i = F.col("event_id")
    out = seq.game_status(rows, "clock", "seen", i % 3 == 0, i % 97 == 0, i % 89 == 0, "event_id", 9000)
    return out.select("user_id", "event_id", "status", "claimable")


@query(
    "with_temperature",
    """select doc_id, count(*) as plies, sum(case when i < 30 then 1.0::double else 0.0::double end) as hot
       from (select doc_id, unnest(range(len(string_split(text, ' ')))) as i from documents) x group by doc_id""",
)
def _(spark, sf):
    words = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", " ")).alias("ply", "move"))
    warm = seq.with_temperature(words)
    return warm.groupBy("doc_id").agg(F.count(F.lit(1)).alias("plies"), F.sum("temperature").alias("hot"))


@query(
    "best_candidate",
    """select position, move from (select position, move, row_number() over (partition by position order by tier,
           case when tier = 1 then case when own >= 2 then dtz else -dtz end else 0 end, case when tier = 1 and own >= 2 then seen else 0 end, move) as rn
         from (select *, case when mate then 0 when (own >= 2 and after >= 2) or own <= -2 then 1 else 2 end as tier
           from (select l_orderkey as position, concat_ws('-', l_linenumber, l_partkey, l_suppkey, cast(round(l_extendedprice * 100) as bigint)) as move, l_orderkey % 5 - 2 as own, l_partkey % 5 - 2 as after,
               cast(l_quantity as bigint) as dtz, l_suppkey % 2 as seen, l_linenumber = 7 and l_partkey % 50 = 0 as mate from lineitem) x) y) z where rn = 1""",
)
def _(spark, sf):
    rows = roles.edges(spark, sf).select("position", "move", F.col("n").alias("dtz"))
    parts = F.split("move", "-")
    line, part, supp = [parts[i].cast("long") for i in range(3)]
    candidates = rows.withColumns(
        {
            "own": F.col("position") % 5 - 2,
            "after": part % 5 - 2,
            "seen": supp % 2 == 1,
            "mate": (line == 7) & (part % 50 == 0),
        }
    )
    return seq.best_candidate(candidates, "position", "move", "own", "after", "dtz", "seen", "mate").select("position", "move")


VISITS = """with v as (select position, move, cast(case when position % 7 = 0 then 0 else n end as double) as v from edges)
"""


def visits(spark, sf):
    """Edges, of which one position in seven was never visited."""
    n = F.when(F.col("position") % 7 == 0, 0).otherwise(F.col("n"))
    return roles.edges(spark, sf).select("position", "move", n.alias("n"))


@query(
    "visit_distribution",
    VISITS
    + """select position, move, round(case when s = 0 then 1.0::double / c else v / s end, 6) as prob
      from (select *, sum(v) over (partition by position) as s, count(*) over (partition by position) as c from v) x""",
    ("edges",),
)
def _(spark, sf):
    out = seq.visit_distribution(visits(spark, sf), "position", "move", "n", 1.0)
    return out.select("position", "move", r6("prob").alias("prob"))


@query(
    "visit_distribution_warm",
    VISITS
    + """select position, move, round(case when s = 0 then 1.0::double / c else sqrt(v) / s end, 6) as prob
      from (select *, sum(sqrt(v)) over (partition by position) as s, count(*) over (partition by position) as c from v) x""",
    ("edges",),
)
def _(spark, sf):
    out = seq.visit_distribution(visits(spark, sf), "position", "move", "n", 2.0)
    return out.select("position", "move", r6("prob").alias("prob"))


@query(
    "visit_distribution_greedy",
    VISITS + """select position, move, case when row_number() over (partition by position order by v desc, move) = 1 then 1.0::double else 0.0::double end as prob from v""",
    ("edges",),
)
def _(spark, sf):
    return seq.visit_distribution(visits(spark, sf), "position", "move", "n", 0).select("position", "move", "prob")


@query(
    "masked_softmax_rows",
    """select position, move, round(w / sum(w) over (partition by position), 6) as prior from (
         select position, move, exp(n / 10.0::double - max(n / 10.0::double) over (partition by position)) as w from edges where p > 0.01) x""",
    ("edges",),
)
def _(spark, sf):
    edges = roles.edges(spark, sf).withColumn("logit", F.col("n") / 10.0).withColumn("legal", F.col("p") > 0.01)
    rows = edge_ops.masked_softmax_rows(edges, "position", "move", "logit", "legal")
    return rows.select("position", "move", r6("prior").alias("prior"))


@query(
    "top_moves",
    """select position, move, n, p, place, round(n / greatest(t, 1)::double, 6) as share, is_chosen from (
         select *, sum(n) over (partition by position) as t, cast(row_number() over (partition by position order by n desc, p desc, move) as integer) as place,
           move like '1-%' as is_chosen from edges) x where place <= 5""",
    ("edges",),
)
def _(spark, sf):
    edges = roles.edges(spark, sf).withColumn("pick", F.when(F.col("move").like("1-%"), F.col("move")).otherwise(""))
    rows = edge_ops.top_moves(edges, "position", "move", 5, "n", "p", "pick")
    return rows.select("position", "move", "n", "p", "place", r6("share").alias("share"), "is_chosen")


@query(
    "paired_schedule",
    """select conv_id, a_is_white, conv_id < n // 2 as first_half
       from (select distinct conv_id from conversations) c, (select count(distinct conv_id) as n from conversations) t, unnest([true, false]) as u(a_is_white)""",
)
def _(spark, sf):
    openings = table(spark, sf, "conversations").select("conv_id").distinct()
    halves = seq.paired_schedule(openings, "conv_id", "halves").withColumnRenamed("a_is_white", "first_half")
    return seq.paired_schedule(openings, "conv_id").join(halves, "conv_id")


@query(
    "sweep_grid",
    """with d as (select distinct l_linenumber / 2.0::double as c, case when l_suppkey % 4 > 0 then (l_suppkey % 4) / 10.0::double end as f from lineitem where l_returnflag = 'N' and l_linenumber < 5)
       select c as c_puct, f as fpu from (select distinct l_linenumber / 2.0::double as c from lineitem) a, unnest([null, 0.0, 0.1, 0.2, 0.5]::double[]) as u(f)
       where not exists (select 1 from d where d.c = a.c and d.f is not distinct from u.f)""",
)
def _(spark, sf):
    lines = table(spark, sf, "lineitem")
    c = (F.col("l_linenumber") / 2.0).alias("c_puct")
    f = F.when(F.col("l_suppkey") % 4 > 0, F.col("l_suppkey") % 4 / 10.0).alias("fpu")
    done = lines.where("l_returnflag = 'N' and l_linenumber < 5").select(c, f)
    return seq.sweep_grid(lines.select(c), [None, 0.0, 0.1, 0.2, 0.5], done)


@query(
    "running_score",
    """select user_id, event_id, sum(points) over w as points_so_far, count(*) over w as games_so_far, round(sum(points) over w / count(*) over w, 6) as score_so_far
       from results window w as (partition by user_id order by event_id rows unbounded preceding)""",
    ("results",),
)
def _(spark, sf):
    rows = running_score(roles.results(spark, sf), "user_id", "event_id")
    return rows.select("user_id", "event_id", "points_so_far", "games_so_far", r6("score_so_far").alias("score_so_far"))
