"""Match summaries, ratings, gates, curves and artifact picks."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import roles
from checks.base import query, rounded, table
from curate.functions.scores import points
from curate.operators import artifacts, matches

SUMMARY = """with s as (select player, count(*) as games, count(*) filter (where points = 1) as wins, count(*) filter (where points = 0.5) as draws,
    count(*) filter (where points = 0) as losses, sum(points) as points, avg(points) as score, coalesce(var_samp(points), 0) as variance
  from (select player, case result when '1-0' then 1.0::double when '0-1' then 0.0::double else 0.5::double end as points from games) x group by player),
 ci as (select *, sqrt(variance / games) as se, score - 1.96 * sqrt(variance / games) as ci_low, score + 1.96 * sqrt(variance / games) as ci_high from s)
"""


def scores(spark, sf):
    return roles.games(spark, sf).select("game_id", "player", points("result").alias("points"))


@query(
    "match_summary",
    SUMMARY
    + """select player, games, wins, draws, losses, points, round(score, 6) as score, round(variance, 6) as variance, round(se, 6) as se, round(ci_low, 6) + 0.0 as ci_low,
      round(ci_high, 6) as ci_high, round(case when score > 0 and score < 1 then -400 * log10(1 / score - 1) end, 6) + 0.0 as elo,
      case when round(ci_low, 9) > 0.5 then 'A stronger' when round(ci_high, 9) < 0.5 then 'B stronger' else 'not significant' end as verdict from ci""",
    ("games",),
)
def _(spark, sf):
    return rounded(matches.match_summary(scores(spark, sf), "player"), "score", "variance", "se", "ci_low", "ci_high", "elo")


@query(
    "gauntlet",
    SUMMARY
    + """select cast(player as varchar) as label, games, wins, draws, losses, round(score, 6) as score,
      round(case when score <= 0 then -800 when score >= 1 then 800 else greatest(least(-400 * log10(1 / score - 1), 800), -800) end, 6) + 0.0 as elo from ci""",
    ("games",),
)
def _(spark, sf):
    rows = scores(spark, sf).withColumn("label", F.col("player").cast("string"))
    return rounded(matches.gauntlet(rows), "score", "elo")


@query(
    "order_labels",
    """select label, row_number() over (order by case when regexp_full_match(label, '[0-9]+') then 0 else 1 end, try_cast(label as bigint), label) as place
       from (select distinct case when p_size > 40 then p_type else cast(p_size as varchar) end as label from part) x""",
)
def _(spark, sf):
    label = F.when(F.col("p_size") > 40, F.col("p_type")).otherwise(F.col("p_size").cast("string"))
    return matches.order_labels(table(spark, sf, "part").select(label.alias("label")).distinct(), place="place")


ANCHORS = """with m as (select n_name, 1400 + 100 * (o_orderkey % 10) as anchor, count(*) as n, sum(case o_orderstatus when 'F' then 1.0::double when 'O' then 0.0::double else 0.5::double end) as pts
    from orders join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey group by 1, 2),
  grid as (select n_name, r, sum(-pts * ln(1 + pow(10.0::double, (anchor - r) / 400.0::double)) - (n - pts) * ln(1 + pow(10.0::double, (r - anchor) / 400.0::double))) as ll
    from m, unnest(range(0, 4001)) as g(r) group by n_name, r),
  best as (select n_name, max(ll) as ll from grid group by n_name),
  total as (select n_name, cast(sum(n) as bigint) as games, sum(pts) as points from m group by n_name)
"""


# One step from the ratings of step {1}, and the standard error there.
STEP = """s{0} as (select n_name, any_value(r) + sum(pts - n * e) / (ln(10) / 400 * sum(n * e * (1 - e))) as r, 1 / (ln(10) / 400 * sqrt(sum(n * e * (1 - e)))) as se
    from (select m.*, r, 1 / (1 + pow(10.0::double, (anchor - r) / 400.0::double)) as e from m join s{1} using (n_name)) x group by n_name)"""


def anchored(spark, sf):
    orders, customer, nation = (table(spark, sf, t) for t in ("orders", "customer", "nation"))
    status = F.col("o_orderstatus")
    return (
        orders.join(customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        .join(F.broadcast(nation.select("n_nationkey", "n_name")), F.col("n_nationkey") == F.col("c_nationkey"))
        .select(
            "n_name",
            (1400 + 100 * (F.col("o_orderkey") % 10)).alias("anchor"),
            F.when(status == "F", 1.0).when(status == "O", 0.0).otherwise(0.5).alias("points"),
        )
    )


@query(
    "anchored_elo",
    ANCHORS
    + """select grid.n_name, games, points, cast(arg_max(r, grid.ll) as integer) as rating, cast(min(r) filter (where grid.ll >= best.ll - 1.92) as integer) as ci_low,
      cast(max(r) filter (where grid.ll >= best.ll - 1.92) as integer) as ci_high,
      min(r) filter (where grid.ll >= best.ll - 1.92) = 0 or max(r) filter (where grid.ll >= best.ll - 1.92) = 4000 as at_edge
    from grid join best on best.n_name = grid.n_name join total on total.n_name = grid.n_name group by grid.n_name, games, points""",
)
def _(spark, sf):
    return matches.anchored_elo(anchored(spark, sf), "n_name")


@query(
    "anchored_elo_newton",
    ANCHORS
    + f""", s0 as (select n_name, cast(arg_max(r, ll) as double) as r from grid group by n_name),
  {STEP.format(1, 0)}, {STEP.format(2, 1)}, {STEP.format(3, 2)}
select n_name, round(r, 6) as rating, round(se, 6) as std_error from s3""",
)
def _(spark, sf):
    """Against three Newton steps from the best of the grid."""
    return rounded(matches.anchored_elo(anchored(spark, sf), "n_name", method="newton"), "rating", "std_error")


@query(
    "gate",
    """select iteration, cand_score, cand_score >= 20 as accepted, cast(sum(case when cand_score >= 20 then 1 else 0 end) over (order by iteration) as bigint) as generation
       from (select event_id // 50 as iteration, sum(points) as cand_score from results group by 1) x""",
    ("results",),
)
def _(spark, sf):
    rows = roles.results(spark, sf).withColumn("iteration", F.floor(F.col("event_id") / 50))
    return matches.gate(rows, min_score=20)


CURVE = """with o as (select l_suppkey % 3 as opponent, l_linenumber, game_id, pieces, 100 * (1 / (1 + exp(-0.00368::double * (l_extendedprice - 50000) / 100.0)) - 0.5) * case when game_id % 2 = 0 then 1 else -1 end as v
  from predictions)
"""


def valued(spark, sf):
    rows = roles.predictions(spark, sf)
    cp = (F.col("l_extendedprice") - 50_000) / 100.0
    return rows.select((F.col("l_suppkey") % 3).alias("opponent"), "l_linenumber", "game_id", "pieces", cp.alias("cp"))


@query(
    "advantage_curve",
    CURVE
    + """select opponent, l_linenumber, games, advantage from (select opponent, l_linenumber, count(distinct game_id) as games, round(avg(v), 6) + 0.0 as advantage from o group by 1, 2) x where games >= 3""",
    ("predictions",),
)
def _(spark, sf):
    out = matches.advantage_curve(valued(spark, sf), "game_id", "l_linenumber", "cp", F.col("game_id") % 2 == 0, "opponent")
    return rounded(out, "advantage")


@query(
    "phase_advantage",
    CURVE
    + """select opponent, case when pieces >= 25 then 'opening' when pieces >= 13 then 'middlegame' else 'endgame' end as phase, count(*) as n_rows, round(avg(v), 6) + 0.0 as advantage
      from o group by 1, 2""",
    ("predictions",),
)
def _(spark, sf):
    out = matches.phase_advantage(valued(spark, sf), "cp", F.col("game_id") % 2 == 0, "pieces", "opponent")
    return rounded(out, "advantage")


@query(
    "resign_fp",
    """select event, count(*) filter (where playout) as playout_games, count(*) filter (where fired) as fired, count(*) filter (where fired and not lost) as false_positives,
         round(count(*) filter (where fired and not lost) / (count(*) filter (where fired))::double, 6) as fp_rate
       from (select event, playout, playout and side is not null as fired, case when side = 'white' then result = '0-1' else result = '1-0' end as lost
         from (select event, result, player % 10 = 0 as playout, case game_id % 3 when 0 then 'white' when 1 then 'black' end as side from games) x) y group by event""",
    ("games",),
)
def _(spark, sf):
    n = F.col("game_id") % 3
    ledger = roles.games(spark, sf).select(
        "event",
        "result",
        (F.col("player") % 10 == 0).alias("resign_playout"),
        F.when(n == 0, "white").when(n == 1, "black").alias("would_resign_side"),
    )
    return rounded(matches.resign_fp(ledger, "event"), "fp_rate")


PATHS = "select concat('/weights/', replace(p_name, ' ', '_'), '_network_v', cast(p_size as varchar), '.weights.h5') as path, p_size from part"


def paths(spark, sf):
    name = F.replace("p_name", F.lit(" "), F.lit("_"))
    path = F.concat(F.lit("/weights/"), name, F.lit("_network_v"), F.col("p_size").cast("string"), F.lit(".weights.h5"))
    return table(spark, sf, "part").select(path.alias("path"))


@query(
    "latest",
    f"""select path, cast(v as integer) as version from (select path, regexp_extract(path, '_v(\\d+)', 1) as v from ({PATHS}) x where path like '/weights/small_ring_network%') y
       order by cast(v as integer) desc, path limit 1""",
)
def _(spark, sf):
    return artifacts.latest(paths(spark, sf), "small_ring_network")


@query(
    "retention",
    """select p_brand, p_partkey, p_partkey % 10 = 0 or p_partkey > max(p_partkey) over (partition by p_brand) - 3 as keep from part""",
)
def _(spark, sf):
    parts = table(spark, sf, "part").select("p_brand", "p_partkey")
    return artifacts.retention(parts, "p_partkey", by="p_brand")
