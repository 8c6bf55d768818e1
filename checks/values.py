"""Scalar functions: labels, scores, names and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import roles
from checks.base import query, r6, table
from curate.functions import labels, names, scores, vectors
from curate.operators.games import filter_games


@query(
    "wdl_class",
    "select rid, turn, wdl from plies",
    ("plies",),
)
def _(spark, sf):
    return roles.plies(spark, sf).select("rid", "turn", "wdl")


@query(
    "tb_class",
    """select rid, case when s >= 2 then 0 when s <= -2 then 2 else 1 end as cls
       from (select rid, l_partkey % 5 - 2 as s from plies) x""",
    ("plies",),
)
def _(spark, sf):
    rows = roles.plies(spark, sf)
    return rows.select("rid", labels.tb_class(F.col("l_partkey") % 5 - 2).alias("cls"))


@query(
    "outcome_onehot",
    """select o_orderkey, case when v = 1 then 1.0::double else 0.0::double end as w, case when v = 0 then 1.0::double else 0.0::double end as d,
         case when v = -1 then 1.0::double else 0.0::double end as l
       from (select o_orderkey, o_custkey % 4 - 1 as v from orders) x""",
)
def _(spark, sf):
    hot = labels.outcome_onehot(F.col("o_custkey") % 4 - 1)
    rows = table(spark, sf, "orders").select("o_orderkey", hot.alias("v"))
    return rows.select("o_orderkey", F.col("v")[0].alias("w"), F.col("v")[1].alias("d"), F.col("v")[2].alias("l"))


@query(
    "wdl_scalar",
    """select rid, round(p_win - p_loss, 6) + 0.0 as scalar, round(p_win, 6) as alone from predictions""",
    ("predictions",),
)
def _(spark, sf):
    rows = roles.predictions(spark, sf)
    alone = labels.wdl_scalar(F.slice("probs", 1, 1))
    return rows.select("rid", r6(labels.wdl_scalar("probs")).alias("scalar"), r6(alone).alias("alone"))


@query(
    "wdl_expect",
    "select rid, round(p_win + 0.5 * p_draw, 6) as expectation from predictions",
    ("predictions",),
)
def _(spark, sf):
    return roles.predictions(spark, sf).select("rid", r6(labels.wdl_expect("probs")).alias("expectation"))


@query(
    "blend",
    """select rid,
         round(case when w is null then h0 else 0.5 * h0 + 0.5 * w / t end, 6) as tw,
         round(case when w is null then h1 else 0.5 * h1 + 0.5 * d / t end, 6) as td,
         round(case when w is null then h2 else 0.5 * h2 + 0.5 * l / t end, 6) as tl
       from (select rid, w, d, l, greatest(cast(w + d + l as double), 1e-9) as t,
               case when wdl = 0 then 1.0::double else 0.0::double end as h0, case when wdl = 1 then 1.0::double else 0.0::double end as h1,
               case when wdl = 2 then 1.0::double else 0.0::double end as h2
             from plies left join annotations on fen = pos) x""",
    ("plies", "annotations"),
)
def _(spark, sf):
    ann = roles.annotations(spark, sf).withColumnRenamed("fen", "pos")
    rows = roles.plies(spark, sf).join(ann, "pos", "left")
    target = labels.blend("wdl", "w", "d", "l").alias("t")
    return rows.select("rid", target).select("rid", *[r6(F.col("t")[i]).alias(n) for i, n in enumerate(("tw", "td", "tl"))])


@query(
    "clip_cp",
    """select event_id, cast(greatest(least(c, 32000), -32000) as bigint) as clipped,
         case when m > 0 then 32000 when m < 0 then -32000 else greatest(least(c, 32000), -32000) end as with_mate
       from (select event_id, cast(round(value * 1000) as bigint) - 40000 as c, user_id % 3 - 1 as m from events) x""",
)
def _(spark, sf):
    cp = F.round(F.col("value") * 1000).cast("long") - 40000
    return table(spark, sf, "events").select(
        "event_id",
        scores.clip_cp(cp).alias("clipped"),
        scores.clip_cp(cp, F.col("user_id") % 3 - 1).cast("long").alias("with_mate"),
    )


@query(
    "expected_score",
    """select fen, cp, round(1 / (1 + pow(10.0::double, -cp / 400.0::double)), 6) as e from annotations""",
    ("annotations",),
)
def _(spark, sf):
    return roles.annotations(spark, sf).select("fen", "cp", r6(scores.expected_score("cp")).alias("e"))


@query(
    "win_advantage",
    """select fen, round(100 * (1 / (1 + exp(-0.00368::double * cp)) - 0.5), 6) + 0.0 as v from annotations""",
    ("annotations",),
)
def _(spark, sf):
    return roles.annotations(spark, sf).select("fen", r6(scores.win_advantage("cp")).alias("v"))


@query(
    "elo_diff",
    """select l_suppkey, share, round(case when share > 0 and share < 1 then -400 * log10(1 / share - 1) end, 6) + 0.0 as elo,
         round(case when share <= 0 then -800 when share >= 1 then 800 else greatest(least(-400 * log10(1 / share - 1), 800), -800) end, 6) + 0.0 as capped
       from (select l_suppkey, l_linenumber, avg(case when wdl = 0 then 1.0::double when wdl = 1 then 0.5::double else 0.0::double end) as share
             from plies group by l_suppkey, l_linenumber, l_partkey % 20) x""",
    ("plies",),
)
def _(spark, sf):
    points = F.when(F.col("wdl") == 0, 1.0).when(F.col("wdl") == 1, 0.5).otherwise(0.0)
    rows = roles.plies(spark, sf).groupBy("l_suppkey", "l_linenumber", F.col("l_partkey") % 20).agg(F.avg(points).alias("share"))
    capped = r6(scores.elo_diff("share", 800)).alias("capped")
    return rows.select("l_suppkey", "share", r6(scores.elo_diff("share")).alias("elo"), capped)


@query(
    "points",
    """select game_id, p as white, case when player % 2 = 0 then p else 1.0 - p end as a
       from (select *, case result when '1-0' then 1.0::double when '0-1' then 0.0::double else 0.5::double end as p from games) x""",
    ("games",),
)
def _(spark, sf):
    rows = roles.games(spark, sf)
    a_is_white = F.col("player") % 2 == 0
    return rows.select("game_id", scores.points("result").alias("white"), scores.points("result", a_is_white).alias("a"))


@query(
    "source_of",
    """select rid, source, case source when 'game' then 0 when 'puzzle' then 1 else 2 end as source_id from plies""",
    ("plies",),
)
def _(spark, sf):
    source = F.col("source")
    prefix = F.when(source == "game", "pool_games_w").when(source == "puzzle", "pool_puzzles").otherwise("pool_tablebase_w")
    path = F.concat(F.lit("/pools/"), prefix, (F.col("l_suppkey") % 12).cast("string"), F.lit(".csv"))
    named = labels.source_of(path)
    return roles.plies(spark, sf).select("rid", named.alias("source"), labels.source_id(named).alias("source_id"))


@query(
    "is_priority",
    """select doc_id, text like '%mate%' or text like '%endgame%' as mate_or_endgame, text like '%the%' or text like '%der%' as theme from documents""",
)
def _(spark, sf):
    theme = labels.is_priority("text", ("the", "der")).alias("theme")
    return table(spark, sf, "documents").select("doc_id", labels.is_priority("text").alias("mate_or_endgame"), theme)


@query(
    "phase",
    """select rid, pieces, case when pieces between 25 and 32 then 'opening' when pieces between 13 and 24 then 'middlegame'
         when pieces between 2 and 12 then 'endgame' end as phase
       from (select rid, cast(l_partkey % 35 as integer) as pieces from plies) x""",
    ("plies",),
)
def _(spark, sf):
    rows = roles.plies(spark, sf).select("rid", (F.col("l_partkey") % 35).cast("int").alias("pieces"))
    return rows.withColumn("phase", scores.phase("pieces"))


@query(
    "artifact_version",
    """select p_partkey, cast(p_size as integer) as version, -1 as no_version, cast(p_size as integer) as generation, p_brand as label from part""",
)
def _(spark, sf):
    size = F.col("p_size").cast("string")
    path = F.concat(F.lit("/weights/v9/"), F.col("p_name"), F.lit("_v"), size, F.lit(".weights.h5"))
    gen = F.concat(F.lit("/weights/gen_"), size, F.lit(".weights.h5"))
    saved = F.concat(F.lit("/weights/sl_"), F.col("p_brand"), F.lit(".weights.h5"))
    plain = F.concat(F.lit("/v7/net_"), size, F.lit(".weights.h5"))
    return table(spark, sf, "part").select(
        "p_partkey",
        names.artifact_version(path).alias("version"),
        names.artifact_version(plain).alias("no_version"),
        names.generation(gen).alias("generation"),
        names.checkpoint_label(saved).alias("label"),
    )


@query(
    "cell_key",
    """select distinct concat('cpuct=', printf('%.2f', c), ',fpu=', case when f is null then 'None' else printf('%.2f', f) end) as cell
       from (select l_linenumber / 2.0::double as c, case when l_suppkey % 4 > 0 then (l_suppkey % 4) / 10.0::double end as f from lineitem) x""",
)
def _(spark, sf):
    f = F.when(F.col("l_suppkey") % 4 > 0, F.col("l_suppkey") % 4 / 10.0)
    cell = names.cell_key(F.col("l_linenumber") / 2.0, f)
    return table(spark, sf, "lineitem").select(cell.alias("cell")).distinct()


@query(
    "entropy",
    """select rid, round(-(p_win * ln(p_win) + p_draw * ln(p_draw) + p_loss * ln(p_loss)), 6) + 0.0 as h from predictions""",
    ("predictions",),
)
def _(spark, sf):
    return roles.predictions(spark, sf).select("rid", r6(vectors.entropy("probs")).alias("h"))


@query(
    "soft_ce",
    """select rid, round(-(p_draw * ln(p_win) + p_loss * ln(p_draw) + p_win * ln(p_loss)), 6) + 0.0 as ce from predictions""",
    ("predictions",),
)
def _(spark, sf):
    p = F.col("probs")
    target = F.array(p[1], p[2], p[0])
    return roles.predictions(spark, sf).select("rid", r6(vectors.soft_ce(target, "probs")).alias("ce"))


@query(
    "hard_ce",
    """select rid, round(-ln(case wdl when 0 then p_win when 1 then p_draw else p_loss end), 6) + 0.0 as ce from predictions""",
    ("predictions",),
)
def _(spark, sf):
    return roles.predictions(spark, sf).select("rid", r6(vectors.hard_ce("wdl", "probs")).alias("ce"))


@query(
    "logit_ce",
    """with z as (select vec_id, label, unnest(embedding)::double as v, generate_subscripts(embedding, 1) - 1 as i from embeddings),
       top as (select vec_id, max(v) as m from z group by vec_id)
       select z.vec_id, round(max(m) + ln(sum(exp(v - m))) - max(case when i = label then v end), 6) + 0.0 as ce
       from z join top on z.vec_id = top.vec_id group by z.vec_id""",
)
def _(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", r6(vectors.logit_ce("embedding", "label")).alias("ce"))


@query(
    "argmax",
    """select vec_id, cast(best as integer) as best, best = label as hit
       from (select vec_id, label, list_position(embedding, list_max(embedding)) - 1 as best from embeddings) x""",
)
def _(spark, sf):
    best = vectors.argmax("embedding")
    return table(spark, sf, "embeddings").select("vec_id", best.alias("best"), (best == F.col("label")).alias("hit"))


@query(
    "masked_softmax",
    """with z as (select vec_id, unnest(embedding)::double as v, generate_subscripts(embedding, 1) - 1 as i from embeddings),
       ok as (select * from z where i % 3 = vec_id % 3),
       top as (select vec_id, max(v) as m from ok group by vec_id),
       s as (select ok.vec_id, sum(exp(v - m)) as s from ok join top on ok.vec_id = top.vec_id group by ok.vec_id)
       select z.vec_id, cast(i as integer) as i, round(case when i % 3 = z.vec_id % 3 then exp(v - m) / s else 0 end, 6) as p
       from z join top on z.vec_id = top.vec_id join s on z.vec_id = s.vec_id""",
)
def _(spark, sf):
    allowed = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: i % 3 == F.col("vec_id") % 3)
    rows = table(spark, sf, "embeddings").select("vec_id", vectors.masked_softmax("embedding", allowed).alias("p"))
    return rows.select("vec_id", F.posexplode("p").alias("i", "p")).withColumn("p", r6("p"))


@query(
    "disagree",
    """select e.vec_id, abs(q) > 0.15 and abs(raw) > 0.15 and (q > 0) <> (raw > 0) as flag
       from (select vec_id, embedding[1] * 4 as q, embedding[2] * 4 as raw from embeddings) e""",
)
def _(spark, sf):
    q, raw = F.col("embedding")[0] * 4, F.col("embedding")[1] * 4
    return table(spark, sf, "embeddings").select("vec_id", scores.disagree(q, raw).alias("flag"))


@query(
    "should_checkpoint",
    """select o_orderkey, case when n <= 12 then true when n <= 40 then (n - 12) % 4 = 0 else (n - 40) % 40 = 0 end as keep
       from (select o_orderkey, o_custkey + 1 as n from orders) x""",
)
def _(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", scores.should_checkpoint(F.col("o_custkey") + 1).alias("keep"))


@query(
    "filter_games",
    """select game_id, event, count(l_orderkey) as n_plies from games left join lineitem on l_orderkey = game_id
       where price >= 150000 and player * 1500 >= 150000 and event not like '5%' and result in ('1-0', '0-1', '1/2-1/2') group by game_id, event having count(l_orderkey) >= 4""",
    ("games",),
)
def _(spark, sf):
    """Games of stored plies: strong players, a known result, no skipped event, four plies at least."""
    rows = roles.games(spark, sf).withColumn("white_elo", F.col("price")).withColumn("black_elo", F.col("player") * 1500)
    # An order has at most seven lines.
    plies = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("game_id")).agg(F.collect_list("l_partkey").alias("moves"))
    stored = rows.join(plies, "game_id", "left")
    kept = filter_games(stored, 150_000, "white_elo", "black_elo", event="event", skip_event="5%", moves="moves", min_plies=4)
    return kept.select("game_id", "event", F.size("moves").cast("long").alias("n_plies"))
