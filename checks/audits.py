"""Reports over predictions: groups, segments, calibration, agreement, weighted metrics, scoring."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from checks import roles
from checks.base import query, r6, rounded, table
from curate.functions.labels import wdl_expect
from curate.functions.scores import expected_score
from curate.functions.vectors import argmax, hard_ce, soft_ce
from curate.operators import joins, monitor, ranking, reports, scoring
from curate.plans.model_audit import audit
from curate.storage import stage

PRED = """with pred as (select *, case when p_win >= p_draw and p_win >= p_loss then 0 when p_draw >= p_loss then 1 else 2 end as best,
    case wdl when 0 then p_win when 1 then p_draw else p_loss end as p_true_cls from predictions)
"""
ONE = "avg(case when {0} then 1.0::double else 0.0::double end)"


@query(
    "group_report",
    PRED
    + f"""select source, wdl, count(*) as n_rows, round(avg(p_win), 6) as mean_win, round(avg(p_draw), 6) as mean_draw, round(avg(p_loss), 6) as mean_loss,
      round({ONE.format('best = 0')}, 6) as argmax_win, round({ONE.format('best = 1')}, 6) as argmax_draw, round({ONE.format('best = 2')}, 6) as argmax_loss,
      round(avg(p_true_cls), 6) as p_true, round({ONE.format('best = wdl')}, 6) as acc from pred group by source, wdl""",
    ("predictions",),
)
def _(spark, sf):
    out = reports.group_report(roles.predictions(spark, sf), ["source", "wdl"], "probs", "wdl")
    return rounded(out, *[c for c in out.columns if c not in ("source", "wdl", "n_rows")])


@query(
    "segment_table",
    PRED
    + f"""select l_suppkey, l_linenumber, count(*) as n_rows, round(avg(p_draw), 6) as p_draw, round({ONE.format('best = 1')}, 6) as acc from pred
      where (case when wdl = 1 then 'draw_train' else 'win_train' end) like 'draw%' group by l_suppkey, l_linenumber having count(*) >= 25""",
    ("predictions",),
)
def _(spark, sf):
    rows = roles.predictions(spark, sf).withColumn("group", F.when(F.col("wdl") == 1, "draw_train").otherwise("win_train"))
    out = reports.segment_table(rows, ["l_suppkey", "l_linenumber"], "probs", "group", "draw")
    return rounded(out, "p_draw", "acc")


BINS = PRED + """, binned as (select *, cast(least(floor(p_win * 10), 9) as integer) as bin, case when wdl = 0 then 1.0::double else 0.0::double end as won from pred where l_linenumber < 6),
  cal as (select source, bin, count(*) as n_rows, avg(p_win) as mean_p, avg(won) as actual from binned group by source, bin)
"""


def odd_chances(spark, sf):
    """The predictions with ``chance``; on some rows it is no number, or none from 0 to 1, and these are in no bin."""
    n, p = F.col("l_linenumber"), F.col("probs")[0]
    odd = F.when(n == 6, float("nan")).when(F.col("l_suppkey") % 2 == 0, -p).otherwise(1 + p)
    return roles.predictions(spark, sf).withColumn("chance", F.when(n >= 6, odd).otherwise(p))


@query(
    "calibration",
    BINS + "select source, bin, n_rows, round(mean_p, 6) as mean_p, round(actual, 6) as actual from cal",
    ("predictions",),
)
def _(spark, sf):
    out = reports.calibration(odd_chances(spark, sf), "chance", F.col("wdl") == 0, by="source")
    return rounded(out, "mean_p", "actual")


@query(
    "ece",
    BINS + "select source, round(sum(n_rows * abs(mean_p - actual)) / sum(n_rows), 6) as ece, cast(sum(n_rows) as bigint) as n_rows from cal group by source",
    ("predictions",),
)
def _(spark, sf):
    out = reports.ece(odd_chances(spark, sf), "chance", F.col("wdl") == 0, by="source")
    return rounded(out, "ece")


@query(
    "value_ce",
    PRED
    + f"""select source, count(*) as n_rows, round(avg(-ln(p_true_cls)), 6) as value_ce, round({ONE.format('best = wdl')}, 6) as acc from pred group by source""",
    ("predictions",),
)
def _(spark, sf):
    out = reports.value_ce(roles.predictions(spark, sf), "source", "probs", "wdl")
    return rounded(out, "value_ce", "acc")


EXPECT = """with e as (select p.*, p_win + 0.5 * p_draw as net, 1 / (1 + pow(10.0::double, -cp / 400.0::double)) as ref,
    case when pieces between 25 and 32 then 'opening' when pieces between 13 and 24 then 'middlegame' when pieces between 2 and 12 then 'endgame' end as phase
  from predictions p join annotations on fen = l_partkey)
"""


def expectations(spark, sf):
    ann = roles.annotations(spark, sf).select(F.col("fen").alias("l_partkey"), "cp")
    rows = roles.predictions(spark, sf).join(ann, "l_partkey")
    return rows.withColumn("net", wdl_expect("probs")).withColumn("ref", expected_score("cp"))


@query(
    "agreement",
    EXPECT
    + """select phase, cast(grouping(phase) as integer) as overall, count(*) as n_rows, round(avg(abs(net - ref)), 6) as mae, round(case when stddev_pop(net) * stddev_pop(ref) > 0 then corr(net, ref) end, 6) + 0.0 as corr
      from e group by rollup (phase)""",
    ("predictions", "annotations"),
)
def _(spark, sf):
    return rounded(reports.agreement(expectations(spark, sf), "net", "ref", "pieces"), "mae", "corr")


@query(
    "worst",
    EXPECT + "select rid, round(abs(net - ref), 6) as gap from e order by round(abs(net - ref), 9) desc, rid limit 12",
    ("predictions", "annotations"),
)
def _(spark, sf):
    rows = expectations(spark, sf).select("rid", F.round(F.abs(F.col("net") - F.col("ref")), 9).alias("gap"))
    return rounded(ranking.worst(rows, "gap", 12, ["rid"]), "gap")


TARGETS = PRED + """, t as (select *, case when l_linenumber = 7 then 0.0::double else 1.0::double end as weight, -ln(p_true_cls) as ploss, best = wdl as pmatch,
    -(0.5 * ln(p_win) + 0.3 * ln(p_draw) + 0.2 * ln(p_loss)) as vloss, best = 0 as vmatch from pred)
"""


@query(
    "weighted_metrics",
    TARGETS
    + f"""select *, policy_loss + value_loss as loss from (select source, cast(grouping(source) as integer) as overall, count(*) as n_rows, round(sum(ploss * weight) / count(*), 5) as policy_loss,
      round(sum(case when pmatch then weight else 0 end) / greatest(sum(weight), 1e-9), 5) as policy_acc, round(avg(vloss), 5) as value_loss,
      round({ONE.format('vmatch')}, 5) as value_acc from (select * replace (nullif(source, 'puzzle') as source) from t) t group by rollup (source)) x""",
    ("predictions",),
)
def _(spark, sf):
    target = F.array(F.lit(0.5), F.lit(0.3), F.lit(0.2))
    rows = roles.predictions(spark, sf).select(
        F.expr("nullif(source, 'puzzle')").alias("source"),
        hard_ce("wdl", "probs").alias("ploss"),
        (argmax("probs") == F.col("wdl")).alias("pmatch"),
        soft_ce(target, "probs").alias("vloss"),
        (argmax("probs") == argmax(target)).alias("vmatch"),
        F.when(F.col("l_linenumber") == 7, 0.0).otherwise(1.0).alias("weight"),
    )
    out = reports.weighted_metrics(rows)
    parts = out.withColumns({c: F.round(c, 5) for c in ("policy_loss", "policy_acc", "value_loss", "value_acc")})
    return parts.withColumn("loss", F.col("policy_loss") + F.col("value_loss"))


@query(
    "entropy_floor",
    PRED
    + """select source, cast(grouping(source) as integer) as overall, count(*) as n_rows, round(avg(h), 6) as floor, round(avg(ce), 6) as loss, round(avg(ce) - avg(h), 6) + 0.0 as excess
      from (select nullif(source, 'puzzle') as source, -(p_win * ln(p_win) + p_draw * ln(p_draw) + p_loss * ln(p_loss)) as h, -(p_win + p_draw + p_loss) * ln(1.0::double / 3) as ce from pred) x
      group by rollup (source)""",
    ("predictions",),
)
def _(spark, sf):
    flat = F.array(*[F.lit(1.0 / 3)] * 3)
    rows = roles.predictions(spark, sf).withColumns({"ce": soft_ce("probs", flat), "source": F.expr("nullif(source, 'puzzle')")})
    return rounded(reports.entropy_floor(rows, "probs", "ce"), "floor", "loss", "excess")


@query(
    "ledger_totals",
    """select event, count(*) as games, cast(sum(n) as bigint) as positions, cast(sum(case when result = '1/2-1/2' then 0 else n end) as bigint) as skipped,
         count(*) filter (where result = '1-0') as white_wins, count(*) filter (where result = '0-1') as black_wins, count(*) filter (where result = '1/2-1/2') as draws,
         round(sum(price) / sum(n), 6) as seconds_per_move
       from (select g.*, coalesce(n, 0) as n from games g left join (select l_orderkey, count(*) as n from lineitem group by l_orderkey) c on l_orderkey = game_id) x
       group by event""",
    ("games",),
)
def _(spark, sf):
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("game_id")).agg(F.count(F.lit(1)).alias("n"))
    ledger = roles.games(spark, sf).join(lines, "game_id", "left").withColumn("n_positions", F.coalesce("n", F.lit(0)))
    ledger = ledger.withColumn("n_skipped", F.when(F.col("result") == "1/2-1/2", 0).otherwise(F.col("n_positions")))
    out = reports.ledger_totals(ledger, "event", seconds="price", moves="n_positions")
    return rounded(out, "seconds_per_move")


@query(
    "batch_stats",
    """select l_returnflag, count(*) as calls, cast(sum(cast(l_quantity as bigint)) as bigint) as rows, round(avg(l_quantity), 6) as mean_batch,
         cast(sum(l_linenumber) as bigint) as hits, cast(sum(cast(l_quantity as bigint)) - sum(l_linenumber) as bigint) as misses from lineitem group by l_returnflag""",
)
def _(spark, sf):
    calls = table(spark, sf, "lineitem").select(
        "l_returnflag", F.col("l_quantity").cast("long").alias("n_rows"), F.col("l_linenumber").cast("long").alias("hits")
    )
    return rounded(reports.batch_stats(calls, "l_returnflag"), "mean_batch")


def linear_model():
    """Load function of a fixed linear model over the 64 features; a closure, so tasks need not import this module."""

    def load():
        i, k = np.meshgrid(np.arange(64), np.arange(3), indexing="ij")
        weights = (((7 * i + 13 * k) % 11) - 5) / 4.0

        def predict(x: np.ndarray) -> np.ndarray:
            z = x.astype(np.float64) @ weights
            e = np.exp(z - z.max(axis=1, keepdims=True))
            return e / e.sum(axis=1, keepdims=True)

        return predict

    return load


SCORED = """with f as (select vec_id, label, unnest(embedding)::double as v, generate_subscripts(embedding, 1) - 1 as i from embeddings),
  z as (select vec_id, k, sum(v * (((7 * i + 13 * k) % 11) - 5) / 4.0::double) as z from f, unnest(range(3)) as q(k) group by vec_id, k),
  p as (select vec_id, k, exp(z) / sum(exp(z)) over (partition by vec_id) as p from z)
"""


@query("batch_score", SCORED + "select vec_id, cast(k as integer) as k, round(p, 6) as p from p")
def _(spark, sf):
    scored = scoring.batch_score(table(spark, sf, "embeddings"), linear_model(), "embedding")
    return scored.select("vec_id", F.posexplode("probs").alias("k", "p")).withColumn("p", r6("p"))


@query(
    "score_distinct",
    SCORED
    + """select l_orderkey, l_linenumber, l_partkey, l_suppkey, round(p, 6) as p_win from lineitem join p on vec_id = l_partkey where k = 0""",
)
def _(spark, sf):
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("l_partkey"), "embedding")
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").join(vectors, "l_partkey")
    scored = scoring.score_distinct(lines, "l_partkey", linear_model(), "embedding")
    return scored.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", r6(F.col("probs")[0]).alias("p_win"))


@query(
    "compare_runs",
    PRED
    + f""", m as (select wdl, source = 'game' as first, avg(p_true_cls) as p, {ONE.format('best = wdl')} as a from pred group by 1, 2),
      long as (select concat('p_true.', cast(wdl as varchar)) as metric, first, p as value from m union all select concat('acc.', cast(wdl as varchar)), first, a from m),
      a as (select metric, value from long where first union all select 'acc', {ONE.format('best = wdl')} from pred where source = 'game'),
      b as (select metric, value from long where not first)
      select a.metric, round(a.value, 6) as value_a, round(b.value, 6) as value_b, round(b.value - a.value, 6) + 0.0 as delta from a left join b on a.metric = b.metric""",
    ("predictions",),
)
def _(spark, sf):
    """Two runs over all rows; the first has a metric that the second lacks."""
    rows = roles.predictions(spark, sf).withColumn("first", F.col("source") == "game")
    groups = reports.group_report(rows, ["first", "wdl"], "probs", "wdl")
    long = groups.unpivot(["first", "wdl"], ["p_true", "acc"], "m", "value")
    named = long.select("first", F.concat_ws(".", "m", F.col("wdl").cast("string")).alias("metric"), "value")
    whole = reports.value_ce(rows, "first", "probs", "wdl").where("first").select(F.lit("acc").alias("metric"), F.col("acc").alias("value"))
    one, two = (named.where(c).select("metric", "value") for c in ("first", "not first"))
    return rounded(joins.compare_runs(one.unionByName(whole), two), "value_a", "value_b", "delta")


@query(
    "audit",
    EXPECT
    + f""", g as (select *, case when p_win >= p_draw and p_win >= p_loss then 0 when p_draw >= p_loss then 1 else 2 end as best, case wdl when 0 then p_win when 1 then p_draw else p_loss end as pt from e),
      b as (select least(floor(p_win * 10), 9) as bin, count(*) as n, avg(p_win) as m, {ONE.format('wdl = 0')} as a from g group by 1)
      select metric, round(value, 6) + 0.0 as value from (
        select concat(source, '.p_true') as metric, avg(pt) as value from g group by source
        union all select concat(source, '.acc'), {ONE.format('best = wdl')} from g group by source
        union all select 'value_ce', avg(-ln(pt)) from g union all select 'acc', {ONE.format('best = wdl')} from g
        union all select 'ece', sum(n * abs(m - a)) / sum(n) from b
        union all select concat('mae.', phase), avg(abs(net - ref)) from g group by phase
        union all select 'mae.all', avg(abs(net - ref)) from g union all select 'corr', case when stddev_pop(net) * stddev_pop(ref) > 0 then corr(net, ref) end from g) x""",
    ("predictions", "annotations"),
)
def _(spark, sf):
    # Four reports read it: joined once and stored, it is not shuffled again for each.
    scored = stage(expectations(spark, sf).select("source", "probs", "wdl", "ref", "pieces"), "audited")
    return rounded(audit(scored, "source", "probs", "wdl", "ref", "pieces"), "value")


def measured(events):
    """(user_id, event_id, value); the errors' values are no numbers, which beat nothing and are not beaten."""
    return events.select("user_id", "event_id", F.when(F.col("event_type") == "error", float("nan")).otherwise(F.col("value")).alias("value"))


@query(
    "best_so_far",
    """select user_id, event_id, value from (select *, min(value) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding) as best from events
         where event_type <> 'error') x
       where best is null or value < best""",
)
def _(spark, sf):
    events = measured(table(spark, sf, "events"))
    return monitor.best_so_far(events, "user_id", "event_id", "value", eps=0)


@query(
    "best_so_far_eps",
    """with recursive o as (select user_id, event_id, value, row_number() over (partition by user_id order by event_id) as i from events where event_type <> 'error'),
       fold as (select user_id, event_id, value, i, value as best, true as hit from o where i = 1
         union all select o.user_id, o.event_id, o.value, o.i, case when o.value < best - 2 then o.value else best end, o.value < best - 2
         from fold join o on o.user_id = fold.user_id and o.i = fold.i + 1)
       select user_id, event_id, value from fold where hit""",
)
def _(spark, sf):
    events = measured(table(spark, sf, "events"))
    return monitor.best_so_far(events, "user_id", "event_id", "value", eps=2.0)
