"""Parameter sweeps: choices scored by a suite, per-cell metrics, paired differences, throughput."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import roles
from checks.base import query, r6, rounded
from curate.operators import joins, sweeps
from curate.storage import stage

ONE = "avg(case when {0} then 1.0::double else 0.0::double end)"


@query(
    "score_choice",
    "select rid, rank, cp_loss_raw, cp_loss, round(esc_loss, 6) + 0.0 as esc_loss from scored",
    ("scored",),
)
def _(spark, sf):
    return roles.scored(spark, sf).select("rid", "rank", "cp_loss_raw", "cp_loss", r6("esc_loss").alias("esc_loss"))


@query(
    "score_choice_audit",
    """select rid, s.move is not null as found, rank from (select rid, position, concat('m', cast(milestone * 3 as varchar)) as move from choices) c
       left join suite s on s.position = c.position and s.move = c.move""",
    ("suite", "choices"),
)
def _(spark, sf):
    moved = roles.choices(spark, sf).select("rid", "position", F.concat(F.lit("m"), (F.col("milestone") * 3).cast("string")).alias("move"))
    return joins.score_choice(moved, roles.suite(spark, sf), strict=False).select("rid", "found", "rank")


METRICS = f"""select cell, milestone, count(*) as n, round(avg(cp_loss), 6) as mean_cp, median(cp_loss) as med_cp, round(100 * avg(esc_loss), 6) as esc_loss,
    round(100 * {ONE.format('cp_loss_raw > 100')}, 6) as blun100, round(100 * {ONE.format('cp_loss_raw > 300')}, 6) as blun300,
    round(100 * {ONE.format('rank = 1')}, 6) as top1, round(100 * {ONE.format('rank <= 3')}, 6) as top3, round(avg(rank), 6) as mean_rank,
    round(100 * avg(topvis), 6) as topvis, round(avg(elapsed), 6) as elapsed from scored group by cell, milestone"""
NUMBERS = ("mean_cp", "esc_loss", "blun100", "blun300", "top1", "top3", "mean_rank", "topvis", "elapsed")


@query("cell_metrics", METRICS, ("scored",))
def _(spark, sf):
    return rounded(sweeps.cell_metrics(roles.scored(spark, sf)), *NUMBERS)


BEST = f"""with m as ({METRICS}), c as (select cell, min(mean_cp) as best_value, arg_min(milestone, (mean_cp, milestone)) as best_milestone, max(milestone) as last_milestone from m group by cell)
"""


@query(
    "best_milestone",
    BEST + "select cell, best_milestone, best_value, last_milestone, best_milestone = last_milestone as last_is_best, cast(row_number() over (order by best_value, cell) as integer) as place from c",
    ("scored",),
)
def _(spark, sf):
    return sweeps.best_milestone(rounded(sweeps.cell_metrics(roles.scored(spark, sf)), *NUMBERS))


@query(
    "best_cell_trend",
    BEST + "select cell, milestone, mean_cp from m where cell = (select cell from c order by best_value, cell limit 1)",
    ("scored",),
)
def _(spark, sf):
    return sweeps.best_cell_trend(rounded(sweeps.cell_metrics(roles.scored(spark, sf)), *NUMBERS))


BASE = "select milestone, position, avg(cp_loss) as base_value from scored where cell = 'c0' group by milestone, position"


def stored(spark, sf):
    """The scored sweep as a table: pairing reads it once for the baseline and once for the other cells."""
    return stage(roles.scored(spark, sf).select("rid", "cell", "milestone", "position", "cp_loss"), "scored")


@query(
    "paired",
    f"""select rid, cell, round(base_value, 6) as base_value, round(cp_loss - base_value, 6) + 0.0 as delta
       from scored join ({BASE}) b using (milestone, position) where cell <> 'c0'""",
    ("scored",),
)
def _(spark, sf):
    out = joins.paired(stored(spark, sf), "c0", on=["milestone", "position"])
    return rounded(out.select("rid", "cell", "base_value", "delta"), "base_value", "delta")


@query(
    "paired_delta",
    f"""select cell, count(*) as npair, round(avg(delta), 6) + 0.0 as mean_delta, count(*) filter (where delta < 0) as better, count(*) filter (where delta > 0) as worse,
      count(*) filter (where delta = 0) as tie
    from (select cell, v - base_value as delta
          from (select cell, milestone, position, avg(cp_loss) as v from scored where cell <> 'c0' group by all) a join ({BASE}) b using (milestone, position)) x
    group by cell""",
    ("scored",),
)
def _(spark, sf):
    out = sweeps.paired_delta(stored(spark, sf), "c0", on=["milestone", "position"])
    return rounded(out, "mean_delta")


@query(
    "throughput",
    f"""select batch, n, round(mean_sims, 6) as mean_sims, round(sims_per_s, 6) as sims_per_s, round(mean_cp, 6) as mean_cp, med_cp, top1, top3, top10, round(mean_rank, 6) as mean_rank,
         round(topvis, 6) as topvis, round(sims_per_s / first_value(sims_per_s) over (order by batch rows between unbounded preceding and unbounded following), 6) as speed_up
       from (select milestone as batch, count(*) as n, avg(sims) as mean_sims, sum(sims) / sum(elapsed) as sims_per_s, avg(cp_loss) as mean_cp, median(cp_loss) as med_cp,
           count(*) filter (where rank <= 1) as top1, count(*) filter (where rank <= 3) as top3, count(*) filter (where rank <= 10) as top10, avg(rank) as mean_rank, 100 * avg(topvis) as topvis
         from (select *, 100 * milestone + position % 50 as sims from scored) x group by milestone) y""",
    ("scored",),
)
def _(spark, sf):
    rows = roles.scored(spark, sf).withColumns(
        {"batch": F.col("milestone"), "sims": 100 * F.col("milestone") + F.col("position") % 50, "seconds": F.col("elapsed"), "top_visit_frac": F.col("topvis")}
    )
    return rounded(sweeps.throughput(rows), "mean_sims", "sims_per_s", "mean_cp", "mean_rank", "topvis", "speed_up")


@query(
    "disagreements",
    """select position, cast(count(distinct move) as bigint) as n_moves, string_agg(concat(cell, '=', move, '(r', cast(rank as varchar), ',', cast(cp_loss as varchar), 'cp)'), ' ' order by cell) as choices
       from (select *, row_number() over (partition by position, cell order by n desc, move) as nth
             from (select position, cell, move, count(*) as n, min(rank) as rank, min(cp_loss) as cp_loss from scored group by position, cell, move) c) x
       where nth = 1 group by position having count(distinct move) > 1""",
    ("scored",),
)
def _(spark, sf):
    out = sweeps.disagreements(roles.scored(spark, sf), config="cell")
    shown = F.transform(
        F.map_entries("choices"),
        lambda e: F.concat(
            e["key"], F.lit("="), e["value"]["move"], F.lit("(r"), e["value"]["rank"].cast("string"), F.lit(","), e["value"]["cp_loss"].cast("string"), F.lit("cp)")
        ),
    )
    return out.select("position", "n_moves", F.array_join(shown, " ").alias("choices"))
