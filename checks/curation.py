"""Pools to chunks: counts, plans, routing, annotation joins, samples, splits, set operations."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks import roles
from checks.base import query, rounded, table

from curate.operators import joins, reports, sampling, sketches
from curate.operators.asof import asof_join
from curate.operators.ranking import dedupe_first, ordered_rank
from curate.plans.training_set import plan_and_route
from curate.sources import tables
from curate.sources.pools import write_pool
from curate.storage import stage, stage_path

# Unequal on purpose, so that the scarcest stratum is not the same for every scale.
QUOTAS = {
    ("game", 0): 400,
    ("game", 1): 300,
    ("game", 2): 350,
    ("puzzle", 0): 100,
    ("puzzle", 1): 0,
    ("puzzle", 2): 120,
    ("tablebase", 0): 50,
    ("tablebase", 1): 60,
    ("tablebase", 2): 70,
}
CHUNK = sum(QUOTAS.values())
SEED = 7
SOURCE_IDS = {"game": 0, "puzzle": 1, "tablebase": 2}

PLAN = f"""with quota(source, wdl, quota) as (values {", ".join(f"('{s}', {c}, {q})" for (s, c), q in QUOTAS.items())}),
  counts as (select source, wdl, count(*) as n_rows from plies group by source, wdl),
  plan as (select q.source, q.wdl, quota, n_rows, min(case when quota > 0 then n_rows // quota end) over () as n_chunks
    from quota q join counts c on c.source = q.source and c.wdl = q.wdl)
"""
ROUTED = (
    PLAN
    + f""", ranked as (select p.rid, p.source, p.wdl, p.l_partkey, p.result, quota, n_chunks,
      row_number() over (partition by p.source, p.wdl order by md5(concat('{SEED}:', rid)), rid) as rk
    from plies p join plan q on q.source = p.source and q.wdl = p.wdl where quota > 0),
  routed as (select rid, source, wdl, l_partkey, cast((rk - 1) // quota as integer) as chunk_id from ranked where rk <= n_chunks * quota)
"""
)


def pools(spark, sf):
    """The pools as the stored table they are: counted once and read again for the draw."""
    return stage(roles.plies(spark, sf).select("rid", "source", "wdl", "l_partkey"), "pools")


def routed(spark, sf):
    return plan_and_route(pools(spark, sf), "rid", QUOTAS, CHUNK, seed=SEED).rows


@query(
    "stratum_counts",
    """select source, wdl, grouping_id(source, wdl) as level, count(*) as n_rows from (select nullif(source, 'puzzle') as source, case when l_linenumber <> 7 then wdl end as wdl from plies) p
       group by rollup (source, wdl)""",
    ("plies",),
)
def _(spark, sf):
    # Unknown sources and classes are counted as such, beside the totals.
    rows = roles.plies(spark, sf).withColumns({"source": F.expr("nullif(source, 'puzzle')"), "wdl": F.expr("case when l_linenumber <> 7 then wdl end")})
    return sampling.stratum_counts(rows)


@query(
    "plan_chunks",
    PLAN + "select source, wdl, cast(quota as integer) as quota, n_rows, n_chunks, quota * n_chunks as keep from plan",
    ("plies",),
)
def _(spark, sf):
    return sampling.plan_chunks(sampling.stratum_counts(roles.plies(spark, sf)), QUOTAS, chunk_size=CHUNK)


@query("route", ROUTED + "select rid, source, wdl, chunk_id from routed", ("plies",))
def _(spark, sf):
    return routed(spark, sf).drop("l_partkey")


@query(
    "route_stream",
    ROUTED
    + """select rid, source, wdl, cast((row_number() over (partition by source, wdl order by l_partkey, rid) - 1) // quota as integer) as chunk_id
       from (select r.*, q.quota from routed r join plan q on q.source = r.source and q.wdl = r.wdl) x""",
    ("plies",),
)
def _(spark, sf):
    stored = pools(spark, sf)
    plan = sampling.plan_chunks(sampling.stratum_counts(stored), QUOTAS, chunk_size=CHUNK)
    return sampling.route(stored, plan, "rid", SEED, assign="stream", order=["l_partkey", "rid"]).drop("l_partkey")


@query(
    "composition",
    ROUTED
    + """select chunk_id, source, wdl, grouping_id(chunk_id, source, wdl) as level, count(*) as n_rows from (select chunk_id, nullif(source, 'puzzle') as source, wdl from routed) r
       group by cube (chunk_id, source, wdl)""",
    ("plies",),
)
def _(spark, sf):
    return reports.composition(routed(spark, sf).withColumn("source", F.expr("nullif(source, 'puzzle')")))


@query(
    "shortcut_audit",
    """select source, wdl, n_rows, round(share, 6) as share, round(max(share) over (partition by source), 6) as max_share, max(share) over (partition by source) = 1 as give_away
       from (select source, wdl, count(*) as n_rows, count(*) / sum(count(*)) over (partition by source) as share
             from (select source, case when source = 'puzzle' then 0 else wdl end as wdl from plies) p group by source, wdl) x""",
    ("plies",),
)
def _(spark, sf):
    rows = roles.plies(spark, sf).withColumn("wdl", F.expr("case when source = 'puzzle' then 0 else wdl end"))
    return rounded(sampling.shortcut_audit(rows), "share", "max_share")


@query(
    "shuffle_in",
    ROUTED
    + f"""select rid, chunk_id, row_number() over (partition by chunk_id order by md5(concat(cast({SEED} + chunk_id as varchar), ':', rid))) as place from routed""",
    ("plies",),
)
def _(spark, sf):
    rows = sampling.shuffle_in(routed(spark, sf), "chunk_id", "rid", SEED)
    # The place in the file order; the shuffled frame itself is already sorted that way.


    keyed = sampling.with_shuffle_key(rows, "chunk_id", "rid", SEED)
    return ordered_rank(keyed, "chunk_id", ["shuffle_key"], "place").select("rid", "chunk_id", "place")


def annotated(spark, sf, times: int = 1):
    """Rows of unknown sources among the others; with ``times`` every key is annotated so often, the later ones with other values."""
    rows = roles.plies(spark, sf).select("rid", F.col("pos").alias("fen"), F.expr("case when l_linenumber <> 5 then source end").alias("source"), "wdl")
    source = F.when(F.col("source") == "game", 0).when(F.col("source") == "puzzle", 1).when(F.col("source") == "tablebase", 2)
    again = roles.annotations(spark, sf).withColumn("at", F.explode(F.sequence(F.lit(1), F.lit(times))))
    return joins.join_annotations(rows.withColumn("source_id", source), again.withColumn("w", F.col("w") + F.col("at") - 1), order=["at"])


JOINED = """with rows as (select *, case when l_linenumber <> 5 then source end as known from plies),
  joined as (select rid, known as source, wdl, case when known is distinct from 'tablebase' then w end as w, case when known is distinct from 'tablebase' then d end as d,
    case when known is distinct from 'tablebase' then l end as l from rows left join annotations on fen = pos)
"""


@query("join_annotations", JOINED + "select rid, w, d, l from joined", ("plies", "annotations"))
def _(spark, sf):
    once = annotated(spark, sf, times=2)
    again = joins.join_annotations(once, roles.annotations(spark, sf))
    return again.select("rid", "w", "d", "l")


@query("join_store", JOINED + "select rid, w, d, l from joined", ("plies", "annotations"))
def _(spark, sf):
    """Against the bucketed table; of a key that was annotated twice the first is saved."""
    name = f"annotations_{uuid.uuid4().hex}"
    twice = roles.annotations(spark, sf).withColumn("at", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("w", F.col("w") + F.col("at") - 1)
    tables.save_store(twice, name, order="at", path=stage_path(spark, "annotations"))
    rows = roles.plies(spark, sf).select("rid", F.col("pos").alias("fen"), F.expr("case when l_linenumber <> 5 then source end").alias("source"))
    source = F.when(F.col("source") == "game", 0).when(F.col("source") == "puzzle", 1).when(F.col("source") == "tablebase", 2)
    return joins.join_store(rows.withColumn("source_id", source), name).select("rid", "w", "d", "l")


@query(
    "worklist_estimate",
    """with k as (select l_partkey from lineitem group by 1), d as (select distinct l_partkey from lineitem where l_shipdate < '1998-01-01')
       select (select count(*) from lineitem) as n_rows, true as near, (select count(*) from k where l_partkey not in (select l_partkey from d)) as n_todo, true as todo_near from (select 1) x""",
)
def _(spark, sf):
    """The counts of a work list that came in three batches, one of them twice, from stored sketches; within 2 % of the exact ones."""
    lines = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("fen"), "l_linenumber", "l_shipdate")
    done = lines.where("l_shipdate < '1998-01-01'")
    wanted, known = stage_path(spark, "wanted"), stage_path(spark, "known")
    for name, cut in (("a", "l_linenumber <= 2"), ("b", "l_linenumber = 3"), ("b", "l_linenumber = 3"), ("c", "l_linenumber > 3")):
        sketches.write_sketch(lines.where(cut), "fen", wanted, name)
    sketches.write_sketch(done, "fen", known, "all")
    got = sketches.worklist_estimate(sketches.read_sketches(spark, wanted), sketches.read_sketches(spark, known))
    exact = joins.worklist_report(lines, done).select(F.col("n_unique").alias("u"), F.col("n_todo").alias("t"))
    near = F.abs(F.col("n_unique") - F.col("u")) <= 0.02 * F.col("u")
    todo = F.abs(F.col("n_todo") - F.col("t")) <= 0.02 * F.col("u")
    both = got.crossJoin(F.broadcast(exact))
    return both.select("n_rows", near.alias("near"), F.col("t").alias("n_todo"), todo.alias("todo_near"))


@query(
    "annotation_report",
    JOINED
    + """select count(w) as hit, count(*) - count(w) as miss, round(100.0::double * count(w) / count(*), 6) as percent from joined where source is distinct from 'tablebase'""",
    ("plies", "annotations"),
)
def _(spark, sf):
    return joins.annotation_report(annotated(spark, sf))


@query(
    "coverage",
    JOINED + "select source, count(*) as n_rows, count(w) as n_soft, round(100.0::double * count(w) / count(*), 6) as percent from joined group by source",
    ("plies", "annotations"),
)
def _(spark, sf):
    return reports.coverage(annotated(spark, sf), "source")


@query(
    "agreement_matrix",
    JOINED
    + """select wdl as outcome, cast(grouping(wdl) as integer) as overall, count(*) as n_rows, count(*) filter (where judged = 0) as judged_win, count(*) filter (where judged = 1) as judged_draw,
         count(*) filter (where judged = 2) as judged_loss, round(avg(case when judged = 1 then 1.0::double else 0.0::double end), 6) as share_drawn,
         round(avg(agrees), 6) as agreement
       from (select *, case when judged = wdl then 1.0::double else 0.0::double end as agrees
         from (select wdl, case when w >= d and w >= l then 0 when d >= l then 1 else 2 end as judged from joined where w is not null) x) y
       group by rollup (wdl)""",
    ("plies", "annotations"),
)
def _(spark, sf):
    return rounded(reports.agreement_matrix(annotated(spark, sf)), "share_drawn", "agreement")


@query(
    "worklist",
    """select key, doc_id from (select md5(text) as key, doc_id, row_number() over (partition by md5(text) order by doc_id) as rn from documents where nullif(source, 'src1') is distinct from 'src3') x
       where rn = 1 and key not in (select md5(text) from documents join labels on labels.doc_id = documents.doc_id)""",
)
def _(spark, sf):
    docs = table(spark, sf, "documents").select(F.md5("text").alias("key"), "doc_id", F.expr("nullif(source, 'src1')").alias("source"))
    done = docs.join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi").select("key")
    return joins.worklist(docs, done, "key", ["doc_id"], "source", ("src3",))


@query(
    "worklist_report",
    """with k as (select md5(text) as key, count(*) as n from documents group by 1), d as (select distinct md5(text) as key from documents join labels on labels.doc_id = documents.doc_id)
       select cast(sum(n) as bigint) as n_rows, count(*) as n_unique, count(*) filter (where d.key is null) as n_todo from k left join d on d.key = k.key""",
)
def _(spark, sf):
    docs = table(spark, sf, "documents").select(F.md5("text").alias("key"), "doc_id")
    done = docs.join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi").select("key")
    return joins.worklist_report(docs, done.union(done), "key")


@query(
    "exclude_ids",
    """select doc_id, source from documents where doc_id not in (select item_id * 20 from benchmark)""",
)
def _(spark, sf):
    ids = table(spark, sf, "benchmark").select((F.col("item_id") * 20).alias("doc_id"))
    return joins.exclude_ids(table(spark, sf, "documents").select("doc_id", "source"), ids, "doc_id")


@query(
    "skipped_ids",
    """select count(*) as rows_skipped, count(distinct l_partkey) as ids_skipped from lineitem where l_partkey in (select item_id * 20 from benchmark)""",
)
def _(spark, sf):
    ids = table(spark, sf, "benchmark").select((F.col("item_id") * 20).alias("l_partkey"))
    return joins.skipped_ids(table(spark, sf, "lineitem").select("l_partkey"), ids, "l_partkey")


@query(
    "asof_step",
    """select o_orderkey, case when f >= 0.9 then 1e-6::double when f >= 0.7 then 1e-5::double else 1e-4::double end as lr
       from (select o_orderkey, o_custkey / (select count(*) from customer)::double as f from orders) x""",
)
def _(spark, sf):
    total = table(spark, sf, "customer").count()
    rows = joins.asof_step(table(spark, sf, "orders"), F.col("o_custkey") / F.lit(float(total)), name="lr")
    return rows.select("o_orderkey", "lr")


@query(
    "join_predictions",
    """select rid, l_partkey, round(p, 6) as p from plies join (select user_id, arg_max(value, event_id) as p from events group by user_id) x on user_id = l_partkey""",
    ("plies",),
)
def _(spark, sf):
    predictions = table(spark, sf, "events").select(F.col("user_id").alias("l_partkey"), "event_id", F.col("value").alias("p"))
    rows = joins.join_predictions(roles.plies(spark, sf).select("rid", "l_partkey"), predictions, "l_partkey", "event_id", "p")
    return rounded(rows, "p")


@query(
    "pending",
    """select distinct p_brand as label, p_brand not in (select p_brand from part where p_size > 49) as todo from part""",
)
def _(spark, sf):
    labels = table(spark, sf, "part").select(F.col("p_brand").alias("label")).distinct()
    done = table(spark, sf, "part").where("p_size > 49").select(F.col("p_brand").alias("label"))
    todo = joins.pending(labels, done).withColumn("todo", F.lit(True))
    every = joins.pending(labels, done, force=True)
    return every.join(todo, "label", "left").select("label", F.coalesce("todo", F.lit(False)).alias("todo"))


@query(
    "check_compat",
    """select a.field, have, want from (select n_name as field, case when n_regionkey > 0 then cast(n_regionkey as varchar) end as want from nation) a
       left join (select n_name as field, case when n_nationkey % 5 > 0 then cast(n_nationkey % 5 as varchar) end as have from nation where n_nationkey < 20) b on a.field = b.field
       where have is distinct from want""",
)
def _(spark, sf):
    nation = table(spark, sf, "nation")
    field = F.col("n_name").alias("field")
    want = nation.select(field, F.when(F.col("n_regionkey") > 0, F.col("n_regionkey").cast("string")).alias("value"))
    have = nation.where("n_nationkey < 20").select(
        field, F.when(F.col("n_nationkey") % 5 > 0, (F.col("n_nationkey") % 5).cast("string")).alias("value")
    )
    return joins.check_compat(have, want)


@query(
    "require_complete",
    """with w as (select distinct md5(text) as key from documents), d as (select distinct md5(text) as key from documents join labels on labels.doc_id = documents.doc_id)
       select count(d.key) as done, count(*) - count(d.key) as missing from w left join d on d.key = w.key""",
)
def _(spark, sf):
    docs = table(spark, sf, "documents").select(F.md5("text").alias("fen"), "doc_id")
    done = docs.join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi").select("fen").distinct()
    work = docs.select("fen").distinct()
    try:
        joins.require_complete(work, done)
    except ValueError:
        # The labels cover a part of the documents, so the guard stops the join; the counts say how much is open.
        return joins.missing_annotations(work, done)
    raise AssertionError("the guard let an incomplete run pass")


@query(
    "dedupe_first",
    """select key, doc_id, source, lang from (select md5(text) as key, doc_id, source, lang, row_number() over (partition by md5(text) order by doc_id) as rn from documents) x where rn = 1""",
)
def _(spark, sf):
    docs = table(spark, sf, "documents").select(F.md5("text").alias("key"), "doc_id", "source", "lang")
    return dedupe_first(docs, "key", ["doc_id"])


CAPS = {0: 3000, 2: 1500}


@query(
    "capped_fill",
    f"""select rid, wdl, priority from (select *, row_number() over (partition by wdl order by case when priority then 0 else 1 end, l_partkey, rid) as rk
         from (select rid, wdl, l_partkey, source = 'puzzle' and l_partkey % 2 = 0 as priority from plies) x where priority or wdl = 0) y
       where rk <= case wdl when 0 then {CAPS[0]} when 2 then {CAPS[2]} end""",
    ("plies",),
)
def _(spark, sf):
    priority = (F.col("source") == "puzzle") & (F.col("l_partkey") % 2 == 0)
    rows = roles.plies(spark, sf).select("rid", "wdl", "l_partkey", priority.alias("priority"))
    return sampling.capped_fill(rows, CAPS, "wdl", "priority", ["l_partkey", "rid"]).select("rid", "wdl", "priority")


@query(
    "sample_per_group",
    """with picked as (select * from (select rid, game_id, wdl, row_number() over (partition by game_id order by md5(concat('7:', rid)), rid) as k from plies) x where k <= 2),
       pool as (select * from (select rid, wdl, row_number() over (partition by wdl order by md5(concat('8:', rid)), rid) as k from picked) x where k <= 2 * 500),
       final as (select * from (select rid, wdl, row_number() over (partition by wdl order by md5(concat('9:', rid)), rid) as k from pool) x where k <= 500)
       select rid, wdl, md5(concat('10:', rid)) as shuffle_key from final""",
    ("plies",),
)
def _(spark, sf):
    rows = roles.plies(spark, sf).select("rid", "game_id", "wdl")
    return sampling.sample_per_group(rows, "game_id", "rid", "wdl", 2, 500).select("rid", "wdl", "shuffle_key")


HEADS = {"game": 1500, "puzzle": 40, "tablebase": 7}


@query(
    "head_per_group",
    f"""select rid, source from (select rid, source, row_number() over (partition by source order by l_partkey, rid) as rk from plies) x
       where rk <= case source when 'game' then {HEADS['game']} when 'puzzle' then {HEADS['puzzle']} else {HEADS['tablebase']} end""",
    ("plies",),
)
def _(spark, sf):
    rows = roles.plies(spark, sf).select("rid", "source", "l_partkey")
    return sampling.head_per_group(rows, "source", HEADS, ["l_partkey", "rid"]).select("rid", "source")


@query(
    "head_of_pool",
    f"""select rid, source from (select rid, source, row_number() over (partition by source order by l_partkey, rid) as rk from plies) x
       where rk <= case source when 'game' then {HEADS['game']} when 'puzzle' then {HEADS['puzzle']} else {HEADS['tablebase']} end""",
    ("plies",),
)
def _(spark, sf):
    rows = roles.plies(spark, sf).select("rid", "source", "l_partkey")
    path = stage_path(spark, "pool")
    write_pool(rows, path, "source", "l_partkey", 40)
    return sampling.head_of_pool(spark, path, "source", HEADS, ["l_partkey", "rid"]).select("rid", "source")


@query(
    "drop_ambiguous",
    """select rid, s as score, s = 0 as exact_draw from (select rid, l_partkey % 5 - 2 as s from plies) x where abs(s) <> 1""",
    ("plies",),
)
def _(spark, sf):
    rows = roles.plies(spark, sf).select("rid", (F.col("l_partkey") % 5 - 2).alias("score"))
    exact = sampling.drop_ambiguous(rows, "score", exact_draw_only=True).select("rid", F.lit(True).alias("exact_draw"))
    kept = sampling.drop_ambiguous(rows, "score").join(exact, "rid", "left")
    return kept.select("rid", "score", F.coalesce("exact_draw", F.lit(False)).alias("exact_draw"))


def sizes(spark, sf):
    return sampling.chunk_sizes(table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("chunk_id")))


@query(
    "split_chunks",
    """select chunk_id, n_rows, case when n_rows < 590 then 'tail' when last <= 2 and n_full > 2 then 'val' else 'train' end as split
       from (select *, row_number() over (partition by n_rows >= 590 order by chunk_id desc) as last, count(*) filter (where n_rows >= 590) over () as n_full
             from (select l_suppkey as chunk_id, count(*) as n_rows from lineitem group by l_suppkey) x) y""",
)
def _(spark, sf):
    return sampling.split_chunks(sizes(spark, sf), full=590)


@query(
    "epoch_order",
    """select chunk_id, position from (select chunk_id, row_number() over (order by md5(concat('45:', cast(chunk_id as varchar)))) - 1 as position
         from (select distinct l_suppkey as chunk_id from lineitem) x) y where position >= 5 and position < 60""",
)
def _(spark, sf):
    return sampling.epoch_order(sizes(spark, sf), epoch=3, limit=60, skip=5)


@query(
    "replay_sample",
    """select row_number() over (order by md5(concat('7:', cast(event_id as varchar))), event_id) - 1 as draw, event_id
       from events where event_id // 1000 > (select max(event_id // 1000) from events) - 4 order by 1 limit 800""",
)
def _(spark, sf):
    events = table(spark, sf, "events").select("event_id", F.floor(F.col("event_id") / 1000).alias("iteration"))
    return sampling.replay_sample(events, "iteration", "event_id", k=800).select(F.col("draw").cast("long"), "event_id")


@query(
    "replay_with_replacement",
    """with w as (select event_id, row_number() over (order by md5(concat('7:', cast(event_id as varchar))), event_id) - 1 as r
         from events where event_id // 1000 > (select max(event_id // 1000) from events) - 4),
       n as (select count(*) as n from w),
       draws as (select draw, cast(concat('0x', substr(md5(concat('8:', cast(draw as varchar))), 1, 8)) as bigint) % n as r from n, unnest(range(8000)) as u(draw))
       select cast(draw as integer) as draw, event_id from draws join w on w.r = draws.r""",
)
def _(spark, sf):
    events = table(spark, sf, "events").select("event_id", F.floor(F.col("event_id") / 1000).alias("iteration"))
    return sampling.replay_sample(events, "iteration", "event_id").select("draw", "event_id")


@query(
    "unique_sequences",
    """select conv_id, turn from (select conv_id, turn, row_number() over (partition by text order by conv_id, turn) as rn from conversations) x where rn = 1""",
)
def _(spark, sf):
    letters = F.split("text", "")
    rows = table(spark, sf, "conversations").select("conv_id", "turn", letters.alias("moves"))
    return sampling.unique_sequences(rows, "moves", ["conv_id", "turn"]).select("conv_id", "turn")


@query(
    "mirror_half",
    """select doc_id, flip as mirrored, case when flip then concat_ws(' ',
           translate(array_to_string(list_reverse(string_split(placement, '/')), '/'), 'PNBRQKpnbrqk', 'pnbrqkPNBRQK'),
           case when turn = 'w' then 'b' else 'w' end,
           case castling when 'Kq' then 'Qk' when 'Qk' then 'Kq' when 'KQ' then 'kq' else castling end,
           translate(ep, '36', '63'), cast(clock as varchar), cast(1 + doc_id % 80 as varchar)) else fen end as fen
       from (select *, cast(concat('0x', substr(md5(concat('7:', cast(doc_id as varchar))), 1, 8)) as bigint) % 2 = 1 as flip from positions) x""",
    ("positions",),
)
def _(spark, sf):
    return sampling.mirror_half(roles.positions(spark, sf), "doc_id")


@query(
    "jitter",
    """select rid, wdl, case when wdl = 1 then cast(cast(concat('0x', substr(md5(concat('7:', rid)), 1, 8)) as bigint) % 31 as integer) else 0 end as clock from plies""",
    ("plies",),
)
def _(spark, sf):
    rows = roles.plies(spark, sf).select("rid", "wdl", F.lit(0).alias("clock"))
    return sampling.jitter(rows, "clock", 0, sampling.CLOCK_JITTER, "rid", where=F.col("wdl") == 1)


@query(
    "union_pools",
    """select source, wdl, count(*) as n_rows, count(distinct rid) as n_ids from plies group by source, wdl""",
    ("plies",),
)
def _(spark, sf):
    rows = roles.plies(spark, sf)
    parts = {s: rows.where(F.col("source") == s).select("rid", "wdl") for s in SOURCE_IDS}
    return sampling.union_pools(parts).groupBy("source", "wdl").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("rid").alias("n_ids")
    )


@query(
    "wanted_minus_done",
    """select distinct l_partkey, l_suppkey from lineitem where l_returnflag = 'N' except select l_partkey, l_suppkey from lineitem where l_returnflag = 'R'""",
)
def _(spark, sf):
    lines = table(spark, sf, "lineitem")
    return sampling.wanted_minus_done(
        lines.where("l_returnflag = 'N'"), lines.where("l_returnflag = 'R'"), ["l_partkey", "l_suppkey"]
    )


@query("distinct_keys", "select distinct l_partkey, l_linenumber from lineitem")
def _(spark, sf):
    return sampling.distinct_keys(table(spark, sf, "lineitem"), ["l_partkey", "l_linenumber"])


ASOF = """with e as (select event_id, case when event_type = 'error' then 0 when event_type <> 'view' then user_id end as k, epoch_us(ts) as us from events),
  o as (select k, us, max(o_orderkey) as o_orderkey, arg_max(o_totalprice, o_orderkey) as o_totalprice
    from (select case when o_custkey % 3 = 0 then 0 else o_custkey % 150 end as k, 1000000 * (1704067200 + (epoch_us(o_orderdate) // 1000000 - 788918400) // 80) as us, o_orderkey, o_totalprice from orders) x
    group by k, us)
"""


def asof_sides(spark, sf):
    """Events and orders on one month's time; a third of both belongs to one key, and some events have none."""
    kind = F.col("event_type")
    key = F.when(kind == "error", 0).when(kind != "view", F.col("user_id"))
    events = table(spark, sf, "events").select("event_id", key.alias("k"), "ts")
    seconds = F.floor((F.unix_seconds(F.col("o_orderdate").cast("timestamp")) - 788918400) / 80) + 1704067200
    k = F.when(F.col("o_custkey") % 3 == 0, 0).otherwise(F.col("o_custkey") % 150)
    orders = table(spark, sf, "orders").select(k.alias("k"), F.timestamp_seconds(seconds).alias("at"), "o_orderkey", "o_totalprice")
    return events.withColumn("ts", F.col("ts").cast("timestamp")), orders


@query("asof_join", ASOF + "select event_id, o_orderkey, o_totalprice from e asof left join o on e.k = o.k and e.us >= o.us")
def _(spark, sf):
    events, orders = asof_sides(spark, sf)
    out = asof_join(events, orders, "k", "ts", "at", ["o_orderkey", "o_totalprice"])
    return out.select("event_id", "o_orderkey", "o_totalprice")


@query(
    "asof_join_forward",
    ASOF
    + """, f as (select event_id, n.o_orderkey, n.us - e.us as d from e asof left join (select k, us, min(key) as o_orderkey from
           (select case when o_custkey % 3 = 0 then 0 else o_custkey % 150 end as k, 1000000 * (1704067200 + (epoch_us(o_orderdate) // 1000000 - 788918400) // 80) as us, o_orderkey as key from orders) x
           group by k, us) n on e.k = n.k and e.us < n.us)
       select event_id, case when d <= 7200000000 then o_orderkey end as o_orderkey from f""",
)
def _(spark, sf):
    """The next order after the event, within two hours."""
    events, orders = asof_sides(spark, sf)
    out = asof_join(events, orders, "k", "ts", "at", "o_orderkey", forward=True, strict=True, tolerance=7_200_000_000)
    return out.select("event_id", "o_orderkey")
