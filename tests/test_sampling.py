import pytest
from pyspark.sql import functions as F

from curate.operators import sampling as s
from curate.operators.reports import composition
from curate.plans.training_set import plan_and_route
from tests.conftest import rows

QUOTAS = {("game", 0): 4, ("game", 1): 3, ("game", 2): 2, ("puzzle", 0): 1, ("puzzle", 1): 0, ("puzzle", 2): 2}


@pytest.fixture(scope="module")
def pools(spark):
    source = F.when(F.col("id") % 3 == 0, "puzzle").otherwise("game")
    return spark.range(600).select(F.col("id").alias("rid"), source.alias("source"), (F.col("id") % 7 % 3).cast("int").alias("wdl")).cache()


def test_reference_quotas_fill_a_chunk():
    assert sum(s.QUOTAS.values()) == s.CHUNK_SIZE
    assert s.QUOTAS["game", 1] == 15_834 and s.QUOTAS["tablebase", 2] == 834


def test_route_gives_every_chunk_exactly_its_quota(pools):
    out = plan_and_route(pools, "rid", QUOTAS, 12)
    n = out.plan.first().n_chunks
    counts = {(r.source, r.wdl): r["count"] for r in pools.groupBy("source", "wdl").count().collect()}
    assert n == min(counts[k] // q for k, q in QUOTAS.items() if q)
    per_chunk = out.rows.groupBy("chunk_id", "source", "wdl").count().collect()
    assert len(per_chunk) == n * 5
    assert all(QUOTAS[r.source, r.wdl] == r["count"] for r in per_chunk)
    assert out.rows.select("rid").distinct().count() == out.rows.count() == 12 * n


def test_composition_totals(pools):
    out = plan_and_route(pools, "rid", QUOTAS, 12, max_chunks=3)
    totals = {(r.chunk_id, r.source, r.wdl): r.n_rows for r in composition(out.rows).collect()}
    assert totals[None, None, None] == 36 and totals[1, None, None] == 12 and totals[1, "game", None] == 9


def test_stream_assignment_draws_the_same_rows(pools):
    plan = s.plan_chunks(s.stratum_counts(pools), QUOTAS)
    a = s.route(pools, plan, "rid")
    b = s.route(pools, plan, "rid", assign="stream", order=["rid"])
    assert rows(a, "rid") == rows(b, "rid")
    spans = b.groupBy("source", "wdl", "chunk_id").agg(F.min("rid").alias("lo"), F.max("rid").alias("hi")).orderBy("source", "wdl", "chunk_id").collect()
    for x, y in zip(spans, spans[1:]):
        assert (x.source, x.wdl) != (y.source, y.wdl) or x.hi < y.lo


def test_route_depends_on_the_seed_only(spark, pools):
    plan = s.plan_chunks(s.stratum_counts(pools), QUOTAS)
    a = rows(s.route(pools, plan, "rid", 1), "rid", "chunk_id")
    assert a == rows(s.route(pools.repartition(13), plan, "rid", 1, digits=1), "rid", "chunk_id")
    assert a != rows(s.route(pools, plan, "rid", 2), "rid", "chunk_id")


def test_plan_errors(pools):
    counts = s.stratum_counts(pools)
    with pytest.raises(ValueError, match="sum to 12"):
        s.plan_chunks(counts, QUOTAS, chunk_size=13)
    with pytest.raises(ValueError, match="negative"):
        s.plan_chunks(counts, {("game", 0): -1})
    with pytest.raises(Exception, match="one chunk"):
        s.plan_chunks(counts, {("tablebase", 0): 1}).collect()


def test_stratum_counts_have_totals(pools):
    got = {(r.source, r.wdl): r.n_rows for r in s.stratum_counts(pools).collect()}
    assert got[None, None] == 600 and got["puzzle", None] == 200


def test_an_unknown_stratum_is_no_total(spark):
    df = spark.createDataFrame([("game", None), ("game", 1), (None, 1)], "source string, wdl int")
    got = {(r.source, r.wdl, r.level): r.n_rows for r in s.stratum_counts(df).collect()}
    assert got == {("game", None, 0): 1, ("game", 1, 0): 1, (None, 1, 0): 1, ("game", None, 1): 2, (None, None, 1): 1, (None, None, 3): 3}


def test_capped_fill_second_pass_is_wins_only(spark):
    df = spark.createDataFrame(
        [(0, 0, True), (1, 2, True), (2, 0, False), (3, 2, False), (4, 0, True), (5, 0, False), (6, 2, True)], "i int, wdl int, p boolean"
    )
    got = s.capped_fill(df, {0: 3, 2: 5}, "wdl", "p", ["i"])
    assert rows(got, "i") == [(0,), (1,), (2,), (4,), (6,)]


def test_sample_per_group_limits(spark):
    df = spark.range(3000).select(F.col("id").alias("rid"), (F.col("id") % 50).alias("g"), (F.col("id") % 3).cast("int").alias("wdl"))
    got = s.sample_per_group(df, "g", "rid", "wdl", 4, 20)
    assert rows(got.groupBy("wdl").count()) == [(0, 20), (1, 20), (2, 20)]
    assert got.groupBy("g").count().agg(F.max("count")).first()[0] <= 4


def test_head_per_group(spark):
    df = spark.range(200).select("id", F.concat(F.lit("g"), (F.col("id") % 3).cast("string")).alias("g"))
    assert [r[0] for r in rows(s.head_per_group(df, "g", {"g0": 5, "g2": 2}, ["id"]), "id")] == [0, 2, 3, 5, 6, 9, 12]


@pytest.mark.parametrize("n,full,val", [(5, 3, 2), (2, 2, 0)])
def test_split_chunks(spark, n, full, val):
    sizes = spark.range(n).select(F.col("id").alias("chunk_id"), F.when(F.col("id") < full, 50).otherwise(7).alias("n_rows"))
    got = {r.chunk_id: r.split for r in s.split_chunks(sizes, 50, 2).collect()}
    assert sum(v == "val" for v in got.values()) == val
    assert all(got[i] == "tail" for i in range(full, n))
    assert val == 0 or (got[full - 1] == "val" and got[0] == "train")


def test_epoch_order_is_a_permutation_per_epoch(spark):
    chunks = spark.range(30).withColumnRenamed("id", "chunk_id")
    one = s.epoch_order(chunks, 0).orderBy("position").collect()
    two = s.epoch_order(chunks, 1).orderBy("position").collect()
    assert sorted(r.chunk_id for r in one) == list(range(30)) and [r.position for r in one] == list(range(30))
    assert [r.chunk_id for r in one] != [r.chunk_id for r in two]
    resumed = s.epoch_order(chunks, 0, limit=10, skip=4).orderBy("position").collect()
    assert [r.chunk_id for r in resumed] == [r.chunk_id for r in one[4:10]]


def test_replay_sample(spark):
    df = spark.range(100).select(F.col("id").alias("rid"), F.floor(F.col("id") / 10).alias("it"))
    short = s.replay_sample(df, "it", "rid", k=60)
    assert short.count() == 60 and short.agg(F.min("it")).first()[0] == 6
    assert short.select("rid").distinct().count() <= 40 and short.select("draw").distinct().count() == 60
    plenty = s.replay_sample(df, "it", "rid", k=25)
    assert plenty.select("rid").distinct().count() == 25
    assert s.replay_sample(df.limit(0), "it", "rid").count() == 0


def test_unique_sequences(spark):
    df = spark.createDataFrame([(1, ["a", "b"]), (2, ["a", "b"]), (3, ["b"])], "i int, moves array<string>")
    assert rows(s.unique_sequences(df, "moves", ["i"], 2), "i") == [(1,), (3,)]
    with pytest.raises(ValueError, match="only 2 unique"):
        s.unique_sequences(df, "moves", ["i"], 3)


def test_mirror_half_and_jitter(spark):
    fen = "4k3/8/8/8/8/8/4P3/4K2R w K - 0 1"
    df = spark.range(1000).withColumn("fen", F.lit(fen)).withColumn("clock", F.lit(0))
    got = {r.mirrored: r for r in s.mirror_half(df, "id").groupBy("mirrored").agg(F.first("fen").alias("fen"), F.count(F.lit(1)).alias("n")).collect()}
    assert got[False].fen == fen and got[True].fen == "4k2r/4p3/8/8/8/8/8/4K3 b k - 0 1"
    assert 400 < got[True].n < 600
    j = s.jitter(df, "clock", 0, 30, "id", where=F.col("id") < 900)
    assert j.where("id >= 900").agg(F.max("clock")).first()[0] == 0
    assert {r[0] for r in j.where("id < 900").select("clock").collect()} == set(range(31))


def test_drop_ambiguous_and_shortcut_audit(spark):
    df = spark.createDataFrame([(v,) for v in (-2, -1, 0, 1, 2)], "s int")
    assert rows(s.drop_ambiguous(df, "s")) == [(-2,), (0,), (2,)] and rows(s.drop_ambiguous(df, "s", True)) == [(0,)]
    pools = spark.createDataFrame([("puzzle", 0), ("puzzle", 0), ("game", 0), ("game", 1)], "source string, wdl int")
    assert {r.source: r.give_away for r in s.shortcut_audit(pools).collect()} == {"puzzle": True, "game": False}


def test_set_operations(spark):
    a = spark.createDataFrame([(1,), (1,), (2,), (3,)], "k int")
    b = spark.createDataFrame([(2,)], "k int")
    assert rows(s.wanted_minus_done(a, b, "k")) == [(1,), (3,)] and s.distinct_keys(a, "k").count() == 3
    assert rows(s.union_pools({"game": a, "puzzle": b}).groupBy("source").count()) == [("game", 4), ("puzzle", 1)]


ODD = "case when id % 5 < 2 then 7 when id % 11 = 0 then null else pmod(xxhash64(id), 1000) end"


def first_by_window(df, by, order, keep, then=None):
    from pyspark.sql.window import Window

    w = Window.partitionBy(*by).orderBy(*([then] if then else []), *order)
    return df.join(keep, by).withColumn("rk", F.row_number().over(w)).where("rk <= keep").drop("rk", "keep")


@pytest.mark.parametrize("levels, orders", [(2, (["s", "id"], ["n", "id"])), (3, ())])
def test_select_first_equals_a_window(spark, levels, orders):
    """A tie on the first column holds a large share, some values are NULL, quotas are none, few, most, all and more."""
    df = spark.range(30_000).selectExpr("id", "id % 6 as g", f"{ODD} as v", "concat('r', lpad(cast(pmod(xxhash64(id, 1), 100000) as string), 6, '0')) as s", "id % 3 = 0 as p")
    df = df.withColumn("n", F.expr("cast(v as decimal(20,3)) / 7")).repartition(5)
    keep = spark.createDataFrame([(0, 0), (1, 3), (2, 2_100), (3, 4_990), (4, 5_000), (5, 9_999)], "g long, keep long")
    for order in orders:
        got = s.select_first(df, "g", order, keep, levels=levels)
        assert got.columns == df.columns
        assert rows(got, "id") == rows(first_by_window(df, ["g"], order, keep), "id")
    got = s.select_first(df.withColumn("second", ~F.col("p")), "g", ["v", "s", "id"], keep, then="second", levels=levels)
    assert rows(got, "id") == rows(first_by_window(df.withColumn("second", ~F.col("p")), ["g"], ["v", "s", "id"], keep, "second"), "id")


def test_select_first_sorts_few_rows_and_writes_nothing(spark, monkeypatch):
    from curate.operators import ranking

    monkeypatch.setattr(ranking, "stage", lambda *a: pytest.fail("a table is written"))
    df = spark.range(200_000).selectExpr("id % 2 as g", "pmod(xxhash64(id), 1000000) as v", "id")
    keep = spark.createDataFrame([(0, 30_000), (1, 70_000)], "g long, keep long")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("planning", "planning")
    got = s.select_first(df, "g", ["v", "id"], keep)
    got.explain()
    assert not tracker.getJobIdsForGroup("planning")
    spark.sparkContext.setJobGroup("", "")
    assert got.groupBy("g").count().orderBy("g").collect() == [(0, 30_000), (1, 70_000)]


def test_select_first_of_nothing(spark):
    df = spark.createDataFrame([], "g long, v long")
    assert s.select_first(df, "g", ["v"], spark.createDataFrame([(1, 2)], "g long, keep long")).count() == 0
    some = spark.range(9).selectExpr("id g", "id v")
    assert s.select_first(some, "g", ["v"], spark.createDataFrame([], "g long, keep long")).count() == 0
