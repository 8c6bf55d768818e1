import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from curate.operators.asof import asof_join


def plain(left, right, forward, strict, tolerance):
    """One row of ``left`` after the other: (i, v) of the nearest row by the definition."""
    out = []
    for i, k, t in left:
        if k is None or t is None:
            out.append((i, None))
            continue
        near = [(at, v) for key, at, v in right if key == k and at is not None]
        if forward:
            near = [x for x in near if (x[0] > t if strict else x[0] >= t)]
        else:
            near = [x for x in near if (x[0] < t if strict else x[0] <= t)]
        best = (min if forward else max)(near, default=None)
        out.append((i, None if best is None or tolerance is not None and abs(best[0] - t) > tolerance else best[1]))
    return sorted(out)


def sides(spark, seed=0, n=400):
    draw = np.random.default_rng(seed)
    # One key has most rows, crowded into a corner of its range; places repeat.
    key = lambda: draw.choice(["hot", "hot", "hot", "a", "b", "only left", None])
    place = lambda: None if draw.random() < 0.03 else int(draw.integers(0, 50) if draw.random() < 0.8 else draw.integers(0, 1_000_000))
    left = [(i, key(), place()) for i in range(n)]
    right = [("only right" if draw.random() < 0.05 else k if (k := key()) != "only left" else "a", place(), i) for i in range(n)]
    return left, right, spark.createDataFrame(left, "i long, k string, t long"), spark.createDataFrame(right, "k string, at long, v long")


@pytest.mark.parametrize("forward", [False, True])
@pytest.mark.parametrize("strict, tolerance", [(False, None), (True, None), (False, 3)])
def test_equals_a_plain_loop(spark, forward, strict, tolerance):
    left, right, a, b = sides(spark)
    got = asof_join(a, b, "k", "t", "at", "v", forward, strict, tolerance, span=20)
    assert got.columns == ["i", "k", "t", "v"]
    assert sorted((r.i, r.v) for r in got.collect()) == plain(left, right, forward, strict, tolerance)


def test_ties_by_another_column(spark):
    a = spark.createDataFrame([(1, "k", 5)], "i long, k string, t long")
    b = spark.createDataFrame([("k", 5, 1, 30), ("k", 5, 2, 20), ("k", 4, 9, 99)], "k string, at int, seq int, v int")
    assert asof_join(a, b, "k", "t", "at", "v").first().v == 30
    assert asof_join(a, b, "k", "t", "at", "v", tie="seq").first().v == 20
    assert asof_join(a, b, "k", "t", "at", "v", tie="seq", forward=True).first().v == 30


def test_dates_times_and_decimals(spark):
    for kind, x, y, z in (("date", dt.date(1969, 12, 30), dt.date(1970, 1, 1), dt.date(2024, 2, 29)), ("timestamp", *(dt.datetime(2024, 1, 1, 0, 0, 0, i) for i in (1, 2, 3)))):
        a = spark.createDataFrame([(1, z), (2, y)], f"i int, t {kind}")
        b = spark.createDataFrame([(x, "x"), (z, "z")], f"at {kind}, v string")
        assert {r.i: r.v for r in asof_join(a, b, [], "t", "at", "v").collect()} == {1: "z", 2: "x"}
    a = spark.range(3).select("id", (F.col("id") / 10).cast("decimal(8,4)").alias("t"))
    steps = spark.createDataFrame([("0.0", 1e-4), ("0.15", 1e-5)], "at string, v double").withColumn("at", F.col("at").cast("decimal(8,4)"))
    assert {r.id: r.v for r in asof_join(a, steps, [], "t", "at", "v").collect()} == {0: 1e-4, 1: 1e-4, 2: 1e-5}
    with pytest.raises(TypeError, match="double"):
        asof_join(a.withColumn("t", F.col("t").cast("double")), steps.withColumn("at", F.col("at").cast("double")), [], "t", "at", "v")


def test_empty_sides(spark):
    _, _, a, b = sides(spark, n=20)
    assert asof_join(a.limit(0), b, "k", "t", "at", "v").count() == 0
    none = asof_join(a, b.limit(0), "k", "t", "at", "v").collect()
    assert len(none) == 20 and all(r.v is None for r in none)


def test_a_hot_key_is_many_windows(spark):
    """No window of the plan holds a whole key."""
    a = spark.range(50_000).select("id", F.lit("hot").alias("k"), (F.col("id") * 3).alias("t"))
    b = spark.range(50_000).select(F.lit("hot").alias("k"), (F.col("id") * 3 + 1).alias("at"), F.col("id").alias("v"))
    got = asof_join(a, b, "k", "t", "at", "v", span=5_000)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line and "_left" not in line.split("Window [")[0]]
    assert windows and any("_seg" in line for line in windows)
    # A row's match is the row before it in a key of one segment after the other.
    assert got.where("id > 0 and v <> id - 1").count() == 0 and got.where("v is null").count() == 1
