"""Hard negatives against a plain loop: windows, ties, nulls, repeats, hot vectors; curve and bounds by their definition."""

import math
from itertools import product

import numpy as np
from pyspark.sql import functions as F

from curate.llm import negatives

SHAPE = "vec_id long, embedding array<float>, label int"


def plain(rows):
    """(anchor, positive, rank, negative, positive score, negative score) by the definition."""
    width = max((len(v) for _, v, _ in rows if v), default=0)
    kept = []
    for i, v, y in rows:
        if y is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = [math.floor(256 * float(np.float32(x))) for x in v]
        kept.append((i, q + [0] * (width - len(q)), y))
    out = []
    order = lambda t: (-t[0], t[1] is None, t[1] or 0, t[2])
    for a, (i, q, y) in enumerate(kept):
        if i is None or i % 100:
            continue
        scored = [(sum(x * z for x, z in zip(q, r, strict=True)), j, b, l) for b, (j, r, l) in enumerate(kept) if b != a]
        for p, pid, *_ in sorted((s for s in scored if s[3] == y), key=order)[:5]:
            found = sorted((s for s in scored if s[3] != y and 80 * p <= 100 * s[0] <= 100 * p), key=order)[:5]
            out += [(i, pid, k + 1, s[1], p, s[0]) for k, s in enumerate(found)]
    return out


def same(spark, rows, parts=3):
    table = spark.createDataFrame(rows, SHAPE).withColumn("id", F.lit("x")).withColumn("score", F.lit(1)).withColumn("key", F.lit(2))
    got = [tuple(r) for r in negatives.mine(table.repartition(parts)).collect()]
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(got, key=key) == sorted(plain(rows), key=key)
    return got


def cloud(n, d, seed, spread=0.3):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(6, d))
    of = draw.integers(0, 6, n)
    x = centres[of] + spread * draw.normal(size=(n, d))
    return [(i, [float(np.float32(v)) for v in r], int(draw.integers(0, 4))) for i, r in enumerate(x)]


def test_rows_equal_a_plain_loop(spark):
    assert len(same(spark, cloud(900, 8, 0))) > 100


def test_ties_nulls_and_repeats(spark):
    rows = cloud(220, 3, 1)
    rows = [(i, [float(round(x)) for x in v], y) for i, v, y in rows]  # many equal scores
    rows += [(300, None, 1), (400, [1.0, None, 2.0], 1), (None, [1.0, 1.0, 0.0], 2), (500, [float("nan"), 0.0, 1.0], 0), (600, [float("inf"), 0.0, 1.0], 0)]
    rows += [(700, [1.0, 1.0, 1.0], None), (100, rows[100][1], rows[100][2]), (100, [2.0, 0.0, 1.0], 3), (800, [1.0], 2), (900, [], 2)]
    same(spark, rows)


def test_a_hot_vector(spark):
    rows = cloud(150, 4, 2) + [(1000 + i, [0.5, 0.25, 0.5, 0.25], i % 3) for i in range(700)]
    same(spark, rows, 8)


def test_large_components_stay_exact(spark):
    draw = np.random.default_rng(4)
    rows = [(i, [float(np.float32(x)) for x in draw.normal(size=5) * 100_000], int(i % 3)) for i in range(230)]
    same(spark, rows)


def test_empty_tables(spark):
    assert same(spark, []) == []
    assert same(spark, [(1, [1.0], 1), (2, None, 2)]) == []
    assert same(spark, [(0, [], 1), (1, [], 1), (2, [], 2)]) == [(0, 1, 1, 2, 0, 0)]


def test_the_curve_goes_from_neighbour_to_neighbour():
    for d, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.array(list(product(range(1 << bits), repeat=d)))
        keys = negatives.hilbert(cells, bits)
        assert len(set(keys)) == len(cells)
        path = cells[sorted(range(len(keys)), key=keys.__getitem__)]
        assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_bounds_hold_and_are_tight():
    draw = np.random.default_rng(5)
    a, rows = draw.integers(-50, 50, (4, 3)), draw.integers(-50, 50, (40, 3))
    lo, hi = rows.min(0, keepdims=True), rows.max(0, keepdims=True)
    least, most = negatives.bounds(a, lo, hi)
    corners = np.array([[(lo, hi)[c][0, j] for j, c in enumerate(p)] for p in product((0, 1), repeat=3)])
    assert (least[:, 0] == (a @ corners.T).min(1)).all() and (most[:, 0] == (a @ corners.T).max(1)).all()


def test_blocks_out_of_reach_are_not_read(spark, monkeypatch):
    """Far clusters of one dimension each: an anchor needs the blocks of its own cluster only."""
    monkeypatch.setattr(negatives, "BLOCK", 20)
    draw = np.random.default_rng(6)
    rows = []
    for i in range(1200):
        v = np.abs(draw.normal(size=6)) * 0.01
        v[i % 6] += 1
        rows.append((i, [float(np.float32(x)) for x in v], i % 4 // 2))
    table = spark.createDataFrame(rows, SHAPE)
    index = negatives.build(negatives.clean(table))
    places = index.groups.select("group", F.posexplode("rids").alias("a", "rid"))
    windows = places.selectExpr("group", "a", "rid", "0L w", "30000L floor", "90000L ceiling", "cast(null as long) last")
    asked = windows.groupBy("group").agg(F.collect_list(F.struct("a", "w", "floor", "ceiling", "last")).alias("windows"))
    pairs = index.groups.join(asked, "group").crossJoin(index.shelves)
    requests = pairs.mapInArrow(negatives._choose(index.width, False, None), negatives._REQUEST_SHAPE)
    read = requests.select(F.explode("rids")).count()
    everything = index.blocks.count() * places.count()
    assert 0 < read < everything / 3
