"""Queries whose work must grow with their tables: how it is dealt out, on rows made here."""

import os
import time
from types import SimpleNamespace

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from checks import sourcing
from checks.base import QUERIES
from checks import audits  # noqa: F401
from curate.sources import games
from curate.streaming import ingest


@pytest.fixture
def tables(spark, tmp_path):
    """1200 suppliers, and 5000 lines of 1000 orders."""
    i = F.col("id")
    spark.range(1, 1201).select(i.alias("s_suppkey"), F.lit("s").alias("s_name"), (i % 5 - 1).cast("double").alias("s_acctbal")).write.parquet(f"{tmp_path}/supplier.parquet")
    spark.range(5000).select(
        (i % 1000).alias("l_orderkey"), (i % 200).alias("l_partkey"), (i % 7).alias("l_suppkey"), (i % 6 + 1).cast("int").alias("l_linenumber"),
        (i % 50 + 1).cast("double").alias("l_quantity"), (i + 1.0).alias("l_extendedprice"), (i % 11 / 100).alias("l_discount"), (i % 9 / 100).alias("l_tax"),
        F.lit("N").alias("l_returnflag"), F.lit("O").alias("l_linestatus"),
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(1000).select(
        i.alias("o_orderkey"), (i % 50).alias("o_custkey"), F.lit("1-URGENT").alias("o_orderpriority"), i.cast("double").alias("o_totalprice"), F.lit("F").alias("o_orderstatus")
    ).write.parquet(f"{tmp_path}/orders.parquet")
    return str(tmp_path)


def files(path):
    return [f for _, _, names in os.walk(path) for f in names if f.startswith("part-")]


def test_scan_artifacts_many_tasks_write_the_folders(spark, tables, monkeypatch):
    monkeypatch.setattr(sourcing, "stage_path", lambda _, name: f"{tables}/{name}")
    out = QUERIES["scan_artifacts"](spark, tables)
    assert out.where("available and n_files = 2 and name = concat(label, '.weights.h5')").count() == 960
    assert out.where("not available and n_files is null").count() == 240
    assert len({f[:10] for f in files(f"{tables}/weights")}) > 1


def test_read_sweep_writes_packed_documents(spark, tables, monkeypatch):
    monkeypatch.setattr(sourcing, "stage_path", lambda _, name: f"{tables}/{name}")
    out = QUERIES["read_sweep"](spark, tables)
    assert tuple(out.agg(F.count(F.lit(1)), F.count_distinct("fen"), F.sum("sims")).first()) == (10_000, 5000, 5000 * 900)
    names = files(f"{tables}/sweep")
    assert len(names) == 3 and all(f.endswith(".gz") for f in names)


def test_audit_joins_once(spark, tables):
    plan = QUERIES["audit"](spark, tables)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_first_state_takes_rows():
    seen = []
    value = SimpleNamespace(exists=lambda: bool(seen), update=seen.append)
    state = ingest.first_state(["fen", "cp", "at", "line"], ["at", "line"], None)
    state.init(SimpleNamespace(getValueState=lambda *_: value))
    rows = [Row(fen="a", cp=cp, at=at, line=line) for cp, at, line in ((1, 5, 0), (2, 4, 9), (3, 4, 8))]
    assert [tuple(r) for r in state.handleInputRows(("a",), iter(rows), None)] == [("a", 3, 4, 8)]
    assert [*state.handleInputRows(("a",), iter(rows), None)] == [] and seen == [(True,)]


def without_side_lines(text):
    depth, kept = 0, []
    for c in text:
        if c == "(":
            depth += 1
        elif c == ")":
            depth = max(depth - 1, 0)
        elif depth == 0:
            kept.append(c)
    return "".join(kept)


def test_with_moves_brackets_that_do_not_match(spark):
    texts = ["a (b (c) d) e", "a ) b (c) d", "a (b) c (d (e) f", "a ) ( b", "((((a)))) b (c)(d)", "a (b)) c) ((d) e"]
    got = games.with_moves(spark.createDataFrame([(t,) for t in texts], "movetext string")).collect()
    assert [r.moves for r in got] == [without_side_lines(t).split() for t in texts]


def test_with_moves_in_proportion_to_the_text(spark):
    def seconds(n):
        df = spark.createDataFrame([("Nf3 (Nc3 (d4) d5) " * n,)], "movetext string")
        start = time.monotonic()
        assert games.with_moves(df).select(F.size("moves")).first()[0] == n
        return time.monotonic() - start

    seconds(100)
    assert seconds(120_000) < 6


def test_with_moves_deals_out_one_block(spark, tables):
    spark.range(400).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text")).coalesce(1).write.parquet(f"{tables}/documents.parquet")
    out = QUERIES["with_moves"](spark, tables)
    assert out.where("n_moves = 3 and moves = md5('a b c')").count() == 400
    assert out.select(F.spark_partition_id()).distinct().count() > 1
