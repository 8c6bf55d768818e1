"""The views of ``checks.base`` as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.base import table
from curate.functions.labels import wdl_class
from curate.operators.joins import score_choice
from curate.sources.suites import suite_moves

HOUR = 3600


def games(spark: SparkSession, sf: str) -> DataFrame:
    status = F.col("o_orderstatus")
    result = F.when(status == "F", "1-0").when(status == "O", "0-1").when(status == "P", "1/2-1/2")
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("game_id"),
        F.col("o_custkey").alias("player"),
        F.col("o_orderpriority").alias("event"),
        F.col("o_totalprice").alias("price"),
        result.alias("result"),
    )


def row_id():
    return F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")])


def plies(spark: SparkSession, sf: str) -> DataFrame:
    flag = F.col("l_returnflag")
    lines = table(spark, sf, "lineitem").select(
        row_id().alias("rid"),
        F.col("l_orderkey").alias("game_id"),
        *["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"],
        F.when(F.col("l_linenumber") % 2 == 1, "w").otherwise("b").alias("turn"),
        # What the annotations are joined by: some rows have a position that is not annotated, some have none.
        F.when(F.col("l_linenumber") == 7, -F.col("l_partkey")).when(F.col("l_linenumber") < 6, F.col("l_partkey")).alias("pos"),
        F.when(flag == "N", "game").when(flag == "A", "puzzle").otherwise("tablebase").alias("source"),
    )
    # A game is two short columns, its lines are many: the games of a task fit a hash table, and the lines need no sort.
    outcome = games(spark, sf).select("game_id", "result").hint("shuffle_hash")
    return lines.join(outcome, "game_id").withColumn("wdl", wdl_class("result", "turn"))


def annotations(spark: SparkSession, sf: str) -> DataFrame:
    price = F.sum(F.round(F.col("l_extendedprice") * 100).cast("long"))
    a = F.sum(F.round(F.col("l_discount") * 100).cast("long"))
    b = F.sum(F.round(F.col("l_tax") * 100).cast("long"))
    n = F.count(F.lit(1))
    totals = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("fen")).agg(
        price.alias("price"), a.alias("a"), b.alias("b"), n.alias("n")
    )
    return totals.selectExpr(
        "fen",
        "cast((price div (100 * n) - 50000) div 20 as int) as cp",
        "cast(1000 * a div (n + a + b) as int) as w",
        "cast(1000 - 1000 * a div (n + a + b) - 1000 * b div (n + a + b) as int) as d",
        "cast(1000 * b div (n + a + b) as int) as l",
    )


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    a, b, c = 1 + F.col("l_quantity"), 1 + 100 * F.col("l_discount"), 1 + 100 * F.col("l_tax")
    rows = plies(spark, sf).withColumn("probs", F.array(a / (a + b + c), b / (a + b + c), c / (a + b + c)))
    return rows.withColumn("pieces", (2 + F.col("l_partkey") % 31).cast("int"))


def results(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("event_type")
    points = F.when(kind == "purchase", 1.0).when(kind == "view", 0.5).when(kind == "error", 0.0)
    return table(spark, sf, "events").select("user_id", "event_id", "ts", points.alias("points")).where("points is not null")


def positions(spark: SparkSession, sf: str) -> DataFrame:
    doc = F.col("doc_id")
    hexes = F.concat(F.md5(F.concat(F.lit("a"), doc.cast("string"))), F.md5(F.concat(F.lit("b"), doc.cast("string"))))
    b = F.translate(hexes, "0123456789abcdef", "111111PpNnBbRrQq")
    home = doc % 3 == 0
    ranks = [F.substring(b, 8 * i + 1, 8) for i in range(8)]
    ranks[0] = F.when(home, "r3k2r").otherwise(ranks[0])
    ranks[7] = F.when(home, "R3K2R").otherwise(ranks[7])
    rights = F.when(doc % 6 == 0, "KQkq").when(doc % 6 == 1, "Kq").when(doc % 6 == 2, "Qk").when(doc % 6 == 3, "KQkq").when(doc % 6 == 4, "KQ")
    file = F.char(97 + F.floor(doc / 4) % 8)
    ep = F.when(doc % 4 < 2, F.concat(file, F.when(doc % 2 == 0, "6").otherwise("3"))).otherwise("-")
    fen = F.concat_ws(
        " ",
        F.concat_ws("/", *ranks),
        F.when(doc % 2 == 0, "w").otherwise("b"),
        F.coalesce(rights, F.lit("-")),
        ep,
        (F.col("n_chars") % 120).cast("string"),
        (1 + doc % 80).cast("string"),
    )
    return table(spark, sf, "documents").select("doc_id", fen.alias("fen"))


def suite_positions(spark: SparkSession, sf: str) -> DataFrame:
    """(fen, phase, moves) as a suite file holds them, one per part."""
    best, step = 300 - F.col("p_partkey") % 50, 5 + 10 * (F.col("p_partkey") % 7)
    moves = F.transform(
        F.sequence(F.lit(0), F.col("p_size") % 20),
        lambda i: F.array(F.concat(F.lit("m"), i.cast("string")), (best - i * step).cast("string")),
    )
    return table(spark, sf, "part").select(
        F.col("p_partkey").cast("string").alias("fen"), F.col("p_type").alias("phase"), moves.alias("moves")
    )


def suite(spark: SparkSession, sf: str) -> DataFrame:
    rows = suite_moves(suite_positions(spark, sf))
    return rows.select(F.col("fen").cast("long").alias("position"), F.col("uci").alias("move"), "cp", "rank", "best_cp")


def choices(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem")
    sizes = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), (1 + F.col("p_size") % 20).alias("_n"))
    # Short columns of few values: the files are far smaller than the rows, so their size says nothing for a broadcast.
    return lines.join(sizes.hint("merge"), "l_partkey").select(
        row_id().alias("rid"),
        F.concat(F.lit("c"), (F.col("l_suppkey") % 5).cast("string")).alias("cell"),
        F.col("l_linenumber").alias("milestone"),
        F.col("l_partkey").alias("position"),
        F.concat(F.lit("m"), (F.col("l_suppkey") % F.col("_n")).cast("string")).alias("move"),
        (F.col("l_quantity") / 10.0).alias("elapsed"),
        F.col("l_discount").alias("topvis"),
    )


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """Choices on the positions the suite kept, scored."""
    s = suite(spark, sf)
    kept = s.where("rank = 1").select("position")
    return score_choice(choices(spark, sf).join(kept.hint("merge"), "position", "left_semi"), s)


def edges(spark: SparkSession, sf: str) -> DataFrame:
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    move = [F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey"), cents]
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("position"),
        F.concat_ws("-", *[c.cast("string") for c in move]).alias("move"),
        F.col("l_quantity").cast("long").alias("n"),
        F.col("l_discount").alias("p"),
    )
