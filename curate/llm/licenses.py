"""Licence scan by ordered signature rules: several hundred regular expressions behind a keyword gate.

A text is matched against a rule only if it holds the rule's keyword. A detection inside the interval of
another of at least its priority is suppressed, so ``gnu general public license version 3`` is one finding
and not also the plain name. DataFrame functions only; the rules are a small fixed table.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from curate.llm.keys import KEY, keyed, with_facts
from curate.llm.license_rules import GATES, rows

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]"
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
#: Phrases counted as such, by words: fixed values.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Confidence of a phrase.
BASE_SCORE = 0.8
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def fold(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)


def rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(rows(), "rule int, label string, priority int, confidence double, keyword string, pattern string")


def _gaps(text: Column, pattern: Column) -> Column:
    """Per match: the lengths of the stretch before it and of the match."""
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    between = F.split(text, pattern, -1)
    return F.zip_with(
        F.slice(between, 1, F.size(found)),
        found,
        lambda gap, match: F.struct(F.length(gap).alias("gap"), F.length(match).alias("size")),
    )


def detections(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, _th, rule, label, priority, confidence, start, end, suppressed): every match of every rule whose keyword the text holds.

    Places are code points of the lower-cased text. A detection is suppressed if a detection of higher priority, or of the
    same priority and longer (or equal and of an earlier rule), covers its interval. Repeated rows share their detections.
    """
    spark = docs.sparkSession
    text = keyed(docs, id_col, text_col).select(*KEY, fold(F.col("_text")).alias("_text"))
    # One pass over the text for all gates; a condition on each would fold the text again for each.
    text = text.where(F.col("_text").rlike("|".join(re.escape(g) for g in GATES)))
    table = rules(spark)
    keywords = sorted({r[4] for r in rows()})
    held = F.filter(F.array(*[F.lit(k) for k in keywords]), lambda k: F.contains("_text", k))
    gated = text.withColumn("keyword", F.explode(held)).join(F.broadcast(table), "keyword")
    # Only lengths leave this stage, never the text.
    matched = gated.where(F.expr("_text rlike pattern")).select(
        *KEY, "rule", "label", "priority", "confidence", _gaps(F.col("_text"), F.col("pattern")).alias("gaps")
    )
    matched = matched.repartition(*KEY).dropDuplicates([*KEY, "rule"])
    each = matched.select(*KEY, "rule", "label", "priority", "confidence", F.posexplode("gaps").alias("nth", "g"))
    so_far = Window.partitionBy(*KEY, "rule").orderBy("nth")
    end = F.sum(F.col("g.gap") + F.col("g.size")).over(so_far)
    each = each.withColumn("end", end).withColumn("start", F.col("end") - F.col("g.size")).drop("g", "nth")
    before = (
        Window.partitionBy(*KEY)
        .orderBy("start", F.desc("end"), F.desc("priority"), "rule")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    # Rows before begin no later; the furthest end among those of at least the row's priority decides.
    reach = {p: F.max(F.when(F.col("priority") >= p, F.col("end"))).over(before) for p in (1, 2, 3)}
    furthest = F.when(F.col("priority") == 3, reach[3]).when(F.col("priority") == 2, reach[2]).otherwise(reach[1])
    return each.withColumn("suppressed", F.coalesce(furthest >= F.col("end"), F.lit(False)))


def base_phrases(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, _th, n_words, n_base, first_word, last_word, base) of every row; places count words from 0."""
    rows_of = keyed(docs, id_col, text_col).select(*KEY, fold(F.col("_text")).alias("_text"))
    word = F.lit(WORD + "+")
    spaced = [p.replace(" ", BREAK + "+") for p in PHRASES]
    pattern = rf"(?<!{WORD})(?:{'|'.join(spaced)})(?!{WORD})"
    likely = (F.contains("_text", F.lit("license")) | F.contains("_text", F.lit("cc"))) & F.col("_text").rlike(pattern)
    rows_of = rows_of.select(
        *KEY,
        F.size(F.regexp_extract_all("_text", word, F.lit(0))).cast("long").alias("n_words"),
        F.when(likely, F.regexp_extract_all("_text", F.lit(pattern), F.lit(0))).alias("_found"),
        F.when(likely, F.split("_text", pattern, -1)).alias("_between"),
    )
    count = lambda s: F.size(F.regexp_extract_all(s, word, F.lit(0))).cast("long")
    phrase = F.transform("_found", lambda s: F.regexp_replace(s, BREAK + "+", " "))
    label = F.create_map(*[F.lit(x) for pair in PHRASES.items() for x in pair])
    rows_of = rows_of.withColumns({"_gap": F.transform("_between", count), "_names": phrase})
    # The last place: all words before the last stretch of text, less those of the last phrase.
    size = lambda s: F.size(F.split(s, " ")).cast("long")
    last_gap = F.element_at("_gap", -1)
    return rows_of.select(
        *KEY,
        "n_words",
        F.coalesce(F.size("_found").cast("long"), F.lit(0).cast("long")).alias("n_base"),
        F.when(F.col("_found").isNotNull(), F.col("_gap")[0]).alias("first_word"),
        F.when(
            F.col("_found").isNotNull(),
            F.col("n_words") - last_gap - size(F.element_at("_names", -1)),
        ).alias("last_word"),
        F.coalesce(F.array_sort(F.array_distinct(F.transform("_names", lambda s: F.element_at(label, s)))), F.array().cast("array<string>")).alias("base"),
    )


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, n_words, n_base, first_word, last_word, base, labels, score): one row per input row.

    ``labels`` are the base labels and those of the detections that stand; ``score`` is the best confidence among them, 0
    without any. NULL and empty texts have no words and no labels. An empty table gives no rows.
    """
    stand = detections(docs, id_col, text_col).where(~F.col("suppressed"))
    found = stand.groupBy(*KEY).agg(F.collect_set("label").alias("_labels"), F.max("confidence").alias("_best"))
    out = with_facts(base_phrases(docs, id_col, text_col), found)
    more = F.coalesce("_labels", F.array().cast("array<string>"))
    return out.select(
        "_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        "base",
        F.array_sort(F.array_union("base", more)).alias("labels"),
        F.greatest(F.coalesce("_best", F.lit(0.0)), F.when(F.col("n_base") > 0, F.lit(BASE_SCORE)).otherwise(F.lit(0.0))).alias("score"),
    )
