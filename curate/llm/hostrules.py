"""Quality rules by host: documents are judged by their own counts, hosts by the failures of their documents.

Failures are counted per host; a host's failure rate is shrunk towards the rate of all documents with a beta
prior whose strength comes from how much hosts differ, so that a host of few documents is not judged by chance.
The verdict of a host holds for all its documents. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curate.operators.skew import join_unique
from curate.storage import stage

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
REPEAT = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: Per cent of symbols among the characters of words, and of repeated lines among lines with words.
MAX_SYMBOL_PERCENT = 15
MAX_LINE_PERCENT = 50
#: A host goes if more than this share of its documents fails, after shrinking.
MAX_HOST_RATE = 0.5
#: Least and greatest weight of the prior, in documents.
PRIOR = (2.0, 1000.0)


def _without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """(_id, _host, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words) of every row.

    NULL and empty texts have no words and count 0 everywhere. ``n_repeat_words`` are the words inside 5-word windows that
    occur twice or more in the text. Repeats are found by sorting the hashes of the text's own windows; only texts that have
    any look for the places.
    """
    text = F.coalesce(text_col, F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(host_col).alias("_host"), text.alias("_text"))
    rows = rows.withColumn("_words", F.regexp_extract_all("_text", F.lit(WORD), F.lit(0)))
    rows = rows.withColumn("n_words", F.size("_words").cast("long"))
    lines = F.filter(F.split("_text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    n = F.col("n_words").cast("int")
    window = F.transform(
        F.sequence(F.lit(0), n - REPEAT), lambda i: F.xxhash64(*[F.get(F.col("_words"), i + k) for k in range(REPEAT)])
    )
    rows = rows.select(
        "_id",
        "_host",
        "n_words",
        _without(F.col("_text"), SPACES).cast("long").alias("word_chars"),
        (F.length("_text") - _without(F.col("_text"), SYMBOLS)).cast("long").alias("n_symbols"),
        lines.alias("_lines"),
        F.when(n >= REPEAT, window).alias("_windows"),
    )
    ranked = F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = rows.select(
        "_id",
        "_host",
        "n_words",
        "word_chars",
        "n_symbols",
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), ranked).alias("_ranked"),
    )
    same = lambda x, i: (x["h"] == F.get("_ranked", i - 1)["h"]) | (x["h"] == F.get("_ranked", i + 1)["h"])
    places = F.transform(F.filter("_ranked", lambda x, i: F.coalesce(same(x, i), F.lit(False))), lambda x: x["i"])
    rows = rows.withColumn("_places", F.sort_array(places)).drop("_ranked")
    step = lambda p, i: F.least(F.lit(REPEAT), F.coalesce(F.get("_places", i + 1) - p, F.lit(REPEAT)))
    covered = F.aggregate(F.transform("_places", step), F.lit(0).cast("long"), lambda s, x: s + x)
    return rows.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("_places")


def base_failed() -> Column:
    """Too short, or too much of it repeated."""
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def failed() -> Column:
    """Any rule failed: the base rules, too many symbols, or too many repeated lines."""
    return (
        base_failed()
        | (100 * F.col("n_symbols") > MAX_SYMBOL_PERCENT * F.col("word_chars"))
        | (100 * F.col("n_dup_lines") > MAX_LINE_PERCENT * F.col("n_lines"))
    )


def host_verdicts(judged: DataFrame) -> DataFrame:
    """(_host, n_docs, n_failed, rate, host_ok) from rows with _host and _failed.

    The prior is Beta(m s, (1 - m) s): m is the share of failures among all documents, and s = m (1 - m) / v - 1 with v the
    variance of the hosts' raw rates, kept inside PRIOR (its top where hosts do not differ or there is one only). ``rate`` is
    (failures + m s) / (documents + s). NULL hosts are one host. The one row of moments comes to the driver.
    """
    hosts = judged.groupBy("_host").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("_failed").cast("long")).alias("n_failed")
    )
    m, v = hosts.agg(
        F.sum("n_failed") / F.sum("n_docs"), F.var_samp(F.round(F.col("n_failed") / F.col("n_docs"), 9))
    ).first()
    s = PRIOR[1] if not m or not v else min(max(m * (1 - m) / v - 1, PRIOR[0]), PRIOR[1])
    rate = (F.col("n_failed") + F.lit(float((m or 0) * s))) / (F.col("n_docs") + F.lit(float(s)))
    return hosts.withColumn("rate", rate).withColumn("host_ok", F.col("rate") <= MAX_HOST_RATE)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Every row's counts, ``base_failed``, its host's ``host_rate``, and ``kept`` (own rules and the host's verdict).

    Only the id, text and host columns are read. Repeated rows are judged one by one. An empty table gives no rows. The counts
    (a few numbers per row) are staged once in the shared folder, as the verdicts need them before the rows do.
    """
    rows = counts(docs, id_col, text_col, host_col).withColumn("base_failed", base_failed()).withColumn("_failed", failed())
    # A NULL host would match nothing in a join.
    rows = stage(rows.withColumn("_name", F.struct(F.col("_host").isNull(), F.coalesce(F.col("_host").cast("string"), F.lit("")))), "counts")
    hosts = host_verdicts(rows.withColumn("_host", F.col("_name")))
    hosts = hosts.select(F.col("_host").alias("_name"), F.col("rate").alias("host_rate"), "host_ok")
    out = join_unique(rows, hosts, "_name", "inner")
    return out.withColumn("kept", ~F.col("base_failed") & F.col("host_ok")).drop("_name", "_failed", "host_ok")
