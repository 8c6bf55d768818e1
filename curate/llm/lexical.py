"""Ranked lexical search: accumulator-limited term-at-a-time scoring, with the exact best documents of every item.

One pass over the documents leaves, per document, its length and the counts of the words that some item asks for. Each
item takes its terms from the rarest to the most common. In a round the next terms' postings are added to accumulators,
one per (item, document); the rounds double the number of terms. After a round, the best accumulators are completed with
all their item's terms, which gives the kth score known so far. Once the bounds of the terms that remain add up to
less, no document without an accumulator can enter the result: no more accumulators are made. Those that can
still reach the kth score are then completed exactly from their documents' own counts, so common words are never
multiplied with all documents.

Words of an item and of a document are equal if their 64-bit hash, their length and their first eight bytes are equal (exact
up to eight bytes).

Items are taken in blocks of about ``BLOCK_TERMS`` terms, each a search of its own, so what goes to every task is bounded.

Odd rows: NULL and empty texts have no terms, do not count and are not found; an item without terms has no rows; items of
equal id are ranked one by one; repeated documents are found as often as they stand there; NULL ids come last among
equal scores; without documents or items the result is empty. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from curate.llm.words import FOLDED, pieces, signed, texts
from curate.operators.ranking import top_per_group
from curate.storage import stage

K = 10
#: Terms of the items searched together: their vocabulary (20 bytes a term) and their weights go to every task.
BLOCK_TERMS = 200_000
#: Terms of the first round; every later round takes twice as many.
FIRST = 2
_PART_BITS = 33


def _heads(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The first eight bytes of each word as one number."""
    out = np.zeros(len(start), np.uint64)
    for k in range(8):
        inside = start + k < end
        byte = np.where(inside, data[np.minimum(start + k, max(len(data) - 1, 0))] if len(data) else 0, 0)
        out |= byte.astype(np.uint64) << np.uint64(8 * k)
    return out


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(_iid, h, size, head, times) of every distinct word of an item."""
    for batch in batches:
        ids = batch.column("_iid").to_numpy()
        data, offsets = texts(batch.column("_text"))
        parts = []
        for lo, words in pieces(data, offsets, FOLDED, True):
            of = words.text_of() + lo
            parts.append(np.stack([ids[of], signed(words.hashes()), words.end - words.start, signed(_heads(words.data, words.start, words.end))]))
        rows, times = np.unique(np.concatenate(parts, axis=1), axis=1, return_counts=True) if parts else (np.zeros((4, 0), np.int64), np.zeros(0, np.int64))
        yield pa.RecordBatch.from_arrays([*(pa.array(r) for r in rows), pa.array(times)], names=["_iid", "h", "size", "head", "times"])


def _matched(h: np.ndarray, size: np.ndarray, head: np.ndarray):
    """Of each document: a number of its own, its words and, by place in the vocabulary, the asked ones with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << _PART_BITS
        width = len(h)
        for batch in batches:
            rows = batch.num_rows
            n = np.zeros(rows, np.int64)
            found, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            data, offsets = texts(batch.column("_text"))
            for lo, words in pieces(data, offsets, FOLDED, True):
                n[lo : lo + len(words.count)] += words.count
                x = words.hashes()
                place = np.minimum(np.searchsorted(h, x), width - 1)
                hit = np.flatnonzero(h[place] == x)
                start, end, place = words.start[hit], words.end[hit], place[hit]
                # Words of one hash that differ otherwise stand side by side in the vocabulary: a few steps at most.
                same = np.zeros(len(hit), bool)
                heads = _heads(words.data, start, end)
                todo = np.arange(len(hit))
                step = place.copy()
                while len(todo):
                    good = (size[step[todo]] == (end - start)[todo]) & (head[step[todo]] == heads[todo])
                    place[todo[good]] = step[todo[good]]
                    same[todo[good]] = True
                    todo = todo[~good]
                    step[todo] += 1
                    todo = todo[(step[todo] < width)]
                    todo = todo[h[step[todo]] == x[hit[todo]]]
                pairs, times = np.unique((words.text_of()[hit[same]] + lo) * width + place[same], return_counts=True)
                found.append(pairs)
                counts.append(times)
            pairs, where = np.unique(np.concatenate(found), return_inverse=True)
            times = np.bincount(where, weights=np.concatenate(counts), minlength=len(pairs)).astype(np.int64)
            ends = np.searchsorted(pairs, np.arange(rows + 1) * width).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in ((pairs % width).astype(np.int32), times)]
            yield pa.RecordBatch.from_arrays([pa.array(at + np.arange(rows)), batch.column("_id"), pa.array(n), *lists], names=["_rid", "_id", "n", "terms", "times"])
            at += rows

    return run


def _numbered(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    named = items.select(F.col(item_col).alias("item_id"), F.col(text_col).alias("_text"))
    return stage(named.withColumn("_iid", F.monotonically_increasing_id()), "items")


def _in_blocks(wanted: DataFrame, limit: int) -> tuple[DataFrame, int]:
    """The items' terms with ``_block``; no block holds more than twice ``limit`` terms, but for one that is a single item."""
    blocks = max(1, -(-wanted.count() // limit))
    while True:
        cut = wanted.withColumn("_block", F.pmod(F.xxhash64("_iid"), F.lit(blocks)))
        sizes = cut.groupBy("_block").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("_iid").alias("items"))
        if blocks == 1 or sizes.where((F.col("n") > 2 * limit) & (F.col("items") > 1)).isEmpty():
            return cut, blocks
        blocks *= 2


def _postings(index: DataFrame, *keep: str) -> DataFrame:
    """(_rid, keep..., t, part): one row per document and asked word."""
    rows = index.select("_rid", *keep, "m", F.explode(F.arrays_zip("terms", "times")).alias("p"))
    part = F.expr("(1000000000 * p.times) div (1000 * p.times + 8 * m)")
    return rows.select("_rid", *keep, F.col("p.terms").alias("t"), part.alias("part"))


def _completed(rows: DataFrame, index: DataFrame, terms: DataFrame) -> DataFrame:
    """(_iid, _rid, _id, score): accumulators (_iid, _rid, partial, done) with the terms behind ``done`` added from the documents' own counts."""
    held = index.join(rows, "_rid")
    parts = _postings(held, "_iid", "_id", "partial", "done")
    asked = F.broadcast(terms.select("_iid", "t", "weight", "place"))
    gain = F.when(F.col("place") > F.col("done"), F.col("weight") * F.col("part")).otherwise(0)
    added = parts.join(asked, ["_iid", "t"], "left")
    return added.groupBy("_iid", "_rid", "_id", "partial").agg(F.coalesce(F.sum(gain), F.lit(0)).alias("more")).select(
        "_iid", "_rid", "_id", (F.col("partial") + F.col("more")).alias("score")
    )


def _search(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame | None:
    """(_iid, rank, doc_id, score) of the items in one block."""
    spark = docs.sparkSession
    words = wanted.select("h", "size", "head").distinct().toArrow()
    order = np.lexsort([words.column(c).to_numpy() for c in ("head", "size")] + [words.column("h").to_numpy().view(np.uint64)])
    h, size, head = (words.column(c).to_numpy()[order] for c in ("h", "size", "head"))
    if not len(h):
        return None
    id_type = docs.schema["_id"].dataType.simpleString()
    shape = f"_rid long, _id {id_type}, n long, terms array<int>, times array<long>"
    index = stage(docs.mapInArrow(_matched(h.view(np.uint64), size, head.view(np.uint64)), shape), "index")
    total = index.agg(F.count_if(F.col("n") > 0).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("words")).first()
    if not total["docs"]:
        return None
    # Documents without any asked word count in the totals only.
    index = index.where(F.size("terms") > 0).withColumn("m", F.expr(f"25 + (75 * n * {total['docs']}L) div {total['words']}L"))
    stats = stage(_postings(index).groupBy("t").agg(F.count(F.lit(1)).alias("df"), F.max("part").alias("best")), "terms")
    named = spark.createDataFrame(pa.table({"h": pa.array(h), "size": pa.array(size), "head": pa.array(head), "t": pa.array(np.arange(len(h), dtype=np.int32))}))
    known = wanted.join(F.broadcast(named), ["h", "size", "head"]).join(F.broadcast(stats), "t")
    weight = F.col("times") * F.floor(F.lit(1000.0) * F.log(F.lit(2.0 * total["docs"] + 2.0) / (F.lit(2.0) * F.col("df") + F.lit(1.0))))
    by_item = Window.partitionBy("_iid").orderBy("df", "t")
    behind = by_item.rowsBetween(1, Window.unboundedFollowing)
    terms = known.withColumn("weight", weight.cast("long")).where("weight > 0").withColumn("place", F.row_number().over(by_item))
    terms = terms.withColumn("rest", F.coalesce(F.sum(F.col("weight") * F.col("best")).over(behind), F.lit(0)))
    terms = stage(terms.select("_iid", "t", "weight", "place", "rest"), "weights")
    last = terms.agg(F.max("place")).first()[0] or 0

    active = terms.select("_iid").distinct()
    known_rows, ready = None, []
    start, width = 0, FIRST
    while start < last:
        end = start + width
        now = F.broadcast(terms.where((F.col("place") > start) & (F.col("place") <= end)).join(F.broadcast(active), "_iid", "left_semi"))
        found = _postings(index).join(now, "t").select("_iid", "_rid", (F.col("weight") * F.col("part")).alias("partial"))
        if known_rows is not None:
            found = found.unionByName(known_rows.join(F.broadcast(active), "_iid", "left_semi"))
        known_rows = stage(found.groupBy("_iid", "_rid").agg(F.sum("partial").alias("partial")), "accumulators")
        # What the terms behind this round can still add, and the kth score among the completed best.
        rests = terms.where(F.col("place") <= end).groupBy("_iid").agg(F.min("rest").alias("rest"))
        best = stage(top_per_group(known_rows, "_iid", [F.col("partial").desc(), "_rid"], k).select("_iid", "_rid", "partial", F.lit(end).alias("done")), "best")
        full = _completed(best, index, terms).groupBy("_iid").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"))
        kth = F.when(F.col("n") >= k, F.col("least")).otherwise(0)
        state = rests.join(F.broadcast(active), "_iid", "left_semi").join(full, "_iid", "left").select("_iid", "rest", F.coalesce(kth, F.lit(0)).alias("kth"))
        state = stage(state, "state")
        going = (F.col("rest") > 0) & (F.col("rest") >= F.col("kth"))
        stopped = state.where(~going)
        alive = known_rows.join(F.broadcast(stopped), "_iid").where(F.col("partial") + F.col("rest") >= F.col("kth"))
        ready.append(alive.select("_iid", "_rid", "partial", F.lit(end).alias("done")))
        active = state.where(going).select("_iid")
        start, width = end, 2 * width
        if active.isEmpty():
            break
    if not ready:
        return None
    rows = ready[0]
    for more in ready[1:]:
        rows = rows.unionByName(more)
    scored = _completed(stage(rows, "survivors"), index, terms).where("score > 0")
    order = [F.col("score").desc(), F.col("_id").asc_nulls_last(), "_rid"]
    return top_per_group(scored, "_iid", order, k).select("_iid", "rank", F.col("_id").alias("doc_id"), "score")


def rank(
    docs: DataFrame,
    items: DataFrame,
    k: int = K,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    block_terms: int = BLOCK_TERMS,
) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` highest-scoring documents of each item, those with a score above 0."""
    named = _numbered(items, item_col, item_text_col)
    wanted = named.select("_iid", "_text").mapInArrow(_item_terms, "_iid long, h long, size long, head long, times long")
    wanted, blocks = _in_blocks(stage(wanted, "wanted"), block_terms)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    out = None
    for block in range(blocks):
        found = _search(rows, wanted.where(F.col("_block") == block).drop("_block"), k)
        if found is not None:
            out = found if out is None else out.unionByName(found)
    if out is None:
        empty = f"item_id {named.schema['item_id'].dataType.simpleString()}, rank int, doc_id {docs.schema[id_col].dataType.simpleString()}, score long"
        return docs.sparkSession.createDataFrame([], empty)
    return out.join(named.select("_iid", "item_id"), "_iid").select("item_id", "rank", "doc_id", "score")
