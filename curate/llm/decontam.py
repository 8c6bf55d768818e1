"""Benchmark decontamination by winnowing.

Of every ``span`` consecutive words, the least hash of the k-word windows inside is kept as a fingerprint,
on both sides. Two equal spans keep the same one, so joining fingerprints finds every shared span; each hit
is then extended to all spans around it, which are compared word for word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curate.llm.keys import KEY, keyed, only, with_facts
from curate.llm.words import FOLDED, SLICE, Words, mix, signed, slices, texts, windows, winnow
from curate.storage import stage

#: Consecutive words that count as contamination.
SPAN = 10


def _grams(span: int) -> int:
    """Words of a fingerprint window: about half a span keeps one window in about four, and rare enough ones."""
    return (span + 1) // 2


def _fingerprints(words: Words, h: np.ndarray, left: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, fingerprints); the span is part of the fingerprint."""
    g = windows(h, _grams(span))
    at = winnow(g, left, _grams(span), span)
    return at, mix(g[at] + np.uint64(span))


def _batches(column: pa.Array, lower: bool = True) -> Iterator[tuple[int, int, Words]]:
    data, offsets = texts(column)
    for lo, hi in slices(offsets, SLICE):
        yield lo, hi, Words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1], FOLDED, lower)


def _scan(spans: list[int]):
    """Per document one row (span 0, at = its number of words) and one row per fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, th = batch.column("_id"), batch.column("_th")
            for lo, hi, words in _batches(batch.column("_text")):
                h, left, of = words.hashes(), words.left(), words.text_of()
                rows, span, at, fp = [np.arange(hi - lo)], [np.zeros(hi - lo, np.int32)], [words.count], []
                fp.append(mix(np.arange(hi - lo, dtype=np.uint64) + words.count.astype(np.uint64)))
                for n in spans:
                    places, prints = _fingerprints(words, h, left, n)
                    rows.append(of[places])
                    span.append(np.full(len(places), n, np.int32))
                    at.append(places - words.first[of[places]])
                    fp.append(prints)
                take = pa.array(np.concatenate(rows) + lo)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(take),
                        th.take(take),
                        pa.array(np.concatenate(span)),
                        pa.array(np.concatenate(at).astype(np.int64)),
                        pa.array(signed(np.concatenate(fp))),
                    ],
                    names=["_id", "_th", "span", "at", "fp"],
                )

    return run


def _item_windows(span: int):
    """Per item and window: its words and how many; an item shorter than the span is one window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("item")
            for lo, hi, words in _batches(batch.column("_text")):
                rows, spans, text = [], [], []
                for i in range(hi - lo):
                    a, n = int(words.first[i]), int(words.count[i])
                    size = min(n, span)
                    for s in range(a, a + n - size + 1) if n else ():
                        rows.append(i + lo)
                        spans.append(size)
                        text.append(words.string(s, s + size).decode())
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(rows, pa.int64())), pa.array(spans, pa.int32()), pa.array(text, pa.string())],
                    names=["item", "span", "window"],
                )

    return run


def _window_prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fingerprints of item windows (each window is a text of exactly one span)."""
    for batch in batches:
        spans = batch.column("span").to_numpy()
        for lo, hi, words in _batches(batch.column("window"), lower=False):
            h, left, of, out = words.hashes(), words.left(), words.text_of(), []
            for n in np.unique(spans[lo:hi]):
                places, prints = _fingerprints(words, h, left, int(n))
                out.append(prints[spans[lo + of[places]] == n])
            yield pa.RecordBatch.from_arrays([pa.array(signed(np.unique(np.concatenate(out))))], names=["fp"])


def _extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All spans around each hit, as words."""
    for batch in batches:
        ids, th, hits = batch.column("_id"), batch.column("_th"), batch.column("hits")
        for lo, hi, words in _batches(batch.column("_text")):
            rows, spans, at, text = [], [], [], []
            for i in range(hi - lo):
                found: dict[int, set[int]] = {}
                a, n = int(words.first[i]), int(words.count[i])
                for hit in hits[lo + i].as_py():
                    span, p = hit["span"], hit["at"]
                    first = max(0, p + _grams(span) - span)
                    found.setdefault(span, set()).update(range(first, min(p, n - span) + 1))
                for span, places in found.items():
                    for p in sorted(places):
                        rows.append(lo + i)
                        spans.append(span)
                        at.append(p)
                        text.append(words.string(a + p, a + p + span).decode())
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [ids.take(take), th.take(take), pa.array(spans, pa.int32()), pa.array(at, pa.int64()), pa.array(text, pa.string())],
                names=["_id", "_th", "span", "at", "window"],
            )


def contamination(
    docs: DataFrame,
    items: DataFrame,
    span: int = SPAN,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """(_id, _th, n_words, n_hit, items): one row per document identity; ``items`` are the distinct item ids with a hit.

    Texts are lower-cased (A-Z) and cut into words. A window is ``span`` consecutive words of an item, or the
    whole of a shorter one; a document word inside any occurrence of a window is hit. NULL and empty texts
    have no words; items without words have no window; an item whose id is NULL hits words but is not listed.
    Repeated items count once, repeated documents share one row. Documents need no size limit; a batch keeps
    at least one whole text in memory. One narrow staged table (a row per document, and its few candidate
    places) lies in the shared folder.
    """
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType.simpleString()
    item = items.select(F.col(item_col).alias("item"), F.col(item_text_col).cast("string").alias("_text"))
    item_type = items.schema[item_col].dataType.simpleString()
    item_windows = item.mapInArrow(_item_windows(span), f"item {item_type}, span int, window string").distinct()
    # At most ``span`` numbers: the lengths of windows that occur (nearly always the one).
    spans = sorted(r[0] for r in item_windows.select("span").distinct().collect())
    prints = item_windows.select("span", "window").distinct().mapInArrow(_window_prints, "fp long").distinct()

    rows = keyed(docs, id_col, text_col)
    scanned = rows.mapInArrow(_scan(spans), f"_id {id_type}, _th long, span int, at long, fp long")
    # Spark broadcasts the benchmark's fingerprints if their measured size allows, else it shuffles on them.
    hit = scanned.join(prints.withColumn("_hit", F.lit(True)), "fp", "left").where("span = 0 or _hit")
    per_doc = hit.groupBy(*KEY).agg(
        F.max(F.when(F.col("span") == 0, F.col("at"))).alias("n_words"),
        F.collect_set(F.when(F.col("span") > 0, F.struct("span", "at"))).alias("hits"),
    )
    per_doc = stage(per_doc, "contamination")

    candidates = with_facts(rows, per_doc.where(F.size("hits") > 0).select(*KEY, "hits"), "inner")
    around = candidates.mapInArrow(_extend, f"_id {id_type}, _th long, span int, at long, window string")
    found = around.join(item_windows, ["window", "span"]).groupBy(*KEY).agg(
        F.sort_array(F.collect_set(F.struct("at", (F.col("at") + F.col("span")).alias("until")))).alias("places"),
        F.collect_set("item").alias("items"),
    )
    # Length of the union of the hit spans, in order of their starts.
    covered = F.aggregate(
        "places",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("until")),
        lambda s, x: F.struct(
            (s["n"] + F.greatest(F.lit(0), x["until"] - F.greatest(x["at"], s["until"]))).alias("n"),
            F.greatest(s["until"], x["until"]).alias("until"),
        ),
        lambda s: s["n"],
    )
    found = found.select(*KEY, covered.alias("n_hit"), "items")
    out = with_facts(per_doc.select(*KEY, "n_words"), found)
    return out.select(
        *KEY,
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("items", F.array().cast(f"array<{item_type}>")).alias("items"),
    )


def of_rows(docs: DataFrame, verdict: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The verdict of every row of ``docs``: repeated rows have one each."""
    rows = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_th"))
    return with_facts(rows, verdict).drop("_th")


def decontaminate(docs: DataFrame, items: DataFrame, span: int = SPAN, id_col: str = "doc_id", text_col: str = "text", **names) -> DataFrame:
    """The rows of ``docs`` without any hit, all their columns."""
    verdict = contamination(docs, items, span, id_col, text_col, **names)
    return only(docs, verdict.where("n_hit > 0"), False, id_col, text_col)
