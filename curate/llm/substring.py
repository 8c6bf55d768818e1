"""Substring deduplication by level-wise doubling.

A text window of W words repeats only if every window inside it does. So short windows are compared first,
and only those that occur twice are extended to twice their length, and so on up to W: nearly all text
drops out at the first level. At that level a W-word window is stood for by the least hash among its short
windows (equal windows choose the same one), so one window in a dozen is compared.

A hot window cannot fill one task: each batch of texts settles its own repeats and sends one row per
distinct window to the shuffle, so a window has at most as many rows there as there are batches.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from curate.llm.keys import KEY, keyed, with_facts
from curate.llm.words import PLAIN, SLICE, Words, mix, signed, slices, texts, windows, winnow
from curate.storage import stage

WINDOW = 35
#: The first level is the least halving of the window that has at least so many words.
FIRST = 12


def levels(window: int, first: int = FIRST) -> list[int]:
    """Window lengths by level: each at most doubles the one before, the last is the window."""
    out = [window]
    while (out[0] + 1) // 2 >= first:
        out.insert(0, (out[0] + 1) // 2)
    return out


def _rows(batch: pa.RecordBatch, lo: int, of: np.ndarray, at: np.ndarray, h: np.ndarray, check: np.ndarray) -> pa.RecordBatch:
    """Rows to compare: places that repeat inside the batch are known; of each window one row (at -1) bears witness.

    Known places have a row of their own, dealt out by place; a place that is alone in its batch is its own witness.
    """
    _, index, inverse, count = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
    known = count[inverse] > 1
    witness = np.sort(index[count > 1])
    order = np.concatenate([np.arange(len(h)), witness])
    known_row = np.concatenate([known, np.zeros(len(witness), bool)])
    place = np.concatenate([at, np.full(len(witness), -1, np.int64)])
    spread = mix(h[order] + np.arange(len(order), dtype=np.uint64))
    take = pa.array(of[order] + lo)
    return pa.RecordBatch.from_arrays(
        [
            batch.column("_id").take(take),
            batch.column("_th").take(take),
            pa.array(place.astype(np.int32)),
            pa.array(known_row),
            pa.array(signed(np.where(known_row, spread, h[order]))),
            pa.array(np.where(known_row, np.uint64(0), check[order] >> np.uint64(33)).astype(np.int32)),
        ],
        names=["_id", "_th", "at", "known", "h", "h2"],
    )


def _first_level(size: int, window: int):
    """The short windows that stand for the windows of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = texts(batch.column("_text"))
            for lo, hi in slices(offsets, SLICE):
                words = Words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1], PLAIN, False)
                h = windows(words.hashes(), size)
                places = winnow(h, words.left(), size, window)
                of = words.text_of()[places]
                yield _rows(batch, lo, of, places - words.first[of], h[places], h[places] * np.uint64(0))

    return run


def _next_level(size: int, before: int):
    """All windows of ``size`` words that hold a surviving window of ``before`` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = texts(batch.column("_text"))
            lists = batch.column("places")
            ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
            for lo, hi in slices(offsets, SLICE):
                words = Words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1], PLAIN, False)
                h1 = words.hashes()
                h, check = windows(h1, size), windows(mix(h1 + np.uint64(1)), size)
                # Places marked as the start of a wanted window: a running sum over range borders.
                border = np.zeros(len(h1) + 1, np.int64)
                n = ends[lo + 1 : hi + 1] - ends[lo:hi]
                mine = flat[ends[lo] : ends[hi]]
                start = np.repeat(words.first[:-1], n)
                stop = np.repeat(words.first[1:], n)
                a = np.maximum(start + mine - (size - before), start)
                b = np.minimum(start + mine, stop - size)
                fits = b >= a
                np.add.at(border, a[fits], 1)
                np.add.at(border, b[fits] + 1, -1)
                places = np.flatnonzero(np.cumsum(border)[:-1] > 0)
                of = words.text_of()[places]
                yield _rows(batch, lo, of, places - words.first[of], h[places], check[places])

    return run


def _survivors(rows: DataFrame) -> DataFrame:
    """(_id, _th, at) of the places whose window occurs elsewhere too."""
    same = Window.partitionBy("known", "h", "h2")
    return (
        rows.withColumn("n", F.count(F.lit(1)).over(same)).where("at >= 0 and (known or n > 1)").select(*KEY, "at")
    )


def _places(survivors: DataFrame) -> DataFrame:
    """One row per document: its surviving places. The list is no longer than the document."""
    return survivors.groupBy(*KEY).agg(F.collect_set("at").alias("places"))


def _cut(column: pa.Array, lists: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words, words removed, and what is left of each text without the words that its repeated windows cover."""
    data, offsets = texts(column)
    lists = lists.fill_null([]) if lists.null_count else lists
    ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
    out: list[str] = []
    removed = np.zeros(len(column), np.int64)
    total = np.zeros(len(column), np.int64)
    for lo, hi in slices(offsets, SLICE):
        words = Words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1], PLAIN, False)
        total[lo:hi] = words.count
        raw = words.data.tobytes()
        for i in range(hi - lo):
            a, b = int(words.first[i]), int(words.first[i + 1])
            gone = np.zeros(b - a + 1, np.int64)
            at = flat[ends[lo + i] : ends[lo + i + 1]]
            np.add.at(gone, at, 1)
            np.add.at(gone, at + size, -1)
            stay = a + np.flatnonzero(np.cumsum(gone)[:-1] == 0)
            removed[lo + i] = b - a - len(stay)
            starts, stops = words.start[stay].tolist(), words.end[stay].tolist()
            out.append(b" ".join([raw[s:e] for s, e in zip(starts, stops, strict=True)]).decode())
    return total, removed, pa.array(out, pa.large_string()).cast(pa.string())


def _keep(size: int):
    """Each text without the words that its repeated windows cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, removed, kept = _cut(batch.column("_text"), batch.column("places"), size)
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), batch.column("_th"), pa.array(total), pa.array(removed), kept],
                names=["_id", "_th", "n_words", "n_removed", "kept"],
            )

    return run


def repeated_places(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, _th, places, _text): documents with repeated windows, where these start, and the text."""
    found, rows = _found(docs, window, id_col, text_col)
    return with_facts(rows.dropDuplicates(KEY), _places(found), "inner").select(*KEY, "_text", "places")


def _found(docs: DataFrame, window: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(_id, _th, at) of every repeated window, and (_id, _th, _text) of the rows that may hold one.

    Rows of equal id and text are told apart here: a repeated row makes all its windows repeated.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    shape = f"_id {id_type}, _th long, at int, known boolean, h long, h2 int"
    rows = keyed(docs, id_col, text_col)
    sizes = levels(window)
    found = _survivors(rows.mapInArrow(_first_level(sizes[0], window), shape))
    for before, size in zip(sizes, sizes[1:], strict=False):
        # The texts of the survivors alone go on; staged, as the next level reads them again.
        candidates = stage(with_facts(rows, _places(found), "inner").select(*KEY, "_text", "places"), "windows")
        found = _survivors(candidates.mapInArrow(_next_level(size, before), shape))
        rows = candidates.select(*KEY, "_text")
    return found, rows


def substring_dedup(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, _th, n_words, n_removed, kept): one row per document identity that has a repeated window.

    Words are runs of anything but ASCII white space, unchanged. A window is ``window`` consecutive words of one
    text; its words go if the same words start anywhere else too, overlapping and in the same text included.
    Windows are judged on the input, never on what is left. ``kept`` joins the rest by one space. Documents
    without a repeated window (NULL, empty and short texts too) have no row: nothing of them goes. Repeated rows
    (same id, same text) repeat each other. Windows are compared by 95 bits of hash. The texts of candidate
    documents are staged once per level in the shared folder.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    shape = f"_id {id_type}, _th long, n_words long, n_removed long, kept string"
    return repeated_places(docs, window, id_col, text_col).mapInArrow(_keep(window), shape)


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number of words, and the hash of the words joined by one space."""
    for batch in batches:
        counts, digests = [], []
        for text in batch.column("_text"):
            words = (text.as_py() or "").encode().split()
            counts.append(len(words))
            digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column("_id"), batch.column("_th"), pa.array(counts, pa.int64()), pa.array(digests, pa.string())],
            names=["_id", "_th", "n_words", "kept_sha256"],
        )


def digests(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, n_words, n_removed, kept_sha256) of every row of ``docs``."""
    id_type = docs.schema[id_col].dataType.simpleString()
    whole = keyed(docs, id_col, text_col).mapInArrow(_whole, f"_id {id_type}, _th long, n_words long, kept_sha256 string")
    cut = substring_dedup(docs, window, id_col, text_col).select(
        *KEY, "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("cut_sha256")
    )
    return with_facts(whole, cut).select(
        "_id",
        "n_words",
        F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"),
        F.coalesce("cut_sha256", "kept_sha256").alias("kept_sha256"),
    )


def without_repeats(
    docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None
) -> DataFrame:
    """``docs`` with repeated windows cut from the text; other texts and columns stay as they are.

    A text that is cut to nothing stays as an empty one. ``length_col`` is a column to hold the new length of a cut text.
    Only the places of the windows are joined to ``docs``, and the texts are cut there, so no cut text is shuffled.
    """
    found, _ = _found(docs, window, id_col, text_col)
    places = _places(found).withColumnsRenamed({"_id": "_fid", "_th": "_fth", "places": "_places"})
    match = docs[id_col].eqNullSafe(places["_fid"]) & (F.xxhash64(docs[text_col]) == places["_fth"])

    @F.arrow_udf("string")
    def left(text: pa.Array, lists: pa.Array) -> pa.Array:
        return _cut(text, lists, window)[2]

    hit = F.col("_places").isNotNull()
    marked = docs.join(places, match, "left").withColumn("_kept", F.when(hit, left(F.when(hit, F.col(text_col)), "_places")))
    new = {text_col: F.coalesce("_kept", text_col).alias(text_col)}
    if length_col:
        kind = docs.schema[length_col].dataType
        new[length_col] = F.coalesce(F.length("_kept").cast(kind), length_col).alias(length_col)
    return marked.select(*[new.get(c, F.col(c)) for c in docs.columns])
