"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text is the set of its character n-grams, folded to lower case and hashed to a fixed number of places. For each
place the learning texts give a log-count ratio: how much likelier it is in toxic texts than in others. The places
that tell the two classes apart best are kept, each worth its ratio, and a logistic regression learns how far each is to
be believed. Counting places is a map-combined aggregate; the sums that come to the driver are bounded by
parameters. Scoring is one vectorised pass over the whole of every text.

Odd rows: NULL and empty texts have no n-grams and get the score of the intercept; repeated rows get equal scores;
an empty table gives no rows; without labels of both classes every score is the share of toxic ones, smoothed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curate.llm.keys import KEY, keyed
from curate.llm.words import SLICE, mix, slices, texts
from curate.storage import stage

#: Labelled rows that are learnt from, at most: the least hashes of the id, of all rows that may be learnt from.
TRAIN_ROWS = 20_000
#: One document in FOLDS is held out: those whose checksum of the id leaves HELD.
FOLDS, HELD = 3, 1
THRESHOLD = 0.7
#: Characters of an n-gram; a space stands before and after each text.
LEAST, MOST = 4, 6
BITS = 20
#: Places with a weight: those with the largest chi-square.
FEATURES = 8192
SMOOTH = 1.0
PENALTY = 1e-3
STEPS = 150

_SPACE = np.uint32(0x20)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def _fold_table() -> np.ndarray:
    """Lower case of characters of one or two UTF-8 bytes, as the number those bytes spell; white space is a space."""
    table = np.arange(1 << 16, dtype=np.uint32)

    def spelt(c: str) -> int:
        return int.from_bytes(c.encode(), "big")

    for point in range(0x800):
        c = chr(point)
        low = " " if c.isspace() else c.lower()
        if len(low) == 1 and spelt(low) < 1 << 16:
            table[spelt(c)] = spelt(low)
    return table


_FOLD = _fold_table()


def characters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(characters, offsets): one number per character, the bytes that spell it, folded; a space around each text."""
    offsets = offsets - offsets[0]
    lead = (data & 0xC0) != 0x80
    lead[offsets[:-1][offsets[:-1] < len(data)]] = True  # a broken text does not reach into its neighbour
    at = np.flatnonzero(lead)
    spelt = data[at].astype(np.uint32)
    size = np.diff(np.append(at, len(data)))
    for k in range(1, 4):
        longer = size > k
        spelt[longer] = (spelt[longer] << np.uint32(8)) | data[at[longer] + k]
    short = spelt < 1 << 16
    spelt[short] = _FOLD[spelt[short]]
    first = np.searchsorted(at, offsets)
    n = len(offsets) - 1
    out = np.full(len(at) + 2 * n, _SPACE, np.uint32)
    of = np.repeat(np.arange(n), np.diff(first))
    out[np.arange(len(at)) + 2 * of + 1] = spelt
    return out, first + 2 * np.arange(n + 1)


def _pieces(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, characters, offsets) of about SLICE bytes; a longer text comes in pieces that overlap by an n-gram."""
    for lo, hi in slices(offsets, SLICE):
        part = data[offsets[lo] : offsets[hi]]
        if len(part) <= 2 * SLICE:
            yield lo, *characters(part, offsets[lo : hi + 1])
            continue
        start = 0
        while start < len(part):
            end = min(start + SLICE, len(part))
            while end < len(part) and (part[end] & 0xC0) == 0x80:
                end += 1
            back = max(start - 4 * MOST, 0)
            while back > 0 and (part[back] & 0xC0) == 0x80:
                back -= 1
            chars, _ = characters(part[back:end], np.array([0, end - back]))
            # The space around a text belongs to its ends alone, not to an inner cut.
            chars = chars[back > 0 : len(chars) - (end < len(part))]
            yield lo, chars, np.array([0, len(chars)])
            start = end


def ngrams(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, text of each n-gram, place of each n-gram) for some texts at a time, repeats included."""
    data, offsets = texts(column)
    for lo, chars, ends in _pieces(data, offsets):
        size = np.diff(ends)
        of = np.repeat(np.arange(len(size)), size) + lo
        left = np.repeat(ends[1:], size) - np.arange(len(chars))
        single = h = mix((chars.astype(np.uint64) + np.uint64(1)) * _STEP)
        for k in range(2, MOST + 1):
            h = mix(h[: max(len(chars) - k + 1, 0)] * _STEP + single[k - 1 :])
            if k >= LEAST:
                full = left[: len(h)] >= k
                yield lo, of[: len(h)][full], (h[full] >> np.uint64(64 - BITS)).astype(np.int64)


@dataclass
class Model:
    """``base`` + the weights of a text's places is the logit. ``slot`` leads from a place to its weight, or to -1."""

    base: float
    slot: np.ndarray
    weight: np.ndarray


def _slot_table(places: np.ndarray) -> np.ndarray:
    slot = np.full(1 << BITS, -1, np.int32)
    slot[places] = np.arange(len(places), dtype=np.int32)
    return slot


def slots(column: pa.Array, slot: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, slot) of each text's kept places, every pair once, sorted."""
    found = []
    for _, of, place in ngrams(column):
        s = slot[place]
        kept = s >= 0
        found.append(np.unique(of[kept] * width + s[kept]))
    pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return pairs // max(width, 1), pairs % max(width, 1)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of each class by place, of all a task reads; place -1 counts the texts."""
    total = np.zeros((2, 1 << BITS), np.int64)
    classes = np.zeros(2, np.int64)
    for batch in batches:
        label = batch.column("_label").to_numpy(zero_copy_only=False)
        classes += np.bincount(label, minlength=2)
        found: dict[int, list[np.ndarray]] = {}
        for lo, of, place in ngrams(batch.column("_text")):
            found.setdefault(lo, []).append(np.unique(of << BITS | place))
        # A text may come in pieces and in n-grams of several lengths; each place counts once.
        for parts in found.values():
            pairs = np.unique(np.concatenate(parts))
            y = label[pairs >> BITS]
            for c in (0, 1):
                total[c] += np.bincount(pairs[y == c] & ((1 << BITS) - 1), minlength=1 << BITS)
    at = np.flatnonzero(total.sum(0))
    place = np.append(at, -1)
    yield pa.RecordBatch.from_arrays(
        [pa.array(place), pa.array(np.append(total[1, at], classes[1])), pa.array(np.append(total[0, at], classes[0]))],
        names=["place", "toxic", "other"],
    )


def _slot_lists(slot: np.ndarray, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, s = slots(batch.column("_text"), slot, width)
            ends = np.searchsorted(of, np.arange(batch.num_rows + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(s.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("_order"), batch.column("_label"), lists], names=["_order", "_label", "slots"])

    return run


def held_out(id_col: str) -> Column:
    """Whether a row is kept from learning, by the checksum of its id's text form."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS == HELD, F.lit(False))


def learning_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, limit: int) -> DataFrame:
    """(_label, _text, _order): at most ``limit`` labelled rows that are not held out, those with the least hash of their id.

    Labels other than 0 and 1, NULL ids and ids without a document are passed over. An id with both labels is learnt with
    each; an id with several texts is learnt with one of them, that of the least hash, so the bound holds for rows too.
    """
    sample = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col))
    sample = sample.select(F.col(id_col).alias("_sid"), F.col(label_col).cast("int").alias("_label")).distinct()
    sample = sample.orderBy(F.xxhash64("_sid"), "_sid", "_label").limit(limit)
    # The sample's bound is proven, so it may be sent to every task.
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(sample), F.col("_id") == F.col("_sid"))
    one = rows.groupBy("_sid", "_label").agg(F.min(F.struct(F.xxhash64("_text").alias("h"), F.col("_text").alias("text"))).alias("_one"))
    return one.select("_label", F.col("_one.text").alias("_text"), F.xxhash64("_sid").alias("_order"))


def ratios(toxic: np.ndarray, other: np.ndarray, n_toxic: int, n_other: int) -> np.ndarray:
    """Naive Bayes log-count ratios of places: log of the smoothed share of toxic texts over that of other texts."""
    return np.log((toxic + SMOOTH) / (n_toxic + 2 * SMOOTH)) - np.log((other + SMOOTH) / (n_other + 2 * SMOOTH))


def fit(of: np.ndarray, s: np.ndarray, y: np.ndarray, ratio: np.ndarray) -> tuple[float, np.ndarray]:
    """(base, weights) of the logistic regression over places worth their ratio, by accelerated gradient steps.

    ``of``/``s`` are the (row, slot) pairs, sorted by row. Both classes weigh the same, however rare one is. The penalty
    holds the weights, not the base.
    """
    n, width = len(y), len(ratio)
    value = ratio[s]
    share = np.where(y > 0, 0.5 / y.sum(), 0.5 / (n - y.sum()))

    def forward(v: np.ndarray) -> np.ndarray:
        return np.bincount(of, weights=v[s] * value, minlength=n)

    def backward(g: np.ndarray) -> np.ndarray:
        return np.bincount(s, weights=g[of] * value, minlength=width)

    # The step: the largest curvature, by power iteration over the weights and the base together.
    probe, bias, curve = np.ones(width), 1.0, 1.0
    for _ in range(20):
        g = (forward(probe) + bias) * share
        probe, bias = backward(g), g.sum()
        curve = float(np.sqrt(probe @ probe + bias * bias))
        probe, bias = probe / max(curve, 1e-12), bias / max(curve, 1e-12)
    step = 1.0 / (1.1 * 0.25 * curve + PENALTY)
    w, base = np.zeros(width), 0.0
    w2, base2, pace = w, base, 1.0
    for _ in range(STEPS):
        g = (1 / (1 + np.exp(-np.clip(forward(w2) + base2, -30, 30))) - y) * share
        after, base_after = w2 - step * (backward(g) + PENALTY * w2), base2 - step * g.sum()
        pace_after = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        speed = (pace - 1) / pace_after
        w2, base2 = after + speed * (after - w), base_after + speed * (base_after - base)
        w, base, pace = after, base_after, pace_after
    return float(base), w * ratio


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", limit: int = TRAIN_ROWS) -> Model:
    """Learn from at most ``limit`` labelled rows (``learning_rows``); only their texts go in.

    To the driver come at most FEATURES places with their counts, and of each learning row the kept places it holds.
    """
    rows = stage(learning_rows(docs, labels, id_col, text_col, label_col, limit), "learn")
    counts = rows.select("_label", "_text").mapInArrow(_counts, "place long, toxic long, other long")
    counts = stage(counts.groupBy("place").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other")), "places")
    totals = counts.where("place = -1").first()
    n1, n0 = (int(totals["toxic"]), int(totals["other"])) if totals else (0, 0)
    none = np.full(1 << BITS, -1, np.int32)
    if not n1 or not n0:
        rate = (n1 + 0.5) / (n1 + n0 + 1.0)
        return Model(float(np.log(rate / (1 - rate))), none, np.zeros(1))
    # Chi-square of the two-by-two table (has the place, is toxic).
    a, b = F.col("toxic").cast("double"), F.col("other").cast("double")
    cross = a * (F.lit(n0) - b) - b * (F.lit(n1) - a)
    chance = (a + b) * (F.lit(n1 + n0) - a - b)
    chi = F.when(chance > 0, cross * cross / chance).otherwise(0.0)
    best = counts.where("place >= 0").orderBy(chi.desc(), "place").limit(FEATURES).toArrow()
    place = best.column("place").to_numpy()
    ratio = ratios(best.column("toxic").to_numpy(), best.column("other").to_numpy(), n1, n0)
    slot = _slot_table(place)
    got = rows.mapInArrow(_slot_lists(slot, len(place)), "_order long, _label int, slots array<int>")
    # The order of the rows decides the last bits of sums, so it is fixed.
    table = got.orderBy("_order", "_label", F.hash("slots")).toArrow()
    lists = table.column("slots").combine_chunks()
    size = np.diff(lists.offsets.to_numpy())
    of = np.repeat(np.arange(len(size)), size)
    base, weight = fit(of, lists.flatten().to_numpy().astype(np.int64), table.column("_label").to_numpy().astype(float), ratio)
    return Model(base, slot, weight)


def logits(model: Model, column: pa.Array) -> np.ndarray:
    of, s = slots(column, model.slot, len(model.weight))
    return model.base + np.bincount(of, weights=model.weight[s], minlength=len(column))


def _scored(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = 1 / (1 + np.exp(-np.clip(logits(model, batch.column("_text")), -30, 30)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in KEY), pa.array(score)], names=[*KEY, "score"])

    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, _th, score) of every row: 0 to 1, higher is likelier toxic."""
    id_type = docs.schema[id_col].dataType.simpleString()
    return keyed(docs, id_col, text_col).mapInArrow(_scored(model), f"_id {id_type}, _th long, score double")
