"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature of a text is cut into bins; boosting goes round the features in turn and fits a shallow tree to the
gradient of one feature's bins at a time, adding its leaf values to that feature's lookup table. Then the pairs of
features that explain most of what is left get tables of their own in the same way. A score is the sum of one
table entry per feature and pair, so scoring is a few vectorised additions per batch and every part of a score
can be read off.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curate.llm.keys import KEY, keyed, only
from curate.llm.words import PLAIN, SLICE, Words, mix, slices, texts, windows

#: Labelled rows that are learnt from, at most: the least hashes of the id, of all rows that may be learnt from.
TRAIN_ROWS = 20_000
#: One document in so many is held out, by the checksum of its id.
FOLDS = 5
THRESHOLD = 0.3
BINS = 32
ROUNDS = 150
PAIR_ROUNDS = 60
PAIRS = 6
RATE = 0.15
LEAST_LEAF = 20

_B = np.arange(256)
_CLASSES = {
    "upper": (_B >= 65) & (_B <= 90),
    "lower": (_B >= 97) & (_B <= 122),
    "digit": (_B >= 48) & (_B <= 57),
    "high": _B >= 0xC0,  # first bytes of characters beyond ASCII
    "tail": (_B >= 0x80) & (_B < 0xC0),
    "space": ~PLAIN,
    "line": _B == 10,
    "stop": np.isin(_B, list(b".!?")),
    "comma": np.isin(_B, list(b",;:")),
    "symbol": np.isin(_B, list(b"#*$%&|<>")),
    "other": np.isin(_B, list(b"\"'()+-/=@[\\]^_`{}~")),
}
#: Classes that share no byte, counted in one go; 15 is everything else.
_KINDS = ["upper", "digit", "high", "tail", "stop", "comma", "symbol", "other"]
_KIND = np.full(256, 15, np.int64)
for _i, _name in enumerate(_KINDS):
    _KIND[_CLASSES[_name]] = _i
FEATURES = [
    "words", "word_length", "long_words", "one_letter", "distinct", "distinct_short", "top_word", "next_same", "repeat_2", "repeat_5",
    "upper", "digit", "high", "stop", "comma", "symbol", "other", "symbol_words", "capital_words", "line_words",
    "line_count", "repeat_line", "stop_words", "longest",
]


def _runs(keys: np.ndarray, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text: distinct keys, rows whose key occurs twice or more, and the most frequent key's rows."""
    distinct, repeated, top = np.zeros(n), np.zeros(n), np.zeros(n)
    if len(keys) == 0:
        return distinct, repeated, top
    # Text and hash in one number, so a plain sort will do; over 40 bits of the hash are left inside a text.
    shift = np.uint64(64 - max(n - 1, 1).bit_length())
    both = np.sort((of.astype(np.uint64) << shift) | (keys >> (np.uint64(64) - shift)))
    start = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]]))
    size = np.diff(np.append(start, len(both)))
    owner = (both[start] >> shift).astype(np.int64)
    distinct += np.bincount(owner, minlength=n)
    repeated += np.bincount(owner, weights=np.where(size > 1, size, 0), minlength=n)
    first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    top[owner[first]] = np.maximum.reduceat(size, first)
    return distinct, repeated, top


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row per text, a column per FEATURES; shares and logarithms, 0 where there is nothing to count."""
    n = len(offsets) - 1
    offsets = offsets - offsets[0]
    words = Words(data, offsets, PLAIN, False)
    h, of = words.hashes(), words.text_of()
    count = words.count.astype(float)
    some = np.maximum(count, 1)

    def so_far(name: str) -> np.ndarray:
        total = np.zeros(len(data) + 1, np.int32)
        np.cumsum(_CLASSES[name][data], out=total[1:])
        return total

    owner = np.repeat(np.arange(n, dtype=np.int64) * 16, np.diff(offsets))
    kinds = np.bincount(owner + _KIND[data], minlength=16 * n).reshape(n, 16).astype(float)
    sums = {name: kinds[:, i] for i, name in enumerate(_KINDS)}
    tails, symbols, breaks = so_far("tail"), so_far("symbol"), so_far("line")
    chars = np.maximum(np.diff(offsets) - sums["tail"], 1)
    length = (words.end - words.start) - (tails[words.end] - tails[words.start])
    by_word = lambda x: np.bincount(of, weights=x, minlength=n)
    distinct, _, top = _runs(h, of, n)
    short = length <= 4
    distinct_short, _, _ = _runs(h[short], of[short], n)
    same = np.zeros(len(h))
    same[1:] = (h[1:] == h[:-1]) & (of[1:] == of[:-1])
    repeats = {}
    for k in (2, 5):
        full = words.left() >= k
        _, repeats[k], _ = _runs(windows(h, k)[full], of[full], n)
    # Lines: hash of a line is the sum of its words' hashes by place; its words are those after the last break.
    line = breaks[words.start]
    first = np.ones(len(h), bool)
    first[1:] = (line[1:] != line[:-1]) | (of[1:] != of[:-1])
    at = np.flatnonzero(first)
    if len(at):
        place = (np.arange(len(h)) - np.repeat(at, np.diff(np.append(at, len(h))))).astype(np.uint64)
        line_hash = np.add.reduceat(mix(h + place), at)
        line_distinct, _, _ = _runs(line_hash, of[at], n)
        lines = np.bincount(of[at], minlength=n).astype(float)
    else:
        line_distinct = lines = np.zeros(n)
    longest = np.zeros(n)
    filled = np.flatnonzero(words.count)
    if len(filled):
        longest[filled] = np.maximum.reduceat(length, words.first[filled])
    letter = data[words.start] if len(h) else np.zeros(0, np.uint8)
    ending = data[words.end - 1] if len(h) else np.zeros(0, np.uint8)
    columns = [
        np.log1p(count),
        by_word(length) / some,
        by_word(length > 12) / some,
        by_word(length == 1) / some,
        distinct / some,
        distinct_short / np.maximum(by_word(short), 1),
        top / some,
        by_word(same) / some,
        repeats[2] / some,
        repeats[5] / some,
        sums["upper"] / chars,
        sums["digit"] / chars,
        sums["high"] / chars,
        sums["stop"] / some,
        sums["comma"] / some,
        sums["symbol"] / chars,
        sums["other"] / chars,
        by_word(symbols[words.end] > symbols[words.start]) / some,
        by_word(_CLASSES["upper"][letter]) / some,
        count / np.maximum(lines, 1),
        np.log1p(lines),
        (lines - line_distinct) / np.maximum(lines, 1),
        by_word(_CLASSES["stop"][ending]) / some,
        np.log1p(longest),
    ]
    return np.stack(columns, axis=1)


@dataclass
class Model:
    """Bin borders and tables: ``base`` + the tables' entries is the logit."""

    base: float
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    grids: list[np.ndarray]

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], "right") for j, c in enumerate(self.cuts)], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        logit = np.full(len(x), self.base)
        for j, table in enumerate(self.tables):
            logit += table[b[:, j]]
        for (i, j), grid in zip(self.pairs, self.grids, strict=True):
            logit += grid[b[:, i], b[:, j]]
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + 1.0)


def _split(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> int | None:
    """The best cut of a row of bins (before the returned one), or None."""
    cg, ch, cn = np.cumsum(g)[:-1], np.cumsum(h)[:-1], np.cumsum(n)[:-1]
    if not len(cg):
        return None
    total = n.sum()
    gain = _gain(cg, ch) + _gain(g.sum() - cg, h.sum() - ch) - _gain(g.sum(), h.sum())
    gain[(cn < LEAST_LEAF) | (total - cn < LEAST_LEAF)] = -1
    best = int(np.argmax(gain))
    return best + 1 if gain[best] > 1e-9 else None


def _leaves(g: np.ndarray, h: np.ndarray, n: np.ndarray, depth: int) -> np.ndarray:
    """A shallow tree over a row of bins: the leaf value of each bin."""
    cut = _split(g, h, n) if depth else None
    if cut is None:
        return np.full(len(g), g.sum() / (h.sum() + 1.0))
    return np.concatenate([_leaves(g[:cut], h[:cut], n[:cut], depth - 1), _leaves(g[cut:], h[cut:], n[cut:], depth - 1)])


def _grid(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, float]:
    """A tree of one cut along one axis and one along the other on each side: values and gain."""
    best = (np.zeros_like(g), 0.0)
    for flip in (False, True):
        gg, hh, nn = (x.T if flip else x for x in (g, h, n))
        cut = _split(gg.sum(1), hh.sum(1), nn.sum(1))
        if cut is None:
            continue
        out, gain = np.zeros_like(gg), 0.0
        for side in (slice(None, cut), slice(cut, None)):
            a, b, c = gg[side].sum(0), hh[side].sum(0), nn[side].sum(0)
            values = _leaves(a, b, c, 1)
            out[side] = values
            gain += float((values * a - values * values * b / 2).sum())
        if gain > best[1]:
            best = (out.T if flip else out, gain)
    return best


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Learn the tables from features and 0/1 labels. Without rows or with one class only the prior remains."""
    n, d = x.shape
    rate = (y.sum() + 0.5) / (n + 1.0)
    base = float(np.log(rate / (1 - rate)))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) if n else np.zeros(0) for j in range(d)]
    model = Model(base, cuts, [np.zeros(len(c) + 1) for c in cuts], [], [])
    if n == 0 or y.min() == y.max():
        return model
    b = model.bins(x)
    sizes = [len(c) + 1 for c in cuts]
    logit = np.full(n, base)
    totals = [np.bincount(b[:, j], minlength=sizes[j]) for j in range(d)]

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for j in range(d):
            g, h = slopes()
            gg = np.bincount(b[:, j], weights=g, minlength=sizes[j])
            hh = np.bincount(b[:, j], weights=h, minlength=sizes[j])
            step = RATE * _leaves(gg, hh, totals[j], 2)
            model.tables[j] += step
            logit += step[b[:, j]]

    def grid(i: int, j: int, w: np.ndarray | None) -> np.ndarray:
        flat = np.bincount(b[:, i] * sizes[j] + b[:, j], weights=w, minlength=sizes[i] * sizes[j])
        return flat.reshape(sizes[i], sizes[j])

    g, h = slopes()
    gains = [(_grid(grid(i, j, g), grid(i, j, h), grid(i, j, None))[1], i, j) for i in range(d) for j in range(i + 1, d)]
    model.pairs = [(i, j) for gain, i, j in sorted(gains, key=lambda t: (-t[0], t[1:]))[:PAIRS] if gain > 0]
    model.grids = [np.zeros((sizes[i], sizes[j])) for i, j in model.pairs]
    counts = [grid(i, j, None) for i, j in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for k, (i, j) in enumerate(model.pairs):
            g, h = slopes()
            step = RATE * _grid(grid(i, j, g), grid(i, j, h), counts[k])[0]
            model.grids[k] += step
            logit += step[b[:, i], b[:, j]]
    return model


def _featured(more: list[str], score: Model | None):
    """The features of every text, or its score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = texts(batch.column("_text"))
            for lo, hi in slices(offsets, SLICE):
                x = features(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1])
                if score is None:
                    flat = pa.array(x.ravel())
                    out = pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1, dtype=np.int32) * x.shape[1]), flat)
                else:
                    out = pa.array(score.score(x))
                kept = [batch.column(c).slice(lo, hi - lo) for c in more]
                yield pa.RecordBatch.from_arrays([*kept, out], names=[*more, "out"])

    return run


def held_out(id_col: str) -> Column:
    """Whether a row is kept from learning: one id in FOLDS, by the checksum of its text form."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", limit: int = TRAIN_ROWS) -> Model:
    """Fit on at most ``limit`` labelled rows that are not held out, those with the least hash of their id.

    Only the text's features go in. Labels other than 0 and 1, NULL ids and ids without a document are passed over; an id
    with several labels is learnt with each. The labelled sample has a proven bound and is broadcast; its feature rows
    (``limit`` rows of two dozen numbers, times the rows that share an id) come to the driver.
    """
    sample = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col))
    sample = sample.select(F.col(id_col).alias("_sid"), F.col(label_col).cast("int").alias("_label"))
    sample = sample.orderBy(F.xxhash64("_sid"), "_sid", "_label").limit(limit)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(sample), F.col("_id") == F.col("_sid"))
    id_type = docs.schema[id_col].dataType.simpleString()
    got = rows.select("_id", "_label", "_text").mapInArrow(_featured(["_id", "_label"], None), f"_id {id_type}, _label int, out array<double>")
    # The order of the rows decides the last bits of sums, so it is fixed.
    table = got.orderBy(F.xxhash64("_id"), "_id", "_label", "out").limit(2 * limit).toArrow()
    x = np.array(table.column("out").to_pylist(), float).reshape(-1, len(FEATURES))
    return fit(x, np.array(table.column("_label").to_pylist(), float))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, _th, score) of every row: 0 to 1, higher is likelier good. NULL and empty texts are scored as texts without words."""
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = keyed(docs, id_col, text_col)
    return rows.mapInArrow(_featured(KEY, model), f"_id {id_type}, _th long, out double").withColumnRenamed("out", "score")


def accepted(docs: DataFrame, model: Model, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` scored at least ``threshold``, all their columns. Rows of equal id and text share a score."""
    bad = score(docs, model, id_col, text_col).where(F.col("score") < threshold).select(*KEY).distinct()
    return only(docs, bad, False, id_col, text_col)
