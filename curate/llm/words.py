"""Words and word windows of whole Arrow batches as numpy arrays: no Python loop runs over words.

A batch of texts is one byte buffer with one offset per text. A word is a maximal run of word bytes inside
a text; both word rules of the operators are rules on ASCII bytes (every byte from 0x80 on belongs to a
word), so bytes and code points give the same words. Hashes are 64-bit and seeded by fixed constants, so
tasks on different machines agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once: temporary arrays take about 60 bytes per byte of text.
SLICE = 1 << 21

_BYTES = np.arange(256)
#: Words without ASCII white space, as they stand.
PLAIN = ~np.isin(_BYTES, [0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])
#: Letters and digits after ASCII lower-casing; everything above ASCII counts as a letter.
FOLDED = np.isin(_BYTES, [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])

_LOWER = np.where((_BYTES >= 0x41) & (_BYTES <= 0x5A), _BYTES + 32, _BYTES).astype(np.uint8)
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_POWERS: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over the 64 bits (a finalizer of public hash functions)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS["up"]) <= n:
        for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
            steps = np.full(max(n + 1, SLICE + 1), base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; NULL is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("") if column.null_count else column
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes; a longer text is a range of its own."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi
        lo = hi


class Words:
    """Words of some texts: ``start``/``end`` byte places, ``first`` word of each text (one entry more)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, rule: np.ndarray, lower: bool):
        offsets = offsets - offsets[0]
        self.data = _LOWER[data] if lower else data
        n = len(data)
        inside = np.zeros(n + 1, bool)
        inside[:n] = rule[self.data]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        before = np.zeros(n + 1, bool)
        before[1:] = inside[:n]
        # A word starts where the byte before is outside or belongs to another text, and ends likewise.
        self.start = np.flatnonzero(inside & (edge | ~before))
        self.end = np.flatnonzero(before & (edge | ~inside))
        self.offsets = offsets
        self.first = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """One hash per word."""
        n = len(self.data)
        up, down = _powers(n)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
        h = (total[self.end] - total[self.start]) * down[self.start]
        return mix(h + (self.end - self.start).astype(np.uint64) * _STEP)

    def left(self) -> np.ndarray:
        """Words from each word to the end of its text, itself included."""
        ends = np.repeat(self.first[1:], self.count)
        return ends - np.arange(len(self.start))

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.count)), self.count)

    def string(self, a: int, b: int) -> bytes:
        """Words a to b (exclusive) joined by one space."""
        raw = self.data
        return b" ".join([raw[s:e].tobytes() for s, e in zip(self.start[a:b], self.end[a:b], strict=True)])


def pieces(data: np.ndarray, offsets: np.ndarray, rule: np.ndarray, lower: bool, limit: int = SLICE) -> Iterator[tuple[int, Words]]:
    """(first text, its words) of about ``limit`` bytes at a time. A longer text comes in several pieces, cut between words."""
    for lo, hi in slices(offsets, limit):
        part, ends = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1]
        if hi - lo > 1 or len(part) <= limit:
            yield lo, Words(part, ends, rule, lower)
            continue
        start = 0
        while start < len(part):
            end = min(start + limit, len(part))
            # To the end of the word that stands there; words are short beside the limit, so a few bytes at a time will do.
            while end < len(part):
                gap = np.flatnonzero(~rule[_LOWER[part[end : end + 4096]] if lower else part[end : end + 4096]])
                if len(gap):
                    end += int(gap[0])
                    break
                end = min(end + 4096, len(part))
            yield lo, Words(part[start:end], np.array([0, end - start]), rule, lower)
            start = end


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k entries from each place on, built by doubling; places without k entries after them hold junk."""

    def join(a: np.ndarray, b: np.ndarray, shift: int) -> np.ndarray:
        out = a * _STEP
        out[: len(a) - shift] += b[shift:]
        return mix(out)

    if len(h) == 0 or k > len(h):
        return np.zeros(len(h), np.uint64)
    done, size = None, 0
    power, width = h, 1
    while True:
        if k & width:
            done = power if done is None else join(done, power, size)
            size += width
        width *= 2
        if width > k:
            return done
        power = join(power, power, width // 2)


def _slide(x: np.ndarray, w: int, pick, fill) -> np.ndarray:
    """pick over the w entries from each place on; beyond the end counts as ``fill``."""
    width = 1
    while width * 2 <= w:
        y = np.full(len(x), fill, x.dtype)
        y[: max(len(x) - width, 0)] = x[width:]
        x, width = pick(x, y), width * 2
    rest = w - width
    if rest:
        y = np.full(len(x), fill, x.dtype)
        y[: max(len(x) - rest, 0)] = x[rest:]
        x = pick(x, y)
    return x


def winnow(h: np.ndarray, left: np.ndarray, k: int, span: int) -> np.ndarray:
    """Places of the k-word windows that are least among the windows inside some ``span`` consecutive words of one text.

    ``h`` holds the hash of the k words from each place on. Equal spans choose the same windows, so any
    two equal spans share a chosen window at the same distance from their start. Ties are all chosen.
    """
    if len(h) == 0:
        return np.zeros(0, np.int64)
    w = span - k + 1
    least = np.where(left >= span, _slide(h, w, np.minimum, np.uint64(0xFFFFFFFFFFFFFFFF)), np.uint64(0))
    best = _slide(least[::-1], w, np.maximum, np.uint64(0))[::-1]
    return np.flatnonzero((best == h) & (best > 0) & (left >= k))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
