"""Best-fit packing of token sequences, bulk-synchronous.

Documents are cut into pieces of at most ``capacity`` tokens. Rounds go through the piece lengths from long to
short; in a round all pieces of a length look for their successor, the smallest gap that holds them. Pieces of
one length, and gaps of one size, are interchangeable, so both are kept as sorted runs (size, count): a sweep
matches whole runs, the k-th piece by rank takes the k-th gap, and gaps shrink by the length for the next sweep
of the round. What is swept is thus a table of at most ``capacity`` lengths, however many documents there are;
the rows themselves are ranked inside their length, in salted parts, and look their place up by rank.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from curate.llm.tokens import encoder
from curate.operators.skew import join_unique
from curate.storage import stage

CAPACITY = 2048
#: Pieces per rank window, about.
WINDOW_ROWS = 200_000
SLICE = 4 << 20


def _cut(vocabulary: str, end_id: int, capacity: int):
    """The pieces of every text."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        for batch in batches:
            column, lo = batch.column("text"), 0
            while lo < len(batch):
                hi, weight, texts = lo, 0, []
                while hi < len(batch) and (weight < SLICE or hi == lo):
                    texts.append(column[hi].as_py())
                    weight += len(texts[-1] or "")
                    hi += 1
                row, piece, length, crc = [], [], [], []
                for i, ids in enumerate(encode.ids(texts)):
                    raw = memoryview(ids + end)
                    for k, a in enumerate(range(0, len(raw), 4 * capacity)):
                        part = raw[a : a + 4 * capacity]
                        row.append(lo + i)
                        piece.append(k)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(pa.array(row, pa.int64())),
                        pa.array(piece, pa.int32()),
                        pa.array(np.array(piece, np.int64) * capacity),
                        pa.array(length, pa.int64()),
                        pa.array(crc, pa.int64()),
                    ],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )
                lo = hi

    return run


def pieces(docs: DataFrame, vocabulary: str, end_id: int, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): every text's ids and the end id, cut only where longer than the capacity."""
    id_type = docs.schema[id_col].dataType.simpleString()
    shape = f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long"
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_cut(vocabulary, end_id, capacity), shape)


class Runs:
    """Gaps by size: each size has runs (first sequence, how many); all sequences of a size are filled equally far, runs of one size are taken last in, first out."""

    def __init__(self, capacity: int):
        self.capacity, self.sizes, self.runs, self.opened = capacity, [], {}, 0

    def add(self, size: int, run: tuple[int, int]) -> None:
        if size == 0:
            return
        if size not in self.runs:
            bisect.insort(self.sizes, size)
            self.runs[size] = []
        self.runs[size].append(run)

    def successor(self, length: int) -> int | None:
        i = bisect.bisect_left(self.sizes, length)
        return self.sizes[i] if i < len(self.sizes) else None

    def take(self, size: int, n: int) -> list[tuple[int, int]]:
        """Up to n sequences with a gap of ``size``."""
        out, runs = [], self.runs[size]
        while n and runs:
            first, count = runs.pop()
            if count > n:
                runs.append((first + n, count - n))
                count = n
            out.append((first, count))
            n -= count
        if not runs:
            del self.runs[size]
            self.sizes.remove(size)
        return out


def match(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int]]:
    """(length, first rank, first sequence, offset) of each matched run of pieces, from the number of pieces by length.

    Round by round from the longest: pieces sweep over their successor gaps; when no gap is left that holds the
    length, new sequences are opened. A gap that took a piece and still holds the length is the next piece's successor, so
    each sequence is filled before the next one: all but the last of a sweep alike, as one run, the last one by itself.
    """
    gaps, out = Runs(capacity), []
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]

        def fill(size: int, first: int, n: int, pieces: int, length=length) -> None:
            nonlocal rank, left
            for k in range(pieces):
                out.append((length, rank, first, capacity - size + k * length))
                rank, left = rank + n, left - n
            gaps.add(size - pieces * length, (first, n))

        while left:
            size = gaps.successor(length)
            if size is None:
                fresh = -(-left // (capacity // length))
                gaps.add(capacity, (gaps.opened, fresh))
                gaps.opened += fresh
                size = capacity
            each = size // length
            for first, n in gaps.take(size, left // each):
                fill(size, first, n, each)
            if 0 < left < each and size in gaps.runs:
                (first, _), = gaps.take(size, 1)
                fill(size, first, 1, left)
    return out


def _place(table: np.ndarray):
    """Look each piece's run up by (length, rank)."""
    lengths, ranks, first, offset = table
    order = np.lexsort((ranks, lengths))
    lengths, ranks, first, offset = lengths[order], ranks[order], first[order], offset[order]
    sizes, starts = np.unique(lengths, return_index=True)
    stops = np.append(starts[1:], len(lengths))[: len(starts)]
    span = {int(x): (int(a), int(b)) for x, a, b in zip(sizes, starts, stops, strict=True)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.zeros(len(batch), np.int64)
            for x in np.unique(length):
                mine = length == x
                a, b = span[int(x)]
                at[mine] = a + np.searchsorted(ranks[a:b], rank[mine], "right") - 1
            columns = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(first[at] + rank - ranks[at]), pa.array(offset[at])],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return run


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Place pieces (doc_id, piece, start, length, ids_crc32) with lengths 1..capacity in sequences of ``capacity`` tokens.

    Adds sequence_id and offset; a sequence's pieces lie side by side from 0. Best fit by falling length: no piece
    could have gone into a smaller gap when its round came. Equal rows (repeated documents) are placed once each; which
    of them gets which of their places is open. An empty table gives no row. The pieces are staged once in the shared
    folder; only the table of counts by length (at most ``capacity`` rows) comes to the driver, and the table of runs
    (its size depends on the capacity, not on the rows) goes to the tasks.
    """
    id_type = cut.schema["doc_id"].dataType.simpleString()
    cut = stage(cut, "pieces")
    counts = {int(r["length"]): int(r["n"]) for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    table = np.array(match(counts, capacity), np.int64).reshape(-1, 4).T
    salts = max(1, sum(counts.values()) // WINDOW_ROWS + 1) * 8
    rows = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    sizes = rows.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = rows.withColumn("nth", F.row_number().over(inside))
    ranked = join_unique(ranked, base, ["length", "salt"], "inner").withColumn("rank", F.col("base") + F.col("nth") - 1)
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    shape = f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.mapInArrow(_place(table), shape)
