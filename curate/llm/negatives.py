"""Hard-negative mining over Hilbert-ordered blocks with zone maps.

Rows are cut to whole-number vectors, put in the order of a Hilbert curve over all dimensions and written as Parquet blocks of
``BLOCK`` rows, each with the least and largest value per dimension (its zone map), its labels and its least id. Anchors
are rows too, and go in groups of neighbours on the curve.

A search asks, for windows of scores of an anchor, for the first rows of its own or of other labels. Interval arithmetic over a
zone map bounds the inner product of the anchor with every row of a block from both sides, so a block is read for an anchor
only if its bounds meet a window. First the blocks with the highest bounds are read; the kth score found there raises the
lower end of each window, and then every block that can still hold a better row is read. The result is exact. Positives
are one search (own label, no window), hard negatives a second one (other labels, one window per positive).

Anchors against zone maps is a stated query set against all rows in blocks; everything joins by number.

Odd rows: rows with a NULL label, a NULL vector or a NULL or non-finite component take no part; missing last components
of a shorter vector are 0; a NULL id is no anchor and comes last among equal scores; rows of equal id are different rows,
also as anchors; without rows or anchors the result is empty. Components are held as whole numbers up to 2^27 (values up to
half a million; beyond they stay at that end). Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curate.operators.ranking import top_per_group
from curate.storage import stage

#: Rows of a block, anchors of a group, and zone maps that are compared with a group at once.
BLOCK = 256
GROUP = 64
ZONES = 512
#: Blocks per anchor and shelf of zone maps that are read first.
SEEDS = 2
SCALE = 256
EVERY = 100
POSITIVES = NEGATIVES = 5
#: A hard negative scores at least LOW and at most HIGH hundredths of the positive's score.
LOW, HIGH = 80, 100
#: Bits of a Hilbert key, shared out over the dimensions; each gets one at least.
KEY_BITS = 128
EDGE = 1 << 27
_PART_BITS = 33
_FAR = 1 << 62


def quantised(column: pa.Array, width: int) -> np.ndarray:
    """floor(SCALE * x) of every component as rows of ``width`` whole numbers."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = np.floor(SCALE * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    size = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(size), width), np.int32)
    row = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    out[row, place] = np.clip(flat, -EDGE, EDGE)
    return out


def hilbert(cells: np.ndarray, bits: int) -> list[bytes]:
    """Place of each row of cells (0 to 2^bits - 1 per dimension) on the Hilbert curve, as bytes that sort like the curve.

    The axes are turned and mirrored level by level from the coarsest on, then Gray-decoded (Skilling's transpose form).
    """
    x = cells.astype(np.uint32).T.copy()
    d = len(x)
    for level in range(bits - 1, 0, -1):
        low = np.uint32((1 << level) - 1)
        for i in range(d):
            upper = (x[i] >> np.uint32(level)) & np.uint32(1)
            swap = np.where(upper == 1, np.uint32(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(upper == 1, low, swap)
            x[i] ^= swap
    for i in range(1, d):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], np.uint32)
    for level in range(bits - 1, 0, -1):
        turn ^= np.where((x[d - 1] >> np.uint32(level)) & np.uint32(1) == 1, np.uint32((1 << level) - 1), np.uint32(0))
    x ^= turn
    planes = [(x >> np.uint32(level)) & np.uint32(1) for level in range(bits - 1, -1, -1)]
    packed = np.packbits(np.concatenate(planes).T.astype(np.uint8), axis=1)
    return [row.tobytes() for row in packed]


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(dim, lo, hi) of what a task reads."""
    lo, hi = np.zeros(0, np.int32), np.zeros(0, np.int32)
    seen = 0
    for batch in batches:
        column = batch.column("vector")
        if not len(column):
            continue
        width = max(len(lo), int(np.diff(column.offsets.to_numpy()).max(initial=0)))
        q = quantised(column, width)
        grown = [np.pad(x, (0, width - len(x))) for x in (lo, hi)]
        lo, hi = (q.min(0), q.max(0)) if not seen else (np.minimum(grown[0], q.min(0)), np.maximum(grown[1], q.max(0)))
        seen += len(q)
    if seen:
        # Dimension -1 tells that there are rows, also if none has a component.
        cols = [np.append(np.arange(len(lo)), -1), np.append(lo, 0), np.append(hi, 0)]
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols], names=["dim", "lo", "hi"])


def _keys(lo: np.ndarray, hi: np.ndarray, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = quantised(batch.column("vector"), len(lo))
            cells = ((q - lo.astype(np.int64)) << bits) // (hi.astype(np.int64) - lo + 1)
            raw = [row.tobytes() for row in q]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("label"), pa.array(hilbert(cells, bits), pa.binary()), pa.array(raw, pa.binary())],
                names=["id", "label", "key", "q"],
            )

    return run


def _matrix(raw: bytes, width: int) -> np.ndarray:
    return np.frombuffer(raw, np.int32).reshape(-1, width)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a times b transposed, exactly: by floating point where every sum stays below 2^53, else by whole numbers."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(a.shape[1], 1)
    if top < 2.0**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def bounds(a: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least, most) inner product of each row of ``a`` with anything between ``lo`` and ``hi`` of each zone."""
    plus, minus = np.maximum(a, 0), np.minimum(a, 0)
    return _product(plus, lo) + _product(minus, hi), _product(plus, hi) + _product(minus, lo)


def _packer(size: int, make):
    """Cut the rows of a task into runs of ``size`` and give ``make(number, rows)`` for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << _PART_BITS
        held, have = [], 0
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, size - have)
                batch = batch.slice(part.num_rows)
                held.append(part)
                have += part.num_rows
                if have == size:
                    yield make(number, pa.Table.from_batches(held))
                    number, held, have = number + 1, [], 0
        if have:
            yield make(number, pa.Table.from_batches(held))

    return run


def _block(width: int):
    def make(number: int, rows: pa.Table) -> pa.RecordBatch:
        raw = rows.column("q").to_pylist()
        q = _matrix(b"".join(raw), width)
        ids, labels = rows.column("id").to_pylist(), rows.column("label").to_pylist()
        known = [i for i in ids if i is not None]
        row = {
            "block": number, "ids": ids, "labels": labels, "q": b"".join(raw), "lo": q.min(0).astype(np.int32).tobytes(),
            "hi": q.max(0).astype(np.int32).tobytes(), "kinds": sorted(set(labels)), "least": min(known, default=None),
        }
        return pa.RecordBatch.from_pylist([row], _BLOCK_TYPE)

    return make


_LONGS = pa.list_(pa.int64())
_BLOCK_TYPE = pa.schema([("block", pa.int64()), ("ids", _LONGS), ("labels", _LONGS), ("q", pa.binary()), ("lo", pa.binary()), ("hi", pa.binary()), ("kinds", _LONGS), ("least", pa.int64())])
_BLOCK_SHAPE = "block long, ids array<long>, labels array<long>, q binary, lo binary, hi binary, kinds array<long>, least long"
_SHELF_TYPE = pa.schema([("shelf", pa.int64()), ("blocks", _LONGS), ("lo", pa.binary()), ("hi", pa.binary()), ("kinds", pa.list_(_LONGS)), ("least", _LONGS)])
_SHELF_SHAPE = "shelf long, blocks array<long>, lo binary, hi binary, kinds array<array<long>>, least array<long>"
_GROUP_TYPE = pa.schema([("group", pa.int64()), ("rids", _LONGS), ("ids", _LONGS), ("labels", _LONGS), ("q", pa.binary())])
_GROUP_SHAPE = "group long, rids array<long>, ids array<long>, labels array<long>, q binary"
_REQUEST_TYPE = pa.schema([("block", pa.int64()), ("rids", _LONGS), ("own", _LONGS), ("vectors", pa.binary()), ("at", _LONGS), ("w", _LONGS), ("floor", _LONGS), ("ceiling", _LONGS)])
_REQUEST_SHAPE = "block long, rids array<long>, own array<long>, vectors binary, at array<long>, w array<long>, floor array<long>, ceiling array<long>"


def _shelf(number: int, rows: pa.Table) -> pa.RecordBatch:
    row = {"shelf": number, "blocks": rows.column("block").to_pylist(), "kinds": rows.column("kinds").to_pylist(), "least": rows.column("least").to_pylist()}
    row |= {c: b"".join(rows.column(c).to_pylist()) for c in ("lo", "hi")}
    return pa.RecordBatch.from_pylist([row], _SHELF_TYPE)


def _group(number: int, rows: pa.Table) -> pa.RecordBatch:
    row = {"group": number, "rids": rows.column("rid").to_pylist(), "ids": rows.column("id").to_pylist(), "labels": rows.column("label").to_pylist()}
    return pa.RecordBatch.from_pylist([row | {"q": b"".join(rows.column("q").to_pylist())}], _GROUP_TYPE)


def _anchors(width: int, every: int):
    """(rid, id, label, q) of the anchors in the blocks. A row's number is its block's and its place there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {"rid": [], "id": [], "label": [], "q": []}
            for r in batch.select(["block", "ids", "labels", "q"]).to_pylist():
                step = 4 * width
                for i, x in enumerate(r["ids"]):
                    if x is not None and x % every == 0:
                        for name, value in (("rid", r["block"] * BLOCK + i), ("id", x), ("label", r["labels"][i]), ("q", r["q"][i * step : (i + 1) * step])):
                            out[name].append(value)
            yield pa.RecordBatch.from_pydict(out, pa.schema([("rid", pa.int64()), ("id", pa.int64()), ("label", pa.int64()), ("q", pa.binary())]))

    return run


def _choose(width: int, own: bool, seeds: int | None):
    """Which blocks of a shelf each anchor of a group must read; with ``seeds`` only so many with the highest bounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                a = _matrix(r["q"], width)
                least, most = bounds(a, _matrix(r["lo"], width), _matrix(r["hi"], width))
                labels = np.array(r["labels"])
                kinds = [set(x) for x in r["kinds"]]
                fits = {x: np.array([(x in k) if own else (k != {x}) for k in kinds]) for x in set(r["labels"])}
                right = np.stack([fits[x] for x in r["labels"]])
                at = np.array([w["a"] for w in r["windows"]])
                low, high = (np.array([w[c] for w in r["windows"]], np.int64) for c in ("floor", "ceiling"))
                # A block that only reaches the kth score can still win by a smaller id.
                tie = np.array([_FAR if w["last"] is None else w["last"] for w in r["windows"]], np.int64)
                first = np.array([_FAR if x is None else x for x in r["least"]], np.int64)
                meets = right[at] & (least[at] <= high[:, None])
                meets &= (most[at] > low[:, None]) | ((most[at] == low[:, None]) & (first <= tie[:, None]))
                needs = np.zeros(right.shape, bool)
                np.logical_or.at(needs, at, meets)
                if seeds is not None:
                    rank = np.argsort(np.argsort(np.where(needs, -most, _FAR), axis=1, kind="stable"), axis=1, kind="stable")
                    needs &= rank < seeds
                for z in np.flatnonzero(needs.any(0)):
                    picked = np.flatnonzero(needs[:, z])
                    place = np.full(len(a), -1)
                    place[picked] = np.arange(len(picked))
                    ws = np.flatnonzero(meets[:, z] & (place[at] >= 0))
                    out.append({
                        "block": r["blocks"][z], "rids": [r["rids"][i] for i in picked], "own": labels[picked].tolist(), "vectors": a[picked].tobytes(),
                        "at": place[at[ws]].tolist(), "w": [r["windows"][i]["w"] for i in ws], "floor": low[ws].tolist(), "ceiling": high[ws].tolist(),
                    })
                    if len(out) >= 256:
                        yield pa.RecordBatch.from_pylist(out, _REQUEST_TYPE)
                        out = []
            if out:
                yield pa.RecordBatch.from_pylist(out, _REQUEST_TYPE)

    return run


def _read(width: int, own: bool, k: int):
    """The first ``k`` rows of a block for each window that asks for it."""
    names = ["rid", "w", "score", "id", "row"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[np.zeros(0, np.int64)] for _ in names]
            empty = [np.zeros(0, bool)]
            for r in batch.to_pylist():
                labels = np.array(r["labels"])
                null = np.array([x is None for x in r["ids"]])
                ids = np.array([_FAR if x is None else x for x in r["ids"]], np.int64)
                order = np.lexsort((ids, null))  # the order of equal scores
                rows = r["block"] * BLOCK + order
                at, w, low, high = (np.array(r[c], np.int64) for c in ("at", "w", "floor", "ceiling"))
                score = _product(_matrix(r["vectors"], width), _matrix(r["q"], width)[order])
                same = np.array(r["own"])[:, None] == labels[order]
                right = (same if own else ~same) & (np.array(r["rids"])[:, None] != rows)
                s = score[at]
                inside = right[at] & (s >= low[:, None]) & (s <= high[:, None])
                some = np.flatnonzero(inside.any(1))
                first = np.argsort(np.where(inside[some], -s[some], _FAR), axis=1, kind="stable")[:, :k]
                kept = np.take_along_axis(inside[some], first, 1)
                i, j = np.nonzero(kept)
                pick = first[i, j]
                found = [np.array(r["rids"])[at[some[i]]], w[some[i]], s[some[i], pick], ids[order][pick], rows[pick]]
                for x, y in zip(out, found, strict=True):
                    x.append(y)
                empty.append(null[order][pick])
            cols = [np.concatenate(x) for x in out]
            arrays = [pa.array(c, mask=np.concatenate(empty)) if n == "id" else pa.array(c) for n, c in zip(names, cols, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


class Blocks:
    """The staged blocks of a table, their zone maps and the groups of anchors."""

    def __init__(self, blocks: DataFrame, shelves: DataFrame, groups: DataFrame, width: int, parts: int):
        self.blocks, self.shelves, self.groups, self.width, self.parts = blocks, shelves, groups, width, parts

    def _ask(self, windows: DataFrame, own: bool, k: int, seeds: int | None) -> DataFrame:
        """(rid, w, score, id, row, rank): the best rows of the chosen blocks per window."""
        # At most GROUP anchors with a few windows each.
        asked = windows.groupBy("group").agg(F.collect_list(F.struct("a", "w", "floor", "ceiling", "last")).alias("windows"))
        pairs = self.groups.join(asked, "group").drop("group", "ids").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(self.parts - 1))))
        shelves = self.shelves.withColumn("part", F.pmod(F.xxhash64("shelf"), F.lit(self.parts)).cast("int")).drop("shelf")
        requests = pairs.join(shelves, "part").drop("part").mapInArrow(_choose(self.width, own, seeds), _REQUEST_SHAPE)
        held = requests.join(self.blocks.select("block", "ids", "labels", "q"), "block")
        found = held.mapInArrow(_read(self.width, own, k), "rid long, w long, score long, id long, row long")
        return top_per_group(found, ["rid", "w"], [F.col("score").desc(), F.col("id").asc_nulls_last(), "row"], k)

    def search(self, windows: DataFrame, own: bool, k: int) -> DataFrame:
        """(rid, w, rank, score, id, row): the first ``k`` rows, of the anchor's own label or of the others, with floor <= score <= ceiling.

        ``windows`` is (group, a, rid, w, floor, ceiling), ``a`` the anchor's place in its group.
        """
        seen = self._ask(windows.withColumn("last", F.lit(None).cast("long")), own, k, SEEDS)
        kth = stage(seen.where(F.col("rank") == k).select("rid", "w", F.col("score").alias("kth"), F.col("id").alias("last")), "kth")
        raised = windows.join(kth, ["rid", "w"], "left").withColumn("floor", F.greatest("floor", F.coalesce("kth", "floor")))
        return stage(self._ask(raised, own, k, None), "found")


def clean(vectors: DataFrame, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """(id, label, vector) of the rows that take part."""
    sound = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(F.col(label_col).isNotNull() & F.col(vector_col).isNotNull() & sound)
    return rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("vector"))


def build(rows: DataFrame, every: int = EVERY) -> Blocks | None:
    """Blocks, zone maps and anchor groups of (id, label, vector); None without rows."""
    ranges = rows.select("vector").mapInArrow(_ranges, "dim long, lo long, hi long")
    table = ranges.groupBy("dim").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).orderBy("dim").toArrow()
    if not table.num_rows:
        return None
    # Vectors without components have one that is 0. A shorter vector's missing components are 0.
    lo, hi = (np.append(table.column(c).to_numpy()[1:], [0] if table.num_rows == 1 else []).astype(np.int64) for c in ("lo", "hi"))
    width = len(lo)
    lo, hi = np.minimum(lo, 0), np.maximum(hi, 0)
    bits = max(1, min(8, KEY_BITS // width))
    keyed = rows.mapInArrow(_keys(lo, hi, bits), "id long, label long, key binary, q binary")
    # Equal vectors are cut by the hash of their id, so that a common one fills many blocks in many tasks.
    spread = F.xxhash64("id")
    ranged = keyed.repartitionByRange("key", spread).sortWithinPartitions("key", spread, "label")
    blocks = stage(ranged.mapInArrow(_packer(BLOCK, _block(width)), _BLOCK_SHAPE), "blocks")
    shelves = stage(blocks.select("block", "lo", "hi", "kinds", "least").mapInArrow(_packer(ZONES, _shelf), _SHELF_SHAPE), "zones")
    anchors = blocks.mapInArrow(_anchors(width, every), "rid long, id long, label long, q binary")
    groups = stage(anchors.mapInArrow(_packer(GROUP, _group), _GROUP_SHAPE), "anchors")
    return Blocks(blocks, shelves, groups, width, max(1, shelves.count()))


def mine(vectors: DataFrame, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the rows whose id is divisible by EVERY. Positives are the first POSITIVES other rows of the anchor's label by
    inner product (equal ones by id); per positive, the first NEGATIVES rows of other labels that score LOW to HIGH hundredths
    of it. A positive with a negative score has no such rows.
    """
    return _mined(vectors.sparkSession, build(clean(vectors, id_col, label_col, vector_col)))


def _mined(spark: SparkSession, index: Blocks | None) -> DataFrame:
    if index is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    places = index.groups.select("group", F.posexplode(F.arrays_zip("rids", "ids")).alias("a", "x")).select(
        "group", "a", F.col("x.rids").alias("rid"), F.col("x.ids").alias("anchor_id")
    )
    all_of = places.select("group", "a", "rid", F.lit(0).cast("long").alias("w"), F.lit(-_FAR).alias("floor"), F.lit(_FAR).alias("ceiling"))
    best = index.search(all_of, True, POSITIVES)
    positives = best.select("rid", F.col("rank").cast("long").alias("w"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    # The ends of the window as whole numbers, for scores that are not negative.
    floor = F.expr(f"({LOW} * positive_score + 99) div 100")
    ceiling = F.expr(f"({HIGH} * positive_score) div 100")
    windows = places.join(positives.where("positive_score >= 0"), "rid").withColumns({"floor": floor, "ceiling": ceiling})
    found = index.search(windows.select("group", "a", "rid", "w", "floor", "ceiling"), False, NEGATIVES)
    rows = found.select("rid", "w", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = rows.join(positives, ["rid", "w"]).join(places.select("rid", "anchor_id"), "rid")
    return named.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
