"""Similarity join of texts on word n-grams: MinHash banding, then exact verification.

Copies (texts with the same n-gram set) are one class, so only class representatives are compared. Rows
are dealt out by band hash; classes that share a bucket are tied to the bucket's least class (a star, never
all pairs), and the components of these ties are the candidate groups. Pairs that share a bucket are verified on
their full n-gram sets. A group is dealt out block against block, so no task holds more than two blocks however
large it is; a group of several blocks is dealt out by its buckets instead where that makes fewer rows, as in long
chains of texts of which only neighbours meet. Both ways verify the same pairs, each once.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curate.llm.components import components
from curate.llm.keys import KEY, keyed, only, with_facts
from curate.llm.words import FOLDED, SLICE, Words, mix, signed, slices, texts, windows
from curate.operators.skew import join_unique
from curate.storage import stage

GRAM = 5
SIMILARITY = 0.8
#: Share of pairs at exactly the similarity that must meet in a band; more similar pairs meet more surely.
RECALL = 0.999999
ROWS = 5
BLOCK_CLASSES = 256
BLOCK_BYTES = 4 << 20


def bands(similarity: float = SIMILARITY, recall: float = RECALL, rows: int = ROWS) -> int:
    """Bands of ``rows`` values needed for the recall: 1 - (1 - s^rows)^bands >= recall."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))


def _grams(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of every n-gram; a text of fewer words, but not none, is one gram."""
    h, left, of = words.hashes(), words.left(), words.text_of()
    full = left >= n
    out, texts_of = windows(h, n)[full], of[full]
    short = np.flatnonzero((words.count > 0) & (words.count < n))
    if len(short):
        extra = np.empty(len(short), np.uint64)
        for size in range(1, n):
            mine = words.count[short] == size
            extra[mine] = mix(windows(h, size)[words.first[short[mine]]] + np.uint64(size))
        out, texts_of = np.concatenate([out, extra]), np.concatenate([texts_of, short])
    return out, texts_of


def _sets(words: Words, n: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct grams of all texts, and the borders of each text."""
    h, of = _grams(words, n)
    order = np.lexsort((h, of))
    h, of = h[order], of[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    h, of = h[new], of[new]
    return h, np.searchsorted(of, np.arange(rows + 1))


def _sketch(n: int, n_bands: int, n_rows: int):
    """Class (digest of the set), size of the set and band hashes of every text."""
    draw = np.random.default_rng(20240229)
    turn = draw.integers(1, 1 << 63, n_bands * n_rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    flip = draw.integers(1, 1 << 63, n_bands * n_rows, dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = texts(batch.column("_text"))
            for lo, hi in slices(offsets, SLICE):
                words = Words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1], FOLDED, True)
                h, border = _sets(words, n, hi - lo)
                size = np.diff(border)
                full = np.flatnonzero(size > 0)
                raw = h.tobytes()
                classes = [
                    hashlib.blake2b(raw[8 * border[i] : 8 * border[i + 1]], digest_size=16).digest() if size[i] else None
                    for i in range(hi - lo)
                ]
                values = np.zeros((hi - lo, n_bands), np.uint64)
                if len(full):
                    starts = border[full]
                    for b in range(n_bands):
                        band = np.full(len(full), b + 1, np.uint64)
                        for k in range(b * n_rows, (b + 1) * n_rows):
                            least = np.minimum.reduceat((h ^ flip[k]) * turn[k], starts)
                            band = mix(band * np.uint64(0x9E3779B97F4A7C15) + least)
                        values[full, b] = band
                flat = pa.array(signed(values.ravel()))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1, dtype=np.int32) * n_bands), flat)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("_id").slice(lo, hi - lo),
                        batch.column("_th").slice(lo, hi - lo),
                        pa.array(classes, pa.binary()),
                        pa.array(size.astype(np.int64)),
                        lists,
                    ],
                    names=["_id", "_th", "class", "n_grams", "bands"],
                )

    return run


def _gram_sets(n: int):
    """The n-gram set of each class representative, as sorted 64-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = texts(batch.column("_text"))
            for lo, hi in slices(offsets, SLICE):
                words = Words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1], FOLDED, True)
                h, border = _sets(words, n, hi - lo)
                raw = h.tobytes()
                sets = [raw[8 * border[i] : 8 * border[i + 1]] for i in range(hi - lo)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("class").slice(lo, hi - lo),
                        batch.column("root").slice(lo, hi - lo),
                        batch.column("copies").slice(lo, hi - lo),
                        batch.column("bands").slice(lo, hi - lo),
                        pa.array(sets, pa.binary()),
                    ],
                    names=["class", "root", "copies", "bands", "grams"],
                )

    return run


def _compare(similarity: float):
    """Links between two blocks of a group or bucket: per class the copies linked to it, and the least class it is tied to.

    A pair is verified if it shares a band; inside the bucket of one band, if that is the first band it shares.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("class")
        low, high = int(group["low"].iloc[0]), int(group["high"].iloc[0])
        block, at = group["block"].to_numpy(), int(group["at"].iloc[0])
        bands_of = np.stack(group["bands"].to_numpy())
        sets = [np.frombuffer(x, np.uint64) for x in group["grams"]]
        size = np.array([len(x) for x in sets])
        copies = group["copies"].to_numpy()
        starts = np.concatenate([[0], np.cumsum(size)])
        distinct, ids = np.unique(np.concatenate(sets), return_inverse=True)
        mark = np.zeros(len(distinct), bool)
        links, root = np.zeros(len(sets), np.int64), np.arange(len(sets))
        rank = np.arange(len(sets))
        for i in np.flatnonzero(block == low):
            others = (rank > i) if low == high else (block == high)
            others &= (size >= similarity * size[i] - 1e-9) & (similarity * size <= size[i] + 1e-9)
            near = np.flatnonzero(others)
            same = bands_of[near] == bands_of[i]
            others[near] = same.any(axis=1) if at < 0 else same.any(axis=1) & (same.argmax(axis=1) == at)
            if not others.any():
                continue
            mine = ids[starts[i] : starts[i + 1]]
            mark[mine] = True
            shared = np.add.reduceat(mark[ids].astype(np.int64), starts[:-1])
            mark[mine] = False
            linked = np.flatnonzero(others & (shared >= similarity * (size[i] + size - shared) - 1e-9))
            if len(linked):
                links[i] += copies[linked].sum()
                links[linked] += copies[i]
                tied = np.unique(np.append(root[linked], root[i]))
                root[np.isin(root, tied)] = tied[0]
        names = group["class"].to_numpy()
        return pd.DataFrame({"class": names, "links": links, "tied": names[root]})

    return run


def _n_blocks() -> Column:
    return F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_CLASSES, F.sum("bytes") / BLOCK_BYTES))


def _ways(candidates: DataFrame) -> DataFrame:
    """(root, n_blocks, apart) of every group; ``apart``: its buckets make fewer rows than its pairs of blocks."""
    sized = candidates.select("class", "root", "bands", F.length("grams").alias("bytes"))
    groups = sized.groupBy("root").agg(_n_blocks().alias("n_blocks"), F.count(F.lit(1)).alias("n"))
    large = join_unique(sized, groups.where("n_blocks > 1").select("root", "n_blocks"), "root", "inner")
    buckets = large.select("root", "bytes", F.explode("bands").alias("band"))
    buckets = buckets.groupBy("root", "band").agg(F.count(F.lit(1)).alias("n"), _n_blocks().alias("blocks")).where("n > 1")
    cost = buckets.groupBy("root").agg(F.sum(F.col("n") * F.col("blocks")).alias("rows"))
    apart = F.coalesce(F.col("rows") < F.col("n") * F.col("n_blocks"), F.lit(False))
    return groups.join(cost, "root", "left").select("root", "n_blocks", apart.alias("apart"))


def _crossed(rows: DataFrame) -> DataFrame:
    """Each class once per pair of blocks it takes part in: about (group size / block size) rows."""
    rows = rows.withColumn("block", F.pmod(F.xxhash64("class"), "n_blocks"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)))
    rows = rows.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})
    return rows.select("root", "at", "band", "low", "high", "block", "class", "copies", "bands", "grams")


def _blocks(candidates: DataFrame) -> DataFrame:
    """Rows to compare. ``at`` and ``band`` tell the bucket in groups that are dealt out by buckets, else -1 and 0."""
    ways = stage(_ways(candidates), "ways")
    rows = join_unique(candidates, ways, "root", "inner")
    whole = rows.where("not apart").withColumns({"at": F.lit(-1), "band": F.lit(0).cast("long")})
    apart = rows.where("apart").drop("n_blocks").select("*", F.posexplode("bands").alias("at", "band"))
    sizes = apart.select("root", "at", "band", F.length("grams").alias("bytes")).groupBy("root", "at", "band")
    sizes = sizes.agg(_n_blocks().alias("n_blocks"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n", "root")
    apart = join_unique(apart, sizes, ["at", "band"], "inner")
    return _crossed(whole).unionByName(_crossed(apart))


def similarity_join(
    docs: DataFrame,
    similarity: float = SIMILARITY,
    gram: int = GRAM,
    recall: float = RECALL,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(_id, _th, class, n_grams, n_links, group): one row per input row.

    Texts are lower-cased (A-Z) and cut into words of letters, digits and everything beyond ASCII. Two rows are
    linked if the Jaccard similarity of their sets of ``gram``-word sequences is at least ``similarity``;
    ``n_links`` counts a row's links, copies included. ``class`` marks rows of one n-gram set, ``group`` rows
    connected by links (its least class). A text of fewer words is one gram, so short texts link to equal ones
    only; NULL and empty texts have no class, no group and no link. Repeated rows are copies of each other.
    Each pair at the similarity meets in a bucket with probability ``recall``, more similar ones more surely; every pair
    that meets is compared exactly (64-bit hashes of grams), so nothing reported is below the similarity.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = keyed(docs, id_col, text_col)
    n_bands = bands(similarity, recall)
    shape = f"_id {id_type}, _th long, class binary, n_grams long, bands array<long>"
    sketch = stage(rows.mapInArrow(_sketch(gram, n_bands, ROWS), shape), "sketch")

    classes = sketch.where("class is not null").groupBy("class").agg(
        F.min(F.struct(*KEY)).alias("one"),
        F.count(F.lit(1)).alias("copies"),
        F.first("bands").alias("bands"),
    )
    dealt = classes.select("class", F.explode("bands").alias("band"))
    heads = dealt.groupBy("band").agg(F.min("class").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1")
    stars = join_unique(dealt, heads, "band", "inner").select(F.col("class").alias("a"), F.col("head").alias("b"))
    ties = components(stars, "candidates")
    ties = ties.select(F.col("a").alias("class"), "root").union(ties.select("root", "root").distinct())

    ones = classes.select("class", "copies", "bands", "one._id", "one._th").join(ties, "class")
    texts_of = with_facts(rows, ones, "inner").select("class", "root", "copies", "bands", "_text")
    # A repeated row carries the same key: one of them is enough.
    sets = texts_of.mapInArrow(_gram_sets(gram), "class binary, root binary, copies long, bands array<long>, grams binary")
    candidates = stage(sets, "grams").dropDuplicates(["class"])
    compared = _blocks(candidates).groupBy("root", "at", "band", "low", "high").applyInPandas(_compare(similarity), "class binary, links long, tied binary")
    compared = stage(compared, "compared")
    groups = components(compared.where("tied != class").select(F.col("class").alias("a"), F.col("tied").alias("b")), "groups")
    links = compared.groupBy("class").agg(F.sum("links").alias("links"))

    known = classes.select("class", "copies").join(links, "class", "left").join(groups.withColumnRenamed("a", "class"), "class", "left")
    known = known.select(
        "class",
        (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        F.coalesce("root", "class").alias("group"),
    )
    plain = sketch.select(*KEY, "class", "n_grams")
    out = join_unique(plain.where("class is not null"), known, "class").select(*KEY, "class", "n_grams", "n_links", "group")
    # Rows without words would all meet in the join at the key NULL.
    none = plain.where("class is null").select("*", F.lit(0).cast("long").alias("n_links"), F.col("class").alias("group"))
    return out.union(none)


def one_of_each(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each group of linked rows (the least by id, NULL first, then by text hash), all its columns.

    Rows without words stay. Rows that repeat each other in id and text count as links and leave one row.
    """
    rows = similarity_join(docs, similarity, id_col=id_col, text_col=text_col, **options)
    first = rows.where("group is not null").groupBy("group").agg(F.min(F.struct(*KEY)).alias("one")).select("one.*")
    repeated = rows.where("group is not null").groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*KEY)
    marked = with_facts(first, repeated.withColumn("many", F.lit(True)))
    wordless = rows.where("group is null").select(*KEY, F.lit(None).cast("boolean").alias("many")).distinct()
    keys = stage(marked.union(wordless), "kept")
    # Repeated rows are few: the others need no look at repeats.
    alone = only(docs, keys.where("many is null"), True, id_col, text_col)
    many = only(docs, keys.where("many"), True, id_col, text_col).dropDuplicates([id_col, text_col])
    return alone.unionByName(many)
