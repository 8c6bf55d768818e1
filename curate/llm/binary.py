"""Token ids as bit-plane shuffled blocks.

The ids of all documents, in ascending order of their ids, are one long sequence, cut by ranges into parts and
inside a part into blocks of a fixed number of ids. A block's 32-bit ids are transposed into four byte planes
(byte k of every id, one after the other), and each plane is compressed with zstandard: the upper planes are
nearly constant and vanish. Every block carries its entry of the index (part, number, first id, and the
documents that lie in it), so any document can be read without its neighbours.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from curate.llm.tokens import encoder
from curate.llm.words import slices

BLOCK = 1 << 16
LEVEL = 3
PLANES = 4
#: Bytes of text encoded at once.
SLICE = 4 << 20
#: Rows of a part, about: parts are ranges of the document order.
PART_ROWS = 20_000


def shuffle(ids: np.ndarray, level: int = LEVEL) -> list[bytes]:
    """The compressed byte planes of a block."""
    planes = np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, PLANES).T)
    press = zstandard.ZstdCompressor(level=level)
    return [press.compress(plane.tobytes()) for plane in planes]


def unshuffle(planes: list[bytes], n: int) -> np.ndarray:
    """The ids of a block of n."""
    press = zstandard.ZstdDecompressor()
    raw = [np.frombuffer(press.decompress(p, max_output_size=max(n, 1)), np.uint8) for p in planes]
    return np.ascontiguousarray(np.stack(raw, axis=1)).view("<u4").ravel()


def _write(path: str, end_id: int, block: int, level: int, id_type: pa.DataType):
    """Blocks of the documents of one task, in their order."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        held: list[bytes] = []  # ids of the open block, by document
        pieces: list[dict] = []
        size, number, row = 0, 0, 0
        part = None

        def close() -> pa.RecordBatch:
            nonlocal size, number, pieces
            ids = np.frombuffer(b"".join(held), "<u4")
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()),
                    pa.array([number], pa.int32()),
                    pa.array([size], pa.int32()),
                    pa.array([shuffle(ids, level)], pa.list_(pa.binary())),
                    pa.array([pieces], pieces_type(id_type)),
                ],
                names=["part", "block", "n_ids", "planes", "docs"],
            )
            held.clear()
            pieces, size, number = [], 0, number + 1
            return out

        for batch in batches:
            if len(batch) == 0:
                continue
            part = batch.column("part")[0].as_py()
            column, names = batch.column("text"), batch.column("doc_id").to_pylist()
            ends = np.cumsum([0, *pc.fill_null(pc.binary_length(column), 0).to_pylist()])
            for lo, hi in slices(ends, SLICE):
                for name, ids in zip(names[lo:hi], encode.ids(column.slice(lo, hi - lo).to_pylist()), strict=True):
                    ids += end
                    at, seq, total = 0, 0, len(ids) // 4
                    while at < total:
                        step = min(total - at, block - size)
                        held.append(ids[4 * at : 4 * (at + step)])
                        at += step
                        pieces.append({"row": row, "doc_id": name, "from": size, "to": size + step, "seq": seq, "last": at == total})
                        size, seq = size + step, seq + 1
                        if size == block:
                            yield close()
                    row += 1
        if size:
            yield close()

    return run


def pieces_type(id_type: pa.DataType) -> pa.DataType:
    return pa.list_(pa.struct([("row", pa.int64()), ("doc_id", id_type), ("from", pa.int32()), ("to", pa.int32()), ("seq", pa.int32()), ("last", pa.bool_())]))


def write_ids(
    docs: DataFrame, path: str, vocabulary: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, level: int = LEVEL
) -> None:
    """Encode every text (NULL: empty), append ``end_id``, and write blocks of ``block`` ids in ascending order of the ids.

    Rows of equal id are ordered by their text's hash, then by their text; NULL ids come first. An empty table gives an empty file set.
    A task holds one block and one slice of texts, besides the worker's memory of encoded chunks. Range borders are
    sampled by id and text hash, so a hot id is cut too.
    """
    spark = docs.sparkSession
    id_field = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    n_parts = max(1, rows.count() // PART_ROWS + 1)
    ordered = rows.repartitionByRange(n_parts, "doc_id", "th").sortWithinPartitions("doc_id", "th", "text")
    ordered = ordered.select(F.spark_partition_id().alias("part"), "doc_id", "text")
    shape = (
        f"part int, block int, n_ids int, planes array<binary>, "
        f"docs array<struct<row: long, doc_id: {id_field}, from: int, to: int, seq: int, last: boolean>>"
    )
    run = _write(vocabulary, end_id, block, level, to_arrow_type(docs.schema[id_col].dataType))
    ordered.mapInArrow(run, shape).write.option("compression", "none").mode("errorifexists").parquet(path)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


_POLY = 0xEDB88320


def _times(a: int, b: int) -> int:
    """Product of two polynomials over GF(2) modulo the CRC-32 polynomial, bits reversed."""
    out = 0
    for _ in range(32):
        if a & 0x80000000:
            out ^= b
        a = (a << 1) & 0xFFFFFFFF
        b = (b >> 1) ^ (_POLY if b & 1 else 0)
    return out


def join_crc(first: int, second: int, length: int) -> int:
    """CRC-32 of two byte strings one after the other, from their own; ``length`` is the second's."""
    power, base, n = 0x80000000, 0x00800000, length  # 1, and x^8
    while n:
        if n & 1:
            power = _times(power, base)
        base, n = _times(base, base), n >> 1
    return _times(power, first) ^ second


def _decode(id_type: pa.DataType):
    """Per block and document: how many of its ids lie in it, and their CRC-32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                n = batch.column("n_ids")[i].as_py()
                ids = unshuffle(batch.column("planes")[i].as_py(), n)
                raw = memoryview(ids.tobytes())
                docs = batch.column("docs")[i].values
                start, stop = docs.field("from").to_numpy(), docs.field("to").to_numpy()
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(start.tolist(), stop.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(docs), batch.column("part")[i].as_py(), np.int32)),
                        pa.array(np.full(len(docs), batch.column("first")[i].as_py(), np.int64) + start),
                        docs.field("row"),
                        docs.field("doc_id"),
                        docs.field("seq"),
                        docs.field("last"),
                        pa.array((stop - start).astype(np.int64)),
                        pa.array(crc, pa.int64()),
                    ],
                    names=["part", "start", "row", "doc_id", "seq", "last", "n", "crc"],
                )

    return run


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the blocks alone.

    ``start`` counts all ids of the documents before. Documents that lie in several blocks are joined from their
    pieces' lengths and checksums, so no task gathers the ids of a long document.
    """
    blocks = read_blocks(spark, path)
    # One row per part (some tens of thousands of documents each): the offsets of the parts.
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    size = blocks.agg(F.max("n_ids")).first()[0] or 0  # all blocks but the last of a part are full
    at = F.col("base") + F.col("block").cast("long") * F.lit(size)
    id_field = blocks.schema["docs"].dataType.elementType["doc_id"].dataType
    shape = f"part int, start long, row long, doc_id {id_field.simpleString()}, seq int, last boolean, n long, crc long"
    rows = blocks.join(parts, "part").withColumn("first", at).mapInArrow(_decode(to_arrow_type(id_field)), shape)
    pieces = rows.groupBy("part", "row").agg(F.sort_array(F.collect_list(F.struct("seq", "start", "n", "crc", "last", "doc_id"))).alias("p"))

    @F.pandas_udf("long")
    def joined(lists):
        def one(pieces) -> int:
            crc = int(pieces[0]["crc"])
            for x in pieces[1:]:
                crc = join_crc(crc, int(x["crc"]), 4 * int(x["n"]))
            return crc

        return lists.map(one)

    total = F.aggregate("p", F.lit(0).cast("long"), lambda s, x: s + x["n"])
    single = pieces.where(F.size("p") == 1).withColumn("ids_crc32", F.col("p")[0]["crc"])
    several = pieces.where(F.size("p") > 1).withColumn("ids_crc32", joined("p"))
    return single.unionByName(several).select(
        F.col("p")[0]["doc_id"].alias("doc_id"), F.col("p")[0]["start"].alias("start"), total.alias("n_tokens"), "ids_crc32"
    )
