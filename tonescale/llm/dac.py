"""Token ids in directly addressable codes.

Every id is split into chunks of eight bits. Level 0 has the lowest chunk of all ids and one
continuation bit for each; level k has the next chunk of those ids whose bit was set on level
k - 1. A rank directory holds the number of set bits before every 512th, so the place of an
id on the next level is one directory entry and the bits of one block: any id is read from
few bytes, without decoding what lies before it.

A file is a table of segments in the order of the documents; a segment has whole documents, their
ids as one code, and their lengths. Segments are written and read by Spark, in the shared folder.

Segment code, little-endian: ``DAC1``, uint32 levels, uint64 ids on each level; then for each level its chunks and,
on all but the last, its bitmap (lowest bit first, padded to 64 bytes) and its directory (uint32).

Defined results: a null or empty text is its end id alone. Rows are ordered by id, null ids first; rows that share an id
by a hash of their text. Other columns of the input are ignored. An empty table gives no segments and no rows.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tonescale.llm.bpe import encode_with_end
from tonescale.llm.text import pieces, texts_of

MAGIC = b"DAC1"
BLOCK = 512


def encode(ids: np.ndarray) -> bytes:
    left, counts, parts = np.asarray(ids, np.uint32), [], []
    while True:
        counts.append(len(left))
        parts.append((left & 0xFF).astype(np.uint8).tobytes())
        more = left > 0xFF
        if not more.any():
            break
        bits = np.zeros(-(-len(left) // BLOCK) * (BLOCK // 8), np.uint8)
        packed = np.packbits(more, bitorder="little")
        bits[: len(packed)] = packed
        ones = np.bitwise_count(bits.view(np.uint64)).reshape(-1, BLOCK // 64).sum(1)
        parts += [bits.tobytes(), (np.cumsum(ones) - ones).astype("<u4").tobytes()]
        left = left[more] >> 8
    return b"".join([MAGIC, struct.pack("<I", len(counts)), np.array(counts, "<u8").tobytes(), *parts])


class Code:
    """A segment code, opened: nothing is decoded until ids are asked for."""

    def __init__(self, data: bytes) -> None:
        if data[:4] != MAGIC:
            raise ValueError("not a segment code")
        (levels,) = struct.unpack_from("<I", data, 4)
        counts = np.frombuffer(data, "<u8", levels, 8).tolist()
        at, self._levels = 8 + 8 * levels, []
        for k, n in enumerate(counts):
            chunks = np.frombuffer(data, np.uint8, n, at)
            at += n
            bits = ranks = None
            if k + 1 < levels:
                blocks = -(-n // BLOCK)
                bits = np.frombuffer(data, np.uint8, blocks * BLOCK // 8, at)
                ranks = np.frombuffer(data, "<u4", blocks, at + len(bits))
                at += len(bits) + 4 * blocks
            self._levels.append((chunks, bits, ranks))

    def __len__(self) -> int:
        return len(self._levels[0][0])

    def __getitem__(self, i: int) -> int:
        """The id at place i, by one directory entry and one block of bits a level."""
        value, shift = 0, 0
        for chunks, bits, ranks in self._levels:
            value |= int(chunks[i]) << shift
            if bits is None or not bits[i >> 3] >> (i & 7) & 1:
                break
            first = i // BLOCK * (BLOCK // 8)
            before = int(np.bitwise_count(bits[first : i >> 3]).sum()) + int(bits[i >> 3] & ((1 << (i & 7)) - 1)).bit_count()
            i, shift = int(ranks[i // BLOCK]) + before, shift + 8
        return value

    def all(self) -> np.ndarray:
        """Every id, level by level."""
        out, at, shift = np.zeros(len(self), np.uint32), None, 0
        for chunks, bits, _ in self._levels:
            part = chunks.astype(np.uint32) << np.uint32(shift)
            if at is None:
                out |= part
            else:
                out[at] |= part
            if bits is None:
                break
            more = np.flatnonzero(np.unpackbits(bits, count=len(chunks), bitorder="little"))
            at, shift = more if at is None else at[more], shift + 8
        return out


def segments(docs: DataFrame, path: str, end_id: int, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``(part, before, ids, lengths, n_ids, code)``: ordered by ``(part, before)``, the documents ascend by id.

    ``before`` counts the ids in earlier segments of the same part.

    Whole texts are dealt out by ranges of ids, so each task writes one run of the order.
    """
    rows = docs.select(F.col(id_column).alias("id"), F.col(text).cast("string").alias("text"))
    tie = F.xxhash64("text")
    dealt = rows.repartitionByRange("id", tie).sortWithinPartitions("id", tie)
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        part, before = TaskContext.get().partitionId(), 0
        for batch in pieces(batches, 1):
            ids, counts = encode_with_end(texts_of(batch.column(1)), path, end_id)
            whole = pa.array([batch.column(0).to_pylist()], pa.list_(batch.column(0).type))
            columns = [pa.array([part]), pa.array([before]), whole, pa.array([counts.tolist()]), pa.array([len(ids)]), pa.array([encode(ids)], pa.binary())]
            yield pa.record_batch(columns, ["part", "before", "ids", "lengths", "n_ids", "code"])
            before += len(ids)

    return dealt.mapInArrow(run, f"part long, before long, ids array<{kind}>, lengths array<long>, n_ids long, code binary")


def write(docs: DataFrame, folder: str, path: str = "word_bpe_49k.json", end_id: int = 1, id_column: str = "doc_id", text: str = "text") -> None:
    segments(docs, path, end_id, id_column, text).write.mode("overwrite").parquet(folder)


def placed(spark, folder: str) -> DataFrame:
    """The stored segments with ``first``: the number of ids in all segments before."""
    stored = spark.read.parquet(folder)
    # One row for each task that wrote, however long its segments are.
    parts = stored.groupBy("part").agg(F.sum("n_ids").alias("n"))
    earlier = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("earlier"))
    return stored.join(F.broadcast(earlier), "part").withColumn("first", F.col("earlier") + F.col("before"))


def read(spark, folder: str, id_column: str = "doc_id") -> DataFrame:
    """``(id_column, start, n_tokens, ids_crc32)`` of every stored document, decoded from the files."""
    rows = placed(spark, folder)
    kind = rows.schema["ids"].dataType.elementType.simpleString()

    def run(batches):
        for batch in batches:
            for first, owners, lengths, code in zip(*(batch.column(i) for i in range(4))):
                values, n = Code(code.as_py()).all().astype("<u4"), np.array(lengths.as_py(), np.int64)
                at = np.cumsum(n) - n
                crc = [zlib.crc32(values[a : a + k]) for a, k in zip(at.tolist(), n.tolist())]
                columns = [owners.values, pa.array(first.as_py() + at), pa.array(n), pa.array(crc, pa.int64())]
                yield pa.record_batch(columns, ["id", "start", "n_tokens", "ids_crc32"])

    found = rows.select("first", "ids", "lengths", "code").mapInArrow(run, f"id {kind}, start long, n_tokens long, ids_crc32 long")
    return found.withColumnRenamed("id", id_column)


def tokens_at(spark, folder: str, places: DataFrame) -> DataFrame:
    """``(place, token_id)`` of global places (column ``place``), each read from its segment by random access."""
    rows = placed(spark, folder)
    wide = 1 << 20
    asked = places.select("place", F.floor(F.col("place") / wide).alias("cell")).distinct()
    spans = rows.select("part", "before", "first", "n_ids").withColumn("cell", F.explode(F.sequence(F.floor(F.col("first") / wide), F.floor((F.col("first") + F.col("n_ids") - 1) / wide))))
    hits = asked.join(spans, "cell").filter((F.col("place") >= F.col("first")) & (F.col("place") < F.col("first") + F.col("n_ids")))
    wanted = hits.groupBy("part", "before").agg(F.collect_list("place").alias("places"))

    def run(batches):
        for batch in batches:
            for first, code, found in zip(*(batch.column(i) for i in range(3))):
                opened, at = Code(code.as_py()), found.as_py()
                values = [opened[p - first.as_py()] for p in at]
                yield pa.record_batch([pa.array(at, pa.int64()), pa.array(values, pa.int64())], ["place", "token_id"])

    return wanted.join(rows, ["part", "before"]).select("first", "code", "places").mapInArrow(run, "place long, token_id long")
