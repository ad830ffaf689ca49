"""Token ids as directly addressable codes.

A block holds the ids of consecutive documents. An id is split into 8-bit chunks, lowest first; level k holds the k-th
chunk of every id that has one, and a bitmap of which of them go on in level k + 1. A rank directory counts the set bits
before each 512-bit stretch, so the chunks of any single id are found without decoding others. Blocks are the rows of a
Parquet table: Spark's committer moves them, so any file system works and a retried task leaves no half-written file.

Block layout, little-endian: ``b"DAC1"``, u32 documents, u64 ids, u32 levels; i64 document keys; u64 first id of each document; then
for each level u64 entries, the chunks (u8), the bitmap (bytes, low bit first), the directory (u64 each).

Defined results: null text: the end id alone; null ids sort first; documents with one id are ordered by text, and repeated
rows are kept one by one. Tables may be empty.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._tokens import encoder, ranges
from ._text import key, new_path, unkey

MAGIC, END_ID = b"DAC1", 1
#: Rows of three numbers that are broadcast at most, some 5 MB.
MOST_BROADCAST = 200_000
STRETCH = 64  # bytes of bitmap for each entry of the directory
BLOCKS = "part int, seq int, n_tokens long, block binary"
_ONES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).sum(1).astype(np.uint8)


def encode_block(keys: np.ndarray, starts: np.ndarray, ids: np.ndarray) -> bytes:
    """starts: the first id of each document."""
    out, rest, levels = [], ids.astype("<u4"), 0
    while levels == 0 or len(rest):
        more = rest > 255
        bits = np.packbits(more, bitorder="little")
        ranks = np.concatenate([[0], np.cumsum(np.add.reduceat(_ONES[bits].astype("<u8"), np.arange(0, len(bits), STRETCH)))[:-1]]) if len(bits) else np.zeros(0)
        out += [np.uint64(len(rest)).tobytes(), rest.astype(np.uint8).tobytes(), bits.tobytes(), ranks.astype("<u8").tobytes()]
        rest, levels = rest[more] >> 8, levels + 1
    head = MAGIC + np.uint32(len(keys)).tobytes() + np.uint64(len(ids)).tobytes() + np.uint32(levels).tobytes()
    return b"".join([head, keys.astype("<i8").tobytes(), starts.astype("<u8").tobytes(), *out])


class Block:
    """A reader over a block's bytes; nothing is decoded until asked for."""

    def __init__(self, data: bytes) -> None:
        if data[:4] != MAGIC:
            raise ValueError("not a block of token ids")
        docs, levels = int(np.frombuffer(data, "<u4", 1, 4)[0]), int(np.frombuffer(data, "<u4", 1, 16)[0])
        self.n, at = int(np.frombuffer(data, "<u8", 1, 8)[0]), 20
        self.keys, self.starts = np.frombuffer(data, "<i8", docs, at), np.frombuffer(data, "<u8", docs, at + 8 * docs)
        at += 16 * docs
        self.levels = []
        for _ in range(levels):
            n = int(np.frombuffer(data, "<u8", 1, at)[0])
            size = (n + 7) // 8
            entries = (size + STRETCH - 1) // STRETCH
            chunks, bits = np.frombuffer(data, "u1", n, at + 8), np.frombuffer(data, "u1", size, at + 8 + n)
            self.levels.append((chunks, bits, np.frombuffer(data, "<u8", entries, at + 8 + n + size)))
            at += 8 + n + size + 8 * entries

    def _rank(self, level: int, i: int) -> int:
        """Set bits before bit i."""
        _, bits, ranks = self.levels[level]
        if not len(ranks):
            return 0
        byte = i // 8
        k = min(byte // STRETCH, len(ranks) - 1)
        count = int(ranks[k]) + int(_ONES[bits[k * STRETCH : byte]].sum())
        return count + (int(bits[byte] & ((1 << i % 8) - 1)).bit_count() if i % 8 else 0)

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level, (chunks, bits, _) in enumerate(self.levels):
            value |= int(chunks[i]) << 8 * level
            if not bits[i // 8] >> i % 8 & 1:
                break
            i = self._rank(level, i)
        return value

    def range(self, a: int, b: int) -> np.ndarray:
        """Ids a to b - 1; reads only their chunks."""
        def read(level: int, a: int, b: int) -> np.ndarray:
            chunks, bits, _ = self.levels[level]
            out = chunks[a:b].astype("<u4")
            more = np.unpackbits(bits[a // 8 : (b + 7) // 8], bitorder="little")[a % 8 : a % 8 + b - a].astype(bool)
            n = int(more.sum())
            if n:
                lo = self._rank(level, a)
                out[more] |= read(level + 1, lo, lo + n) << 8
            return out

        return read(0, a, b) if b > a else np.zeros(0, "<u4")

    def documents(self):
        """(key, start, ids) of each document."""
        ends, ids = [*self.starts[1:].tolist(), self.n], self.range(0, self.n)
        for k, a, b in zip(self.keys.tolist(), self.starts.tolist(), ends, strict=True):
            yield k, a, ids[a:b]


def write(docs: DataFrame, tokenizer: str, path: str, end_id: int = END_ID) -> None:
    """Encodes (doc_id, text) in ascending order of doc_id into blocks under ``path``."""

    def blocks(frames):
        enc, part, seq = encoder(tokenizer), TaskContext.get().partitionId(), 0
        for batch in frames:
            for lo, hi in ranges(batch.column(1)):
                ids, at = enc.encode(batch.column(1).slice(lo, hi - lo))
                ids = np.insert(ids, at[1:], end_id)
                block = encode_block(batch.column(0).slice(lo, hi - lo).to_numpy(), at[:-1] + np.arange(hi - lo), ids)
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([block], pa.binary())], ["part", "seq", "n_tokens", "block"])
                seq += 1

    rows = docs.select(key(docs["doc_id"]).alias("d"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    # the sample of keys that range bounds are made of holds short beginnings of texts; equal beginnings stay together
    ranged = rows.repartitionByRange("d", F.substring("text", 1, 16)).sortWithinPartitions("d", "text")
    ranged.mapInArrow(blocks, BLOCKS).write.option("compression", "zstd").parquet(path)


def read(spark, path: str) -> DataFrame:
    """Per document (d, start, ids binary of little-endian u32), start counted over all blocks before."""
    table = spark.read.schema(BLOCKS).parquet(path)
    order = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    sizes = table.select("part", "seq", "n_tokens")
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # a row for each written part
    parts = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("part_base"))
    bases = sizes.withColumn("base", F.coalesce(F.sum("n_tokens").over(order), F.lit(0))).join(parts, "part")
    bases = bases.select("part", "seq", (F.col("base") + F.col("part_base")).alias("base"))
    # a row for each block: broadcast while that is small, so that blocks are not shuffled
    bases = F.broadcast(bases) if bases.count() <= MOST_BROADCAST else bases
    placed = table.join(bases, ["part", "seq"]).select("base", "block")

    def docs(frames):
        for batch in frames:
            for base, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = list(Block(data.as_buffer().to_pybytes()).documents())
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _, _ in found], pa.int64()), pa.array([base + a for _, a, _ in found], pa.int64()), pa.array([i.tobytes() for _, _, i in found], pa.binary())], ["d", "start", "ids"])

    return placed.mapInArrow(docs, "d long, start long, ids binary")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Writes the blocks to the shared folder and reports what is read back."""
    path = new_path(docs.sparkSession, "tokens")
    write(docs, tokenizer, path, end_id)
    back = read(docs.sparkSession, path)
    return back.select(unkey(F.col("d")).alias("doc_id"), "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
