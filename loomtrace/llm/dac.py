"""Token ids in directly addressable codes, in sharded files with random access."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WordMemo, new_path, portions, texts, tokenizer_path

MAGIC = b"DAC1"
#: Bits of a bitmap for each entry of its rank directory.
SUPER = 512


def encode_block(ids: np.ndarray, width: int = 8) -> bytes:
    """``ids`` (below 2**32) as one block.

    Level k holds the k-th ``width`` bits of the ids that are long enough, a
    bitmap that tells which of them go on, and the bitmap's ones before every
    512th bit. An id is found without decoding its neighbours: see ``Block.get``.
    """
    kind = np.dtype("<u1" if width == 8 else "<u2")
    rest, parts = np.asarray(ids, np.uint32), []
    while True:
        chunk = (rest & np.uint32((1 << width) - 1)).astype(kind)
        more = (rest >> np.uint32(width)) > 0
        bits = np.packbits(more, bitorder="little")
        ones = np.add.reduceat(more, np.arange(0, len(more), SUPER), dtype=np.int64) if len(more) else np.zeros(0, np.int64)
        ranks = (np.cumsum(ones) - ones).astype("<u4")
        parts.append(struct.pack("<QQQ", chunk.nbytes, bits.nbytes, ranks.nbytes) + chunk.tobytes() + bits.tobytes() + ranks.tobytes())
        rest = rest[more] >> np.uint32(width)
        if not len(rest):
            break
    return MAGIC + struct.pack("<QBB", len(ids), width, len(parts)) + b"".join(parts)


class Block:
    """A block of ids that was written by ``encode_block``."""

    def __init__(self, raw: bytes):
        if raw[:4] != MAGIC:
            raise ValueError("not a block of token ids")
        self.n, self.width, levels = struct.unpack_from("<QBB", raw, 4)
        kind, at, self.levels = np.dtype("<u1" if self.width == 8 else "<u2"), 14, []
        for _ in range(levels):
            a, b, c = struct.unpack_from("<QQQ", raw, at)
            at += 24
            self.levels.append((np.frombuffer(raw, kind, a // kind.itemsize, at), np.frombuffer(raw, np.uint8, b, at + a), np.frombuffer(raw, "<u4", c // 4, at + a + b)))
            at += a + b + c

    def get(self, i: int) -> int:
        """The i-th id; touches one chunk, bit and directory entry of each level."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for k, (chunk, bits, ranks) in enumerate(self.levels):
            value |= int(chunk[i]) << (k * self.width)
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            base = i // SUPER
            begin = base * SUPER >> 3
            inside = np.unpackbits(bits[begin : (i >> 3) + 1], bitorder="little")[: i - base * SUPER]
            i = int(ranks[base]) + int(inside.sum())
        return value

    def all(self) -> np.ndarray:
        out = np.zeros(self.n, np.uint32)
        where = None
        for k, (chunk, bits, _) in enumerate(self.levels):
            part = chunk.astype(np.uint32) << np.uint32(k * self.width)
            if where is None:
                out |= part
                where = np.arange(self.n)
            else:
                out[where] |= part
            where = where[np.unpackbits(bits, bitorder="little")[: len(chunk)].astype(bool)]
        return out


_SCHEMA = "shard int, block int, first_token long, n_tokens long, doc_ids array<bigint>, lengths array<bigint>, ids binary"


def write_tokens(docs: DataFrame, out: str, path: str | None = None, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", block_tokens: int = 1 << 17) -> None:
    """Tokenise ``docs`` into files of blocks at ``out``, in ascending doc_id order.

    Rows are dealt by ranges of (doc_id, hash of the text), sorted inside each
    partition and encoded once; a partition is a shard and holds blocks of about
    ``block_tokens`` ids. Files go through Spark's committer, so a lost executor's
    tasks are simply repeated. Null texts are empty, null ids come first, rows
    with one id are ordered by the text's hash, an empty table writes no block.
    """
    path = path or tokenizer_path()
    end = struct.pack("<I", end_id)

    def encode(batches):
        memo, shard = WordMemo.at(path), TaskContext.get().partitionId()
        names, sizes, raw, held, first, block = [], [], [], 0, 0, 0

        def flush():
            ids = np.frombuffer(b"".join(raw), "<u4")
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([first], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([names], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64())), pa.array([encode_block(ids)], pa.binary())],
                ["shard", "block", "first_token", "n_tokens", "doc_ids", "lengths", "ids"],
            )

        for b in portions(batches):
            for i, t in zip(b.column(0).to_pylist(), memo.encode_many(b.column(1).to_pylist())):
                ids = t + end
                names.append(i)
                sizes.append(len(ids) // 4)
                raw.append(ids)
                held += len(ids) // 4
                if held >= block_tokens:
                    yield flush()
                    first, block, held, names, sizes, raw = first + held, block + 1, 0, [], [], []
        if names:
            yield flush()

    rows = texts(docs, id_col, text_col)
    tie = F.xxhash64("text")
    dealt = rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), tie).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), tie)
    dealt.mapInArrow(encode, _SCHEMA).write.parquet(out)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files at ``path``.

    ``start`` adds up one row a shard, then one a block; ids are decoded block by
    block where the files lie.
    """
    files = spark.read.schema(_SCHEMA).parquet(path)
    totals = files.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    bases = totals.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("base"))

    def decode(batches):
        for b in batches:
            for first, base, names, sizes, raw in zip(*(b.column(k).to_pylist() for k in ("first_token", "base", "doc_ids", "lengths", "ids"))):
                ids = Block(raw).all().astype("<u4").tobytes()
                sizes = np.asarray(sizes, np.int64)
                at = np.cumsum(sizes) - sizes
                crc = [zlib.crc32(ids[4 * a : 4 * (a + n)]) for a, n in zip(at.tolist(), sizes.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(at + first + base), pa.array(sizes), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    rows = files.select("shard", "first_token", "doc_ids", "lengths", "ids").join(F.broadcast(bases) if _few(bases) else bases, "shard")
    return rows.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokens_at(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """(doc_id, place, token) for the distinct ``wanted`` (doc_id, place), places from 0, read from the files at ``path``.

    Documents are found by the blocks' directories alone; of the blocks that hold a
    wanted place the codes are read, and each id is taken from its levels without
    decoding the others. Places outside a document, null or unknown ids give no
    row; an id with several documents gives the place of each.
    """
    files = spark.read.schema(_SCHEMA).parquet(path)

    def spread(batches):
        for b in batches:
            for shard, block, names, sizes in zip(*(b.column(k).to_pylist() for k in ("shard", "block", "doc_ids", "lengths"))):
                n = np.asarray(sizes, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), shard, np.int32)), pa.array(np.full(len(n), block, np.int32)), pa.array(names, pa.int64()), pa.array(np.cumsum(n) - n), pa.array(n)], ["shard", "block", "doc_id", "at", "n"])

    def look(batches):
        for b in batches:
            for asked, raw in zip(b.column("asked").to_pylist(), b.column("ids").to_pylist()):
                block = Block(raw)
                yield pa.RecordBatch.from_arrays([pa.array([x["doc_id"] for x in asked], pa.int64()), pa.array([x["place"] for x in asked], pa.int64()), pa.array([block.get(x["i"]) for x in asked], pa.int64())], ["doc_id", "place", "token"])

    docs = files.select("shard", "block", "doc_ids", "lengths").mapInArrow(spread, "shard int, block int, doc_id long, at long, n long")
    hits = wanted.select(F.col("doc_id").cast("long"), F.col("place").cast("long")).distinct().join(docs, "doc_id").where("place >= 0 and place < n")
    asked = hits.groupBy("shard", "block").agg(F.collect_list(F.struct("doc_id", "place", (F.col("at") + F.col("place")).alias("i"))).alias("asked"))
    return asked.join(files.select("shard", "block", "ids"), ["shard", "block"]).mapInArrow(look, "doc_id long, place long, token long")


def _few(bases: DataFrame, most: int = 100_000) -> bool:
    """Whether one row a shard may be broadcast: 16 bytes each, at most ``most``."""
    return len(bases.limit(most + 1).select("shard").collect()) <= most


def token_files(docs: DataFrame, path: str | None = None, end_id: int = 1, out: str | None = None) -> DataFrame:
    """Write ``docs`` in directly addressable codes and return what reading them gives."""
    out = out or new_path(docs.sparkSession, "tokens")
    write_tokens(docs, out, path, end_id)
    return read_tokens(docs.sparkSession, out)
