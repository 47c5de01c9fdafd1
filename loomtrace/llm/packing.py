"""Best-fit packing of tokenised documents: in each task, then of the tasks' residues among all bins."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WordMemo, new_path, portions, texts, tokenizer_path

#: A piece in a bin: doc_id, whether the id is null, piece, start, length, crc32.
_PIECE = np.dtype([("doc_id", "<i8"), ("null", "<i8"), ("piece", "<i8"), ("start", "<i8"), ("length", "<i8"), ("crc", "<i8")])
_BINS = "sequence_id long, size int, members binary, done boolean"


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins as lists of item numbers, by best-fit decreasing.

    Open bins are kept by room left; a bit set of the rooms that occur gives the
    least sufficient room at once, so n items take O(n) steps.
    """
    bins: list[list[int]] = []
    open_at: dict[int, list[int]] = {}
    mask = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        fit = mask >> s
        if fit:
            room = s + (fit & -fit).bit_length() - 1
            k = open_at[room].pop()
            if not open_at[room]:
                mask &= ~(1 << room)
            bins[k].append(i)
        else:
            room, k = capacity, len(bins)
            bins.append([i])
        room -= s
        if room:
            open_at.setdefault(room, []).append(k)
            mask |= 1 << room
    return bins


def place(small: list[tuple[int, int]], rooms: dict[int, int], capacity: int) -> list[tuple[int, int, int, int]]:
    """Where small bins (tag, size) go, by best fit among ``rooms``: size -> number of bins of that size.

    Returns (tag, size of the bin that takes it, which one of that size, or -1, tag
    of the small bin that takes it, and place there); those that open a sequence are left out.
    """
    left = {capacity - size: n for size, n in rooms.items() if size < capacity and n}
    taken, begun, out = {}, {}, []
    mask = sum(1 << room for room in left)
    for tag, size in sorted(small, key=lambda x: (-x[1], x[0])):
        fit = mask >> size
        if not fit:
            home, room = (capacity, -1, tag), capacity
        else:
            room = size + (fit & -fit).bit_length() - 1
            if begun.get(room):
                home = begun[room].pop()
            else:
                own = capacity - room
                taken[own] = taken.get(own, 0) + 1
                left[room] -= 1
                home = (own, taken[own], -1)
            if not begun.get(room) and not left.get(room):
                mask &= ~(1 << room)
        if home[2] != tag:
            out.append((tag, home[0] if home[2] < 0 else -1, home[1] if home[2] < 0 else home[2], capacity - room))
        if room > size:
            begun.setdefault(room - size, []).append(home)
            mask |= 1 << (room - size)
    return out


def _batch(bins: list[tuple[int, int, bytes]], done: bool):
    """Bins (tag, size, members) as rows."""
    seq, size, held = zip(*bins) if bins else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(seq, pa.int64()), pa.array(size, pa.int32()), pa.array(held, pa.binary()), pa.array([done] * len(bins), pa.bool_())], ["sequence_id", "size", "members", "done"])


class _Packer:
    """Best fit over the items of one task, some at a time.

    A best fit leaves at most one bin that is half full or less, and no two fuller
    ones fit together. So only the small bins of the lots go on, and none meets
    another before all bins are known. Of the others no more than ``spare`` of a
    size are held until the end; the rest are written at once, and may be taken by small ones as well.
    """

    def __init__(self, capacity: int, enough: int, most: int, spare: int, tag):
        self.capacity, self.enough, self.most, self.spare, self.tag = capacity, enough, most, spare, tag
        self.sizes: list[int] = []
        self.members: list[bytes] = []
        self.rest: list[tuple[int, bytes]] = []
        self.kept: dict[int, int] = {}

    def add(self, sizes, members):
        """Takes items; yields bins now and then."""
        self.sizes += sizes
        self.members += members
        if len(self.sizes) >= self.most:
            yield from self._flush()

    def _flush(self):
        final = []
        sizes = np.asarray(self.sizes, np.int64)
        for own in best_fit(sizes, self.capacity):
            size, held = int(sizes[own].sum()), b"".join(self.members[i] for i in own)
            self.kept[size] = self.kept.get(size, 0) + 1
            if 2 * size > self.capacity and (size >= self.enough or self.kept[size] > self.spare):
                final.append((self.tag(), size, held))
            else:
                self.rest.append((size, held))
        self.sizes, self.members = [], []
        yield _batch(final, True)

    def end(self):
        """The last bins."""
        if self.sizes:
            yield from self._flush()
        yield _batch([(self.tag(), size, held) for size, held in self.rest], False)


def _tags(level: int):
    """Numbers of bins: level, partition and a counter; a repeated task gives the same."""
    base, n = level << 56 | TaskContext.get().partitionId() << 28, -1

    def tag():
        nonlocal n
        n += 1
        return base + n

    return tag


def pack(docs: DataFrame, capacity: int = 2048, path: str | None = None, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", fan_in: int = 8, full: float = 0.995, most: int = 100_000, spare: int = 64, words: int = 900_000) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece.

    Each partition tokenises its documents once and packs them best-fit, at most
    ``most`` pieces at a time. Then each lot's small bin (half full or less) is
    placed by best fit among all bins of all tasks, whatever their number; see
    ``_moves``. ``full`` and ``spare`` only say which bins a task writes at once;
    ``fan_in`` has no effect any more. A worker remembers the ids of at most ``words`` words. Null texts are empty documents of the end id alone; repeated rows
    are packed each; null ids stay null; an empty table gives no rows.
    """
    spark, path = docs.sparkSession, path or tokenizer_path()
    end = struct.pack("<I", end_id)
    enough = int(np.ceil(capacity * full))
    root = new_path(spark, "bins")

    def first(batches):
        memo, packer = WordMemo.at(path, words), _Packer(capacity, enough, most, spare, _tags(0))
        for b in portions(batches):
            for doc, ids in zip(b.column(0).to_pylist(), memo.encode_many(b.column(1).to_pylist())):
                ids += end
                sizes, members = [], []
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    sizes.append(len(own) // 4)
                    members.append(struct.pack("<6q", doc or 0, doc is None, piece, at // 4, len(own) // 4, zlib.crc32(own)))
                yield from packer.add(sizes, members)
        yield from packer.end()

    start = texts(docs, id_col, text_col)
    start.mapInArrow(first, _BINS).write.parquet(f"{root}/0")
    bins = spark.read.schema(_BINS).parquet(f"{root}/0")
    moves = _moves(bins, capacity)

    def explode(batches):
        for b in batches:
            held = b.column("members").to_pylist()
            if not held:
                continue
            flat = np.frombuffer(b"".join(held), _PIECE)
            count = np.asarray([len(m) // _PIECE.itemsize for m in held])
            seq = np.repeat(np.asarray(b.column("sequence_id")), count)
            done = np.cumsum(flat["length"]) - flat["length"]
            head = np.cumsum(count) - count
            offset = done - np.repeat(done[head], count) + np.repeat(np.asarray(b.column("at")).astype(np.int64), count)
            cols = [pa.array(np.ascontiguousarray(flat["doc_id"]), mask=flat["null"] != 0), pa.array(flat["piece"].astype(np.int32)), *(pa.array(np.ascontiguousarray(flat[k])) for k in ("start", "length", "crc")), pa.array(seq), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    there = F.broadcast(spark.createDataFrame(moves, "from long, to long, at int"))
    done = bins.join(there, bins["sequence_id"] == there["from"], "left").select(F.coalesce("to", "sequence_id").alias("sequence_id"), F.coalesce("at", F.lit(0)).alias("at"), "members")
    return done.mapInArrow(explode, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def _moves(bins: DataFrame, capacity: int) -> list[tuple[int, int, int]]:
    """(small bin, sequence that takes it, place there): a best fit of the small bins among all bins.

    Two bins that are more than half full never fit together, so only small ones
    move, of which each lot of a task has one. The driver sees their tags and the
    number of bins of each size, and then the tags of the bins that it takes.
    """
    half = capacity // 2
    small = [(r.sequence_id, r.size) for r in bins.where(F.col("size") <= half).select("sequence_id", "size").collect()]
    if not small:
        return []
    large = bins.where(F.col("size").between(half + 1, capacity - min(n for _, n in small))).select("size", "sequence_id")
    placed = place(small, {r["size"]: r["count"] for r in large.groupBy("size").count().collect()}, capacity)
    wanted: dict[int, int] = {}
    for _, size, nth, _ in placed:
        if size >= 0:
            wanted[size] = max(wanted.get(size, 0), nth)
    tags = {}
    if wanted:
        nth = F.row_number().over(Window.partitionBy("size").orderBy("sequence_id"))
        asked = large.where(F.col("size").isin(list(wanted))).withColumn("nth", nth).where(F.col("nth") <= max(wanted.values()))
        tags = {(r["size"], r["nth"]): r["sequence_id"] for r in asked.where(F.col("nth") <= F.create_map(*[F.lit(x) for kv in wanted.items() for x in kv])[F.col("size")]).collect()}
    return [(tag, tags[size, nth] if size >= 0 else nth, at) for tag, size, nth, at in placed]
