"""Packing documents into sequences: best-fit decreasing with certified bounds and repacking.

1. Every text is tokenised and ends with one end token. A document longer than a sequence is cut so
   that all its pieces but the first are full; full pieces are sequences of their own.
2. The rest is dealt into partitions by a hash, and each is packed by best-fit decreasing. Lower
   bounds from dual feasible functions certify a partition whose number of bins can't be beaten.
3. Partitions with a gap give up the pieces in their bins that aren't full, certified ones those in
   their least filled bins, which hold nearly all their room. These are dealt anew into fewer
   partitions, so that they meet others' pieces, and packed again; a round that saves no bin ends it.
Only ids, lengths and checksums travel; the tokens never leave the task that made them.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from branchframe.llm.bpe import encoder
from branchframe.llm.common import discard, materialise, small_batches, tidy_after

#: Pieces in a partition, about, and the most rounds of repacking.
PARTITION, ROUNDS = 8192, 4
#: Share of a certified partition's room that the bins it gives up hold at least.
GIVEN_ROOM = 0.95

_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("row", pa.int64())])
_PACKED = pa.schema([*_PIECES, ("bin", pa.int64()), ("offset", pa.int64()), ("fill", pa.int64()), ("again", pa.bool_()), ("part", pa.int64())])


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"`{f.name}` {'boolean' if f.type == pa.bool_() else 'bigint'}" for f in schema)


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of each piece: the first takes what is over, the others are full."""
    first = length % capacity or min(length, capacity)
    return [(0, first), *((s, capacity) for s in range(first, length, capacity))]


def tokenised_pieces(docs: DataFrame, path: str, capacity: int, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece of each document; null texts are empty (the end token alone)."""
    small_batches(docs.sparkSession)

    def run(batches):
        read = (((batch.column(0).to_pylist(), batch.column(2).to_pylist()), [x or "" for x in batch.column(1).to_pylist()]) for batch in tidy_after(batches))
        for (docs_here, rows_here), ids, offsets in encoder(path).run(read):
            rows = []
            for k, (doc, row) in enumerate(zip(docs_here, rows_here, strict=True)):
                all_ids = np.append(ids[offsets[k] : offsets[k + 1]], np.uint32(end_id)).astype("<u4")
                for piece, (start, length) in enumerate(cut(len(all_ids), capacity)):
                    rows.append((doc, piece, start, length, zlib.crc32(all_ids[start : start + length].tobytes()), row))
            columns = zip(*rows, strict=True) if rows else [[]] * len(_PIECES)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], schema=_PIECES)

    picked = docs.select(F.col(id_col).cast("bigint"), F.col(text_col), F.monotonically_increasing_id())
    return picked.mapInArrow(run, _ddl(_PIECES))


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The best bound of two families of dual feasible functions, over all their thresholds.

    For a threshold t up to half the capacity: items over capacity - t count whole, those under t
    nothing, others by their size. For k = 1, 2, ...: item x counts as floor((k + 1) x / capacity)
    k-ths, unless that is exact. The bins needed are the ceiling of each sum.
    """
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1, dtype=np.int64)
    best = 0
    below_n, below_sum = np.cumsum(count), np.cumsum(count * size)
    t = np.arange(0, capacity // 2 + 1)
    whole = below_n[capacity] - below_n[capacity - t]
    middle = below_sum[capacity - t] - np.where(t > 0, below_sum[np.maximum(t - 1, 0)], 0)
    best = int((whole + -(-middle // capacity)).max())
    for k in range(1, 101):
        grown = (k + 1) * size
        exact = grown % capacity == 0
        share = np.where(exact, size * k, grown // capacity * capacity)  # in units of 1 / (k * capacity)
        best = max(best, int(-(-int((share * count).sum()) // (k * capacity))))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, and how full each bin gets."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    rooms: list[int] = []  # the different amounts of room, ascending
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    fill: list[int] = []
    for i, size in zip(order.tolist(), lengths[order].tolist(), strict=True):
        at = bisect_left(rooms, size)
        if at < len(rooms):
            room = rooms[at]
            b = by_room[room].pop()
            if not by_room[room]:
                rooms.pop(at)
        else:
            b, room = len(fill), capacity
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += size
        room -= size
        if room:
            if not by_room[room]:
                insort(rooms, room)
            by_room[room].append(b)
    return bins, offsets, np.array(fill, np.int64)


def given_up(fill: np.ndarray, capacity: int, certified: bool) -> np.ndarray:
    """Whether each bin is dealt anew: it isn't full, and in a certified partition is among the least filled."""
    room = capacity - fill
    if not certified:
        return room > 0
    order = np.argsort(-room, kind="stable")
    before = np.cumsum(room[order]) - room[order]
    out = np.zeros(len(fill), bool)
    out[order[before < GIVEN_ROOM * room.sum()]] = True
    return out


def _pack(capacity: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        order = [("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("row", "ascending")]
        table = table.select(_PIECES.names).sort_by(order)
        lengths = table["length"].to_numpy()
        bins, offsets, fill = best_fit_decreasing(lengths, capacity)
        again = given_up(fill, capacity, len(fill) == lower_bound(lengths, capacity))
        n = len(lengths)
        more = [pa.array(bins), pa.array(offsets), pa.array(fill[bins]), pa.array(again[bins]), pa.array(np.full(n, key[0].as_py()))]
        return pa.Table.from_arrays([*(c.combine_chunks() for c in table.columns), *more], schema=_PACKED)

    return run


def _packed(pieces: DataFrame, parts: int, salt: int, capacity: int) -> DataFrame:
    part = F.pmod(F.xxhash64(F.lit(salt), "doc_id", "piece", "row"), F.lit(parts))
    return materialise(pieces.select(*_PIECES.names, part.alias("part")).groupBy("part").applyInArrow(_pack(capacity), _ddl(_PACKED)), "packed")


def _bins(packed: DataFrame) -> int:
    """How many bins the partitions have: one row of numbers for each partition, summed by Spark."""
    return packed.groupBy("part").agg((F.max("bin") + 1).alias("n")).agg(F.sum("n")).first()[0] or 0


def pack(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    ``path`` is a vocabulary file on every executor. Null texts are empty documents of the end token
    alone; repeated rows are documents of their own; an empty table gives an empty one.
    """
    pieces = materialise(tokenised_pieces(docs, path, capacity, end_id, id_col, text_col), "pieces")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    full = pieces.filter(F.col("length") == capacity).select(*columns, (F.lit(-1) - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    done = [full]
    rest = pieces.filter(F.col("length") < capacity)
    here = rest.count()
    level, packed, total = 0, None, None
    while here:
        parts = max(1, -(-here // PARTITION))
        now = _packed(rest, parts, level, capacity)
        bins = _bins(now)
        if total is not None and bins >= total:  # the last packing stays
            discard(now)
            done.append(_final(packed, level - 1, columns))
            break
        if packed is not None:
            stays = packed.filter("not again")
            done.append(_final(stays, level - 1, columns))
        packed = now
        level += 1
        rest = packed.filter("again")
        here, total = rest.count(), _bins_of(rest)
        if level > ROUNDS or not here or parts == 1:
            done.append(_final(packed, level - 1, columns))
            break
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _bins_of(rows: DataFrame) -> int:
    return rows.select("part", "bin").distinct().count()


def _final(packed: DataFrame, level: int, columns: list[str]) -> DataFrame:
    sequence = (F.lit(level).cast("bigint") * F.lit(1 << 56)) + F.col("part") * F.lit(1 << 28) + F.col("bin")
    return packed.select(*columns, sequence.alias("sequence_id"), "offset")
