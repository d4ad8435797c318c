"""Best-fit packing after Martello-Toth dominance reduction.

Packing looks only at lengths, and there are at most `capacity` of them: the
whole instance is a histogram of `capacity` counts.  The reduction and best-fit
decreasing run on that histogram, many equal documents at a time, and give a
plan: the ranks a..b of length s go to sequences q.. at offset o.  Documents
then find their place by their rank among the documents of their length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_caches, stored, text_of
from .token_ids import encoder, vocabulary

CAPACITY = 2048
END_ID = 0
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary, item long, part int, nth long"


def crc_of(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids: only the first one may be short of the capacity."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first), *((a, capacity) for a in range(first, n, capacity))]


def _pieces(path: str, end_id: int, capacity: int, special: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, part = encoder(path), TaskContext.get().partitionId()
        seen: dict[int, int] = defaultdict(int)
        item = part << 33
        end = np.array([end_id], dtype="<u2").tobytes()
        for batch in batches:
            found = code.encode(batch.column(1))
            for at in range(0, batch.num_rows, 512):
                rows: list[tuple] = []
                for doc_id, raw in zip(batch.column(0).slice(at, 512).to_pylist(), found):
                    ids = np.frombuffer(raw + end, dtype="<u2")
                    for piece, (start, length) in enumerate(cut(len(ids), capacity)):
                        own = ids[start : start + length]
                        rows.append((doc_id, piece, start, length, crc_of(own), own.tobytes(), item, part, seen[length]))
                        seen[length] += 1
                    item += 1
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*rows), kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32", "ids", "item", "part", "nth"])

    return run


def reduce_and_fit(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Plan rows (length, first rank, how many, first sequence, offset) and the number of sequences.

    Each row places `how many` items of one length, of following ranks, at one
    offset of following sequences.
    """
    left = np.zeros(capacity + 1, dtype=np.int64)
    for size, n in counts.items():
        left[size] = n
    used = np.zeros(capacity + 1, dtype=np.int64)
    plan: list[tuple[int, int, int, int, int]] = []
    total = 0

    def put(size: int, n: int, first: int, offset: int) -> None:
        plan.append((size, int(used[size]), n, first, offset))
        used[size] += n
        left[size] -= n

    def smallest(k: int) -> list[int]:
        out: list[int] = []
        for size in np.flatnonzero(left)[:k]:
            out += [int(size)] * int(min(left[size], k - len(out)))
        return out[:k]

    def best_pair(room: int) -> int:
        """The largest sum of two remaining items that fits in `room`."""
        sizes, best = np.flatnonzero(left[: room + 1]), 0
        for a in sizes[sizes * 2 <= room]:
            b = sizes[np.searchsorted(sizes, room - a, side="right") - 1]
            if b > a or (b == a and left[a] > 1):
                best = max(best, int(a + b))
            elif b == a and (at := np.searchsorted(sizes, a)) > 0:
                best = max(best, int(a + sizes[at - 1]))
        return best

    # Reduction: a set that dominates every other set with its largest item is fixed for good.  What is fixed can let
    # longer items be dominated that were not before, so the passes go on until one fixes nothing.
    fixed = True
    while fixed:
        fixed = False
        for size in range(capacity, 0, -1):
            while left[size]:
                room = capacity - size
                left[size] -= 1
                fits = np.flatnonzero(left[: room + 1])
                partner = int(fits[-1]) if len(fits) else 0
                three = smallest(3)
                alone = partner == 0
                dominated = alone or partner == room or sum(three[:2]) > room or len(three) < 2
                if not dominated and (sum(three) > room or len(three) < 3):
                    dominated = best_pair(room) <= partner
                left[size] += 1
                if not dominated:
                    break
                if alone:
                    n = int(left[size])
                    put(size, n, total, 0)
                elif partner == size:
                    n = int(left[size] // 2)
                    put(size, n, total, 0)
                    put(size, n, total, size)
                else:
                    n = int(min(left[size], left[partner]))
                    put(size, n, total, 0)
                    put(partner, n, total, size)
                total += n
                fixed = True

    # Best fit, longest first, over what is left: sequences of equal room are ranges.
    rooms: list[int] = []
    open_: dict[int, list[tuple[int, int]]] = defaultdict(list)

    def add(room: int, first: int, n: int) -> None:
        if n and room:
            if not open_[room]:
                insort(rooms, room)
            open_[room].append((first, n))

    for size in range(capacity, 0, -1):
        while left[size]:
            at = bisect_left(rooms, size)
            if at < len(rooms):
                room = rooms[at]
                first, n = open_[room].pop()
                if not open_[room]:
                    rooms.pop(at)
            else:
                room, first = capacity, total
                n = -(-int(left[size]) // (capacity // size))
                total += n
            each = room // size
            full = min(n, int(left[size]) // each)
            if full:
                for k in range(each):
                    put(size, full, first, capacity - room + k * size)
                add(room - each * size, first, full)
            elif (some := int(left[size])) < each:
                for k in range(some):
                    put(size, 1, first, capacity - room + k * size)
                add(room - some * size, first, 1)
                full = 1
            add(room, first + full, n - full)
    return plan, total


def _places(plan: list[tuple[int, int, int, int, int]]):
    rows = np.array(sorted(plan), dtype=np.int64).reshape(-1, 5)
    keys = (rows[:, 0] << 48) | rows[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_caches()  # batches of ids are large, and no unit is encoded any more
        for batch in batches:
            names = batch.schema.names
            rank, length = (batch.column(names.index(c)).to_numpy(zero_copy_only=False) for c in ("rank", "length"))
            at = np.searchsorted(keys, (length << 48) | rank, side="right") - 1
            found = rows[at]
            own = [batch.column(k) for k, c in enumerate(names) if c != "rank"]
            yield pa.RecordBatch.from_arrays(
                [*own, pa.array(found[:, 3] + rank - found[:, 1]), pa.array(found[:, 4])],
                names=[*(c for c in names if c != "rank"), "sequence_id", "offset"],
            )

    return run


def pack(docs: DataFrame, path: str | None = None, end_id: int = END_ID, capacity: int = CAPACITY, with_ids: bool = True) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, item, sequence_id, offset, and ids (unsigned 16-bit, little-endian).

    `item` numbers the rows of `docs` (with gaps), so that the pieces of rows with equal doc_ids can be told apart.

    A null text is empty, and is packed as its end id alone; repeated rows are
    packed as often as they come; an empty table has no pieces.  Documents longer
    than the capacity are cut into full pieces, the first of which takes what is over.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    pieces = stored(rows.mapInArrow(_pieces(path or vocabulary(), end_id, capacity, False), _PIECES), "pieces")
    dealt = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in dealt.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    plan, _ = reduce_and_fit(counts, capacity)
    before = dealt.select("part", "length", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    kept = ["doc_id", "piece", "start", "length", "ids_crc32", "item"] + ["ids"] * with_ids
    ranked = pieces.join(before, ["part", "length"]).select(*kept, (F.col("before") + F.col("nth")).alias("rank"))
    kinds = {f.name: f.dataType.simpleString() for f in ranked.schema.fields}
    return ranked.mapInArrow(_places(plan), ", ".join(f"{c} {kinds[c]}" for c in kept) + ", sequence_id long, offset long")
